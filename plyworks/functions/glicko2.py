"""Glicko-2: one rating period of a player, by the published procedure."""

from __future__ import annotations

import math

SCALE = 173.7178


#: Fixed values of the rating list: a new player's state, the least rating shown, and the volatility's limit for established players.
START, FLOOR, ESTABLISHED_GAMES, ESTABLISHED_VOLATILITY = (1500.0, 500.0, 0.06), 600, 30, 0.05


def shown(rating: float) -> int:
    """The rating as it is listed: whole, and not below the floor. Updates go on from the exact one."""
    return max(round(rating), FLOOR)


def update(rating: float, rd: float, vol: float, games: list[tuple[float, float, float]], *, played: int = 0, idle: float | None = None, tau: float = 0.5) -> tuple[float, float, float]:
    """(rating, rd, volatility) after games (opponent's rating, opponent's rd, score).

    `played` counts the games before these, `idle` the rating periods since the last one: without games, when only rd
    grows, one, else none, if nothing is said.
    """
    mu, phi = (rating - 1500) / SCALE, rd / SCALE
    phi = math.sqrt(phi * phi + (idle if idle is not None else 0.0 if games else 1.0) * vol * vol)
    if not games:
        return rating, SCALE * phi, vol
    g = [1 / math.sqrt(1 + 3 * (d / SCALE) ** 2 / math.pi**2) for _, d, _ in games]
    e = [1 / (1 + math.exp(-k * (mu - (r - 1500) / SCALE))) for k, (r, _, _) in zip(g, games)]
    v = 1 / sum(k * k * p * (1 - p) for k, p in zip(g, e))
    gain = sum(k * (s - p) for k, p, (_, _, s) in zip(g, e, games))
    delta, a = v * gain, math.log(vol * vol)

    def f(x: float) -> float:
        ex = math.exp(x)
        return ex * (delta * delta - phi * phi - v - ex) / (2 * (phi * phi + v + ex) ** 2) - (x - a) / tau**2

    low = a
    if delta * delta > phi * phi + v:
        high = math.log(delta * delta - phi * phi - v)
    else:
        k = 1
        while f(a - k * tau) < 0:
            k += 1
        high = a - k * tau
    at_low, at_high = f(low), f(high)
    while abs(high - low) > 1e-6:
        mid = low + (low - high) * at_low / (at_high - at_low)
        at_mid = f(mid)
        if at_mid * at_high <= 0:
            low, at_low = high, at_high
        else:
            at_low /= 2
        high, at_high = mid, at_mid
    new_vol = math.exp(low / 2)
    if played + len(games) >= ESTABLISHED_GAMES and rd < START[1] / 2:
        new_vol = min(new_vol, ESTABLISHED_VOLATILITY)
    new_phi = 1 / math.sqrt(1 / (phi * phi + new_vol * new_vol) + 1 / v)
    return 1500 + SCALE * (mu + new_phi**2 * gain), SCALE * new_phi, new_vol
