"""SQL for ratings that are solved for step by step: a game is several rows of a recursion, the last of which has the new state."""

from __future__ import annotations

_SCALE, _TAU = 173.7178, 0.5


def _excess(x: str, s: str) -> str:
    """The function whose root is the logarithm of the new variance, of one side's columns."""
    spread = f"({s}phi * {s}phi)"
    return f"(exp({x}) * ({s}delta * {s}delta - {spread} - {s}v - exp({x})) / (2 * ({spread} + {s}v + exp({x})) ** 2) - ({x} - {s}a) / {_TAU**2})"


def rating_fold(games: str, players: dict[str, tuple[str, str, str]]) -> str:
    """Common table expressions up to `h`, whose rows with `done` hold each key's state after game `n`.

    games: SQL of key, n (from 1, without gaps), game_no and what `players` names: of each side (a prefix of its columns) the
    opponent's rating, the opponent's deviation and the score, where state columns of the other side are as they were before the game.
    """
    sides = list(players)
    start = [c for s in sides for c in (f"1500.0::double as {s}r", f"500.0::double as {s}rd", f"0.06::double as {s}vol", *[f"0.0::double as {s}{c}" for c in ("phi", "v", "gain", "delta", "a", "lo", "flo", "hi", "fhi")])]
    seen, put, first, last = [], [], [], []
    for s, (rating, rd, score) in players.items():
        seen += [f"(h.{s}r - 1500) / {_SCALE} as {s}mu0", f"h.{s}rd / {_SCALE} as {s}phi0", f"1 / sqrt(1 + 3 * (({rd}) / {_SCALE}) ** 2 / pi() ** 2) as {s}k0", f"(({rating}) - 1500) / {_SCALE} as {s}o0", f"({score}) as {s}s0"]
        put.append(f"1 / (1 + exp(-{s}k0 * ({s}mu0 - {s}o0))) as {s}e0")
        first += [f"{s}phi0 as {s}phi", f"1 / ({s}k0 * {s}k0 * {s}e0 * (1 - {s}e0)) as {s}v", f"{s}k0 * ({s}s0 - {s}e0) as {s}gain", f"1 / ({s}k0 * {s}k0 * {s}e0 * (1 - {s}e0)) * ({s}k0 * ({s}s0 - {s}e0)) as {s}delta", f"ln({s}vol * {s}vol) as {s}a"]
        down = f"{s}a - list_min(list_filter(range(1, 100), lambda k: {_excess(f'({s}a - k * {_TAU})', s)} >= 0)) * {_TAU}"
        last += [f"{s}a as {s}lo", f"case when {s}delta * {s}delta > {s}phi * {s}phi + {s}v then ln({s}delta * {s}delta - {s}phi * {s}phi - {s}v) else {down} end as {s}hi"]
    names = lambda *c: ", ".join(f"{s}{x}" for s in sides for x in c)
    state = "r rd vol phi v gain delta a lo flo hi fhi".split()
    begin = f"""select key, n, game_no, false as done, {", ".join(f"{s}{x}" if x not in ("flo", "fhi") else f"{_excess(f'{s}{x[1:]}', s)} as {s}{x}" for s in sides for x in state)} from (select *, {", ".join(last)} from (select key, n, game_no, {names("r", "rd", "vol")}, {", ".join(first)} from (select *, {", ".join(put)} from
(select g.key, g.n, g.game_no, {", ".join(f"h.{s}{x}" for s in sides for x in ("r", "rd", "vol"))}, {", ".join(seen)} from h join g on h.key = g.key and g.n = h.n + 1 where h.done))))"""
    more = " or ".join(f"abs({s}hi - {s}lo) > 1e-6" for s in sides)
    mid, stepped = [], []
    for s in sides:
        mid.append(f"{s}lo + ({s}lo - {s}hi) * {s}flo / ({s}fhi - {s}flo) as {s}m")
        keep = lambda new, old, s=s: f"case when abs({s}hi - {s}lo) > 1e-6 then {new} else {old} end as {old}"
        stepped += [f"{s}{x}" for x in "r rd vol phi v gain delta a".split()]
        stepped += [keep(f"(case when {s}fm * {s}fhi <= 0 then {s}hi else {s}lo end)", f"{s}lo"), keep(f"(case when {s}fm * {s}fhi <= 0 then {s}fhi else {s}flo / 2 end)", f"{s}flo"), keep(f"{s}m", f"{s}hi"), keep(f"{s}fm", f"{s}fhi")]
    step = f"""select key, n, game_no, false, {", ".join(stepped)} from (select *, {", ".join(f"{_excess(f'{s}m', s)} as {s}fm" for s in sides)} from (select *, {", ".join(mid)} from h where not done and ({more})))"""
    ended = []
    for s in sides:
        vol = f"(case when n >= 30 and {s}rd < 250 then least(exp({s}lo / 2), 0.05) else exp({s}lo / 2) end)"
        phi = f"(1 / sqrt(1 / ({s}phi * {s}phi + {vol} * {vol}) + 1 / {s}v))"
        ended += [f"1500 + {_SCALE} * (({s}r - 1500) / {_SCALE} + {phi} ** 2 * {s}gain)", f"{_SCALE} * {phi}", vol, *[f"{s}{x}" for x in state[3:]]]
    end = f"select key, n, game_no, true, {', '.join(ended)} from h where not done and not ({more})"
    return f"""with recursive g as ({games}), h as (select distinct key, 0::bigint as n, null::bigint as game_no, true as done, {", ".join(start)} from g
union all ({begin}
union all {step}
union all {end}))"""
