"""Ratings that depend on the games before: an ordered fold per player or match, in batch and over a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.glicko2 import START, shown, update
from ..functions.numeric import GROWTH_PER_DAY, LEAST_RATING, LEAST_RD, MOST_RATING, MOST_RD, START_RD, game_step
from .late_games import Replay, replayed

_OUT = "player string, game_no long, rating double, rd double, volatility double, listed long"
_STATE = "rating double, rd double, volatility double, played long, last long"


def _in_order(df: DataFrame, key: str, columns: str, step, start, schema: str) -> DataFrame:
    """A fold over each key's games in order of game_no. Rows stream by, so a task holds one batch and one state, however many games a key has.

    columns: what a game has besides its key. step(key, game, state) gives a row and the next state, start() the first state.
    Games are plain values: a table of its own for each key costs far more than the step where keys have few games."""
    fields = [c.split() for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        current, state = object(), None
        for batch in batches:
            out = []
            for k, *game in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)):
                if k != current:
                    current, state = k, start()
                row, state = step(k, game, state)
                out.append(row)
            if out:
                arrays = [pa.array(c, kinds[kind], from_pandas=True) for c, (_, kind) in zip(zip(*out), fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    games = df.select(key, *[F.col(name).cast(kind) for name, kind in (c.split() for c in columns.split(", "))])
    return games.repartition(key).sortWithinPartitions(key, "game_no").mapInArrow(task, schema)


def _rows(key, rows: pd.DataFrame, state, columns: str, step, schema: str):
    """The same fold over some games of one key."""
    out = []
    for game in rows.sort_values("game_no")[[c.split()[0] for c in columns.split(", ")]].itertuples(index=False, name=None):
        row, state = step(key, game, state)
        out.append(row)
    return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]), state


_GAME = "game_no long, opponent_rating double, opponent_rd double, score double"


def _step(player, game: Sequence, state: tuple[float, float, float, int]):
    no, opponent, opponent_rd, score = game
    *now, played = state
    state = (*update(*now, [(opponent, opponent_rd, score)], played=played), played + 1)
    return (None if player is None else str(player), int(no), *state[:3], shown(state[0])), state


def _fold(player, rows: pd.DataFrame, state: tuple[float, float, float, int]):
    return _rows(player, rows, state, _GAME, _step, _OUT)


def rate_games(games: DataFrame) -> DataFrame:
    """games: player, game_no, opponent_rating, opponent_rd, score. Each needs the last one's result, so a player's games are taken in order."""
    return _in_order(games, "player", _GAME, _step, lambda: (*START, 0), _OUT)


def rate_stream(games: DataFrame) -> DataFrame:
    """The same over a stream; the state of a player lasts from batch to batch. Games must arrive in order of game_no."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts)
        *held, last = state.get if state.exists else (*START, 0, -1)
        rows = rows[rows["game_no"] > last]  # a repeated delivery changes nothing
        if len(rows):
            out, held = _fold(key[0], rows, tuple(held))
            state.update((*held, int(rows["game_no"].max())))
            yield out

    return games.groupBy("player").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_USER_OUT = "user_id string, game_no long, rating_before double, rd_before double, rating double, rd double, change double, games_played long, wins long, losses long, draws long"
_USER_STATE = "rating double, rd double, played long, games long, wins long, losses long, draws long, last long"
USER_START = (1500.0, START_RD, None, 0, 0, 0, 0)


def after_game(rating: float, rd: float, opponent: float, opponent_rd: float, score: float) -> tuple[float, float, float]:
    """(rating, rd, change) after one game by the single-game update, to one decimal."""
    change, new_rd = game_step(rating, rd, opponent, opponent_rd, score, math.sqrt, pow)
    clamp = lambda x, low, high: round(max(low, min(high, x)), 1)
    return clamp(rating + change, LEAST_RATING, MOST_RATING), clamp(new_rd, LEAST_RD, MOST_RD), round(change, 1)


_USER_GAME = "game_no long, played_at long, opponent_rating double, opponent_rd double, score double"


def _user_step(user, game: Sequence, state: tuple):
    no, now, opponent, opponent_rd, score = game
    rating, rd, played, games, wins, losses, draws = state
    now = int(now)
    days = (now - played) // 86400 if played is not None else 0
    if days > 0:  # idle time makes a rating less certain
        rd = min(MOST_RD, round(math.sqrt(rd * rd + GROWTH_PER_DAY * days), 1))
    before, rd_before = rating, rd
    rating, rd, change = after_game(rating, rd, opponent, opponent_rd, score)
    games, wins, losses, draws = games + 1, wins + (score == 1), losses + (score == 0), draws + (score == 0.5)
    return (str(user), int(no), before, rd_before, rating, rd, change, games, wins, losses, draws), (rating, rd, now, games, wins, losses, draws)


def _user_fold(user, rows: pd.DataFrame, state: tuple):
    return _rows(user, rows, state, _USER_GAME, _user_step, _USER_OUT)


def user_history(games: DataFrame) -> DataFrame:
    """The history rows of service users. games: user_id, game_no, played_at (epoch seconds), opponent_rating, opponent_rd, score."""
    return _in_order(games, "user_id", _USER_GAME, _user_step, lambda: USER_START, _USER_OUT)


def user_history_stream(games: DataFrame) -> DataFrame:
    """The same over a stream, with a user's rating as state; a game that is delivered again changes nothing."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts)
        *held, last = state.get if state.exists else (*USER_START, -1)
        rows = rows[rows["game_no"] > last]
        if len(rows):
            out, held = _user_fold(key[0], rows, tuple(held))
            state.update((*held, int(rows["game_no"].max())))
            yield out

    return games.groupBy("user_id").applyInPandasWithState(step, _USER_OUT, _USER_STATE, "append", GroupStateTimeout.NoTimeout)


_MATCH_OUT = "match_id string, game_no long, white string, black string, white_rating double, white_rd double, black_rating double, black_rd double"


_MATCH_GAME = "game_no long, white string, black string, score double"


def _match_step(match, game: Sequence, state: dict):
    no, white, black, score = game
    w, b = state.get(white, (*START, 0)), state.get(black, (*START, 0))
    state[white] = (*update(*w[:3], [(b[0], b[1], score)], played=w[3]), w[3] + 1)
    state[black] = (*update(*b[:3], [(w[0], w[1], 1 - score)], played=b[3]), b[3] + 1)
    return (None if match is None else str(match), int(no), white, black, *state[white][:2], *state[black][:2]), state


def rate_matches(games: DataFrame) -> DataFrame:
    """Ratings after each game of a match, both players updated from what they had before it.

    games: match_id, game_no, white, black, score (of white). Each game needs the last one's ratings; they do not pass
    from match to match.
    """
    return _in_order(games, "match_id", _MATCH_GAME, _match_step, dict, _MATCH_OUT)


def rate_late_stream(games: DataFrame, *, rated: DataFrame | None = None, event_time: str = "played_at", delay: str = "1 hour") -> DataFrame:
    """As `rate_games` over a stream in which games arrive in any order: the rows of the batch, and `late`, the player's games so far that came too late.

    games: player, game_no, played_at (timestamp), opponent_rating, opponent_rd, score. A game waits until no game before it can come any more,
    `delay` after it was played; see `late_games`. rated: rows of `rate_games`, from which the ratings go on."""
    first = None if rated is None else rated.groupBy("player").agg(F.max_by(F.struct("rating", "rd", "volatility"), "game_no").alias("s"), F.count(F.lit(1)).alias("played"), F.max("game_no").alias("last")).select("player", "s.*", "played", "last")
    columns = "opponent_rating double, opponent_rd double, score double"
    return replayed(games, "player", event_time, delay, Replay(_fold, (*START, 0), columns, _OUT, _STATE), first)


def user_history_late_stream(games: DataFrame, *, event_time: str = "moment", delay: str = "1 hour") -> DataFrame:
    """As `user_history` over a stream in which games arrive in any order; moment is played_at as a timestamp."""
    columns = "played_at long, opponent_rating double, opponent_rd double, score double"
    return replayed(games, "user_id", event_time, delay, Replay(_user_fold, USER_START, columns, _USER_OUT, _USER_STATE))
