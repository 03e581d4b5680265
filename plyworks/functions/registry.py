"""Functions under names that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .board import Position, replay, uci
from .text import FEN_ALPHABET, by_square, move_vocabulary


@F.pandas_udf(T.ArrayType(T.StringType()))
def legal_moves(fen: pd.Series) -> pd.Series:
    """Legal moves of each position, sorted; null for a null position."""
    return fen.map(lambda f: None if f is None else sorted(uci(m) for m in Position(f).moves()))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def legal_move_ids(fen: pd.Series) -> pd.Series:
    """Ids of the legal moves in the vocabulary, rising: the positions at which a move mask is set."""
    ids = move_vocabulary()
    return fen.map(lambda f: None if f is None else sorted(ids[uci(m)] for m in Position(f).moves()))


@F.pandas_udf(T.StringType())
def game_outcome(fen: pd.Series) -> pd.Series:
    """mate, stalemate, insufficient or fifty moves; null if the game goes on."""
    return fen.map(lambda f: None if f is None else Position(f).outcome())


@F.pandas_udf(T.ArrayType(T.StringType()))
def san_to_uci(moves: pd.Series) -> pd.Series:
    """Coordinates of moves in standard notation from the start; null if one of them is not legal."""

    def one(sans):
        if sans is None:
            return None
        found = [m[3] for m in replay(" ".join(sans))]
        return found if len(found) == len(sans) else None

    return moves.map(one)


@udtf(returnType="ply int, side string, san string, uci string, fen_before string, fen_after string, comment string")
class GamePlies:
    """The moves of a game's text, one row each, up to the first that is not legal."""

    def eval(self, movetext: str) -> Iterator[tuple]:
        yield from replay(movetext)


def _characters() -> str:
    """`text.fen_characters` as SQL."""
    board = "replace(split(fen, ' ')[0], '/', '')"
    for n in range(1, 9):
        board = f"replace({board}, '{n}', '{'.' * n}')"
    padded = [f"rpad(if(split(fen, ' ')[{k}] = '-', '', split(fen, ' ')[{k}]), {width}, '.')" for k, width in ((2, 4), (3, 2), (4, 3), (5, 3))]
    return f"concat(split(fen, ' ')[1], {board}, {', '.join(padded)})"


def token_expressions() -> dict[str, tuple[str, str]]:
    """Tokens of histories and positions for SQL, as `text.history_tokens` and `text.fen_tokens` give them. The vocabulary is a folded constant of the plan."""
    words = move_vocabulary()
    rest = lambda ids: ", ".join(f"'{m}', {i}" for m, i in ids.items())
    moves = f"map({', '.join(f"'{square}', map({rest(ids)})" for square, ids in by_square(words).items())})"
    letters = f"map_from_arrays(split('{','.join(FEN_ALPHABET)}', ','), sequence(0, {len(FEN_ALPHABET) - 1}))"
    return {
        "history_tokens(moves array<string>)": ("array<int>", f"concat(array_repeat({len(words)}, 12 - least(size(moves), 12)), transform(slice(moves, greatest(size(moves) - 11, 1), 12), m -> try_element_at(try_element_at({moves}, substr(m, 1, 2)), substr(m, 3))))"),
        "fen_tokens(fen string)": ("array<int>", f"concat(transform(split({_characters()}, ''), c -> try_element_at({letters}, c)), array({len(FEN_ALPHABET)}))"),
    }


#: Functions that are SQL expressions: name and arguments, type, expression.
EXPRESSIONS = {
    "strip_counters(fen string)": ("string", "array_join(slice(split(fen, ' '), 1, 4), ' ')"),
    "fullmove(fen string)": ("int", "try_cast(get(split(fen, ' '), 5) as int)"),
    "pipe_key(history array<string>, fen string)": ("string", "concat(fen, '|', array_join(history, ','))"),
    "result_class(result string)": ("int", "case result when '0-1' then 0 when '1/2-1/2' then 1 when '1-0' then 2 end"),
}


def vocabulary(spark: SparkSession) -> DataFrame:
    """id, move: all moves; the id after the last one pads a history."""
    return spark.createDataFrame([(i, m) for m, i in move_vocabulary().items()], "id int, move string")


def register(spark: SparkSession) -> None:
    """Functions on positions, moves and histories under their names, game_plies as a table function, the vocabulary as view `moves_vocabulary`."""
    for name, f in (("legal_moves", legal_moves), ("legal_move_ids", legal_move_ids), ("game_outcome", game_outcome), ("san_to_uci", san_to_uci)):
        spark.udf.register(name, f)
    spark.udtf.register("game_plies", GamePlies)
    for head, (kind, expression) in (EXPRESSIONS | token_expressions()).items():
        spark.sql(f"create or replace temporary function {head} returns {kind} return {expression}")
    vocabulary(spark).createOrReplaceTempView("moves_vocabulary")
