"""Expressions over header values, clocks, results and position strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def try_int(c: Column) -> Column:
    return c.try_cast("int")


def clock_parts(clock: Column) -> Column:
    """Parts of a clock between colons, white space ignored."""
    return F.split(F.regexp_replace(clock, r"\s+", ""), ":")


def parts_seconds(parts: Column) -> Column:
    """Seconds of the parts of a clock; -1 if they are none."""
    at = lambda k: try_double(F.try_element_at(parts, F.lit(k)))
    value = F.when(F.size(parts) == 1, at(1)).when(F.size(parts) == 2, at(1) * 60 + at(2)).when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3))
    return F.coalesce(value, F.lit(-1.0))


def clock_seconds(clock: Column) -> Column:
    """Seconds of `S`, `M:SS(.s)` or `H:MM:SS`, white space ignored; -1 if it is none of them."""
    return parts_seconds(clock_parts(clock))


def strict_clock_seconds(clock: Column) -> Column:
    """Seconds of `H:MM:SS`; 0 for anything else."""
    parts = F.split(clock, ":")
    at = lambda k: try_double(F.try_element_at(parts, F.lit(k)))
    return F.coalesce(F.when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3)), F.lit(0.0))


#: The clock of a comment.
CLOCK = r"\[%clk\s*([^\]]+)\]"


def comment_clock(comment: Column) -> Column:
    """The clock of a `[%clk ...]` annotation, or null."""
    found = F.regexp_extract(comment, CLOCK, 1)
    return F.when(found != "", F.trim(found))


def time_control(value: Column) -> tuple[Column, Column]:
    """(base, increment) seconds of `base+inc` or `base`; -1 where it can't be read."""
    parts = F.split(value, r"\+")
    base = F.coalesce(try_double(F.get(parts, 0)), F.lit(-1.0))
    gain = F.when(base < 0, F.lit(-1.0)).when(F.size(parts) == 1, F.lit(0.0)).otherwise(F.coalesce(try_double(F.get(parts, 1)), F.lit(-1.0)))
    return base, gain


def is_increment_control(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\d+\+\d+$"), F.lit(False))


def result_label(result: Column) -> Column:
    """1 white wins, 0 draw, -1 black wins, else null."""
    return F.when(result == "1-0", 1).when(result == "1/2-1/2", 0).when(result == "0-1", -1)


def result_for_side(result: Column, side: Column) -> Column:
    """1, 0.5 or 0 as seen by side `w` or `b`; null if unfinished."""
    label = result_label(result)
    return (F.when(side == "w", label).otherwise(-label) + 1) / 2.0


def result_class(label: Column) -> Column:
    """Class of a result label: 0 black wins, 1 draw, 2 white wins."""
    return (label + 1).cast("int")


def result_word_score(word: Column) -> Column:
    return F.when(word == "win", 1.0).when(word == "loss", 0.0).otherwise(0.5)


def strip_counters(fen: Column) -> Column:
    """The first four fields of a position: both move counters go."""
    return F.array_join(F.slice(F.split(fen, " "), 1, 4), " ")


def position_of_key(key: Column) -> Column:
    """The position of a JSON-array key (its last element), or the key itself if it is none."""
    return F.coalesce(F.try_element_at(F.from_json(key, "array<string>"), F.lit(-1)), key)


def position_of_pipe_key(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def position_key(history: Column, fen: Column) -> Column:
    """JSON-array key of the moves played so far and the position."""
    return F.to_json(F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(fen)))


def pipe_key(history: Column, fen: Column) -> Column:
    return F.concat(fen, F.lit("|"), F.array_join(history, ","))


def fullmove(fen: Column) -> Column:
    """The full-move number, null if malformed."""
    return F.get(F.split(fen, " "), 5).try_cast("int")


def fen_characters(fen: Column) -> Column:
    """Side, 64 squares, castling (4), en passant (2), half-move (3) and full-move (3) as 77 characters."""
    f = F.split(fen, " ")
    board = F.regexp_replace(F.get(f, 0), "/", "")
    for n in range(8, 0, -1):
        board = F.regexp_replace(board, str(n), "." * n)
    castling = F.when(F.get(f, 2) == "-", "").otherwise(F.get(f, 2))
    passant = F.when(F.get(f, 3) == "-", "").otherwise(F.get(f, 3))
    return F.concat(F.get(f, 1), board, F.rpad(castling, 4, "."), F.rpad(passant, 2, "."), F.rpad(F.get(f, 4), 3, "."), F.rpad(F.get(f, 5), 3, "."))


#: The characters of a position string, in order of their ids.
FEN_ALPHABET = "0123456789abcdefghpnrkqPBNRQKw."


def fen_tokens(fen: Column) -> Column:
    """Ids of the characters and, last, the class token (the alphabet's size)."""
    ids = F.create_map(*[x for i, c in enumerate(FEN_ALPHABET) for x in (F.lit(c), F.lit(i))])
    return F.concat(F.transform(F.split(fen_characters(fen), ""), lambda c: F.try_element_at(ids, c)), F.array(F.lit(len(FEN_ALPHABET))))


def by_square(vocabulary: dict[str, int]) -> dict[str, dict[str, int]]:
    """Ids by the square that a move begins on and the rest of its name: maps are searched entry by entry, so two short ones take less than a long one."""
    squares: dict[str, dict[str, int]] = {}
    for m, i in vocabulary.items():
        squares.setdefault(m[:2], {})[m[2:]] = i
    return squares


def move_id(move: Column, vocabulary: dict[str, int]) -> Column:
    """The id of a move; null if the vocabulary lacks it."""
    pairs = lambda d, value: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), value(v))])
    ids = pairs(by_square(vocabulary), lambda rest: pairs(rest, F.lit))
    return F.try_element_at(F.try_element_at(ids, F.substring(move, 1, 2)), F.substr(move, F.lit(3)))


def filled(tokens: Column, pad: int, n: int = 12) -> Column:
    """At most n tokens, filled up with `pad` in front."""
    return F.concat(F.array_repeat(F.lit(pad), n - F.size(tokens)), tokens)


def history_tokens(moves: Column, vocabulary: dict[str, int], pad: int, n: int = 12) -> Column:
    """Ids of the last n moves, filled up with `pad` in front.

    Where histories are taken from plies, look up each ply's id once and `filled` does the rest."""
    last = F.slice(moves, F.greatest(F.size(moves) - n + 1, F.lit(1)), n)
    return filled(F.transform(last, lambda m: move_id(m, vocabulary)), pad, n)


def move_vocabulary() -> dict[str, int]:
    """Ids of all moves: square by square from a1, b1, ... on, the queen's and then the knight's targets in that order; then promotions."""
    name = lambda s: "abcdefgh"[s % 8] + str(s // 8 + 1)
    moves = []
    for s in range(64):
        steps = [(t, abs(t % 8 - s % 8), abs(t // 8 - s // 8)) for t in range(64) if t != s]
        moves += [name(s) + name(t) for t, x, y in steps if x == 0 or y == 0 or x == y]
        moves += [name(s) + name(t) for t, x, y in steps if {x, y} == {1, 2}]
    for rank, last in (("2", "1"), ("7", "8")):
        for f in range(8):
            moves += ["abcdefgh"[f] + rank + "abcdefgh"[t] + last + p for t in (f, f - 1, f + 1) if 0 <= t < 8 for p in "qrbn"]
    return {m: i for i, m in enumerate(moves)}


def mirror_move(move: Column) -> Column:
    """The same move seen from the other side: ranks turned over."""
    return F.translate(move, "12345678", "87654321")


def hms(seconds: Column) -> Column:
    """`H:MM:SS` of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def duration(seconds: Column) -> Column:
    """`1h 2m 3s`, leading units left out while zero."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s % 60))


def time_warning(seconds: Column) -> Column:
    return F.when(seconds < 10, "critical").when(seconds < 30, "low").when(seconds < 60, "caution").otherwise("none")


def band_bounds(band: Column) -> tuple[Column, Column, Column]:
    """(low, high, midpoint) of `lo_hi`."""
    low, high = try_int(F.get(F.split(band, "_"), 0)), try_int(F.get(F.split(band, "_"), 1))
    return low, high, (low + high) / 2.0


def moves_as_csv(moves: Column) -> Column:
    """`m:p; m:p` of an array of struct<move, p>."""
    return F.array_join(F.transform(moves, lambda m: F.concat(m["move"], F.lit(":"), F.format_string("%.4f", m["p"]))), "; ")


def year_month(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}-\d{2})", 1)
