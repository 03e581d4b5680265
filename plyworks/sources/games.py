"""Game text as rows: plain, zstd or LZ4 files, one row per game, headers typed by Spark."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.sequences import first_of_each


def read_games(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """source_file, pgn: a game begins at a line that starts with `[Event `. Spark reads plain and .zst files itself."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n[Event ")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _games(reader.text(path))


def stream_games(spark: SparkSession, path: str) -> DataFrame:
    """The same over files that arrive."""
    return _games(spark.readStream.option("lineSep", "\n[Event ").text(path))


def _games(lines: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"^\s*\[Event ", "")
    return lines.filter(F.trim("value") != "").select(F.input_file_name().alias("source_file"), F.concat(F.lit("[Event "), body).alias("pgn"))


def lz4_frames(data: bytes, enough: Callable[[bytearray], bool] | None = None, step: int = 1 << 20) -> bytes:
    """Contents of concatenated LZ4 frames. Decoding stops after a step with which there is `enough`."""
    out, stream = bytearray(), pa.CompressedInputStream(pa.BufferReader(data), "lz4")
    while part := stream.read(step):
        out += part
        if enough and enough(out):
            break
    return bytes(out)


def read_lz4_games(spark: SparkSession, path: str, *, first_games: int | None = None) -> DataFrame:
    """Games of LZ4-framed files; a file is the unit of work, so many files make many tasks. With `first_games`, a file is decoded only as far as it takes."""

    @F.pandas_udf(T.StringType())
    def _unpack(content: pd.Series) -> pd.Series:
        stop = None if first_games is None else lambda out: out.count(b"[Event ") > first_games
        return content.map(lambda c: lz4_frames(c, stop).decode("utf-8", "replace"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.lz4").load(path)
    parts = files.select(F.col("path").alias("source_file"), F.posexplode(F.split(F.concat(F.lit("\n"), _unpack("content")), r"\n(?=\[Event )")).alias("__at", "pgn")).filter(F.trim("pgn") != "")
    if first_games is not None:
        parts = first_of_each(parts, "source_file", ["__at"], first_games)
    return parts.select("source_file", "pgn")


def with_headers(games: DataFrame) -> DataFrame:
    """Adds headers (map), typed header columns and movetext."""
    keys = F.regexp_extract_all("pgn", F.lit(r'(?m)^\[(\w+) "([^"]*)"\]'), F.lit(1))
    values = F.regexp_extract_all("pgn", F.lit(r'(?m)^\[(\w+) "([^"]*)"\]'), F.lit(2))
    last = F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull()))
    df = games.withColumn("headers", last)
    h = lambda name: F.try_element_at("headers", F.lit(name))
    base, gain = tx.time_control(h("TimeControl"))
    return df.select(
        *games.columns, "headers", h("Event").alias("event"), tx.try_int(h("WhiteElo")).alias("white_elo"), tx.try_int(h("BlackElo")).alias("black_elo"),
        h("Result").alias("result"), h("Termination").alias("termination"), base.alias("initial_time"), gain.alias("increment"),
        F.regexp_replace("pgn", r'(?m)^\[\w+ "[^"]*"\]\s*', "").alias("movetext"),
    )
