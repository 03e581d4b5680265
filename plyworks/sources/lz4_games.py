"""Game text in LZ4 files as a Spark data source: `spark.read.format("lz4_games")`, in batch and for files that arrive.

Frames are found by the sizes of their blocks, without decoding. Runs of whole frames are a task each; a game that begins
in a run belongs to it, however far into the next frames it goes. A task holds a piece of decoded text and a game, never a
file; with `first_games` a file is read only as far as its first games take.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .arrivals import Arrivals
from .record_files import Place, session_path, told_path

FORMAT = "lz4_games"
SCHEMA = "source_file string, at long, no long, pgn string"
_BEGIN = b"\n[Event "
_PIECE = 1 << 20


def frames(f, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each frame of a file, from the headers of its blocks; skippable frames are passed over."""
    at = 0
    while at < size:
        head = f.read_at(min(19, size - at), at)
        magic = struct.unpack("<I", head[:4])[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + struct.unpack("<I", head[4:8])[0]
            continue
        if magic != 0x184D2204:
            raise ValueError(f"no LZ4 frame at byte {at}")
        start, flags = at, head[4]
        at += 7 + 8 * bool(flags & 8) + 4 * bool(flags & 1)  # size of the content, dictionary
        while block := struct.unpack("<I", f.read_at(4, at))[0]:
            at += 4 + (block & 0x7FFFFFFF) + 4 * bool(flags & 16)  # the highest bit: stored as it is; block checksum
        at += 4 + 4 * bool(flags & 4)  # content checksum
        yield start, at


class _Bytes(io.RawIOBase):
    """Bytes a to b of a file, as a file."""

    def __init__(self, f, a: int, b: int):
        self.f, self.at, self.end = f, a, b

    def readable(self):
        return True

    def readinto(self, buffer):
        part = self.f.read_at(min(len(buffer), self.end - self.at), self.at) if self.at < self.end else b""
        buffer[: len(part)] = part
        self.at += len(part)
        return len(part)


def decoded(f, a: int, b: int) -> Iterator[bytes]:
    """The text of the frames in bytes a to b, in pieces; compressed bytes are read as pieces need them."""
    stream = pa.CompressedInputStream(pa.PythonFile(_Bytes(f, a, b), "r"), "lz4")
    while part := stream.read(_PIECE):
        yield part


def games(pieces: Iterator[tuple[bytes, bool]], from_start: bool) -> Iterator[bytes]:
    """Games that begin in a run. pieces: text and whether it lies behind the run; text before the first beginning is another run's."""
    held, over = b"\n" if from_start else b"", False
    open_ = False
    for text, behind in pieces:
        if behind and not over:
            over = True  # what begins from here on is another run's, but a beginning may have started in the run's last bytes
            edge = len(held)
        held += text.replace(b"\r\n", b"\n")
        at = held.find(_BEGIN, 1 if open_ else 0)
        while at >= 0:
            if open_:
                yield held[:at].lstrip(b"\n")
            if over and at >= edge:
                return
            held, open_ = held[at:], True
            edge = edge - at if over else 0
            at = held.find(_BEGIN, 1)
        if not open_:
            cut = max(0, len(held) - len(_BEGIN))
            held, edge = held[cut:], (edge - cut if over else 0)
            if over and edge <= 0:
                return
    if open_ and held.strip():
        yield held.lstrip(b"\n")


@dataclass
class Run(ds.InputPartition):
    """Frames of a file, whole ones, and the bytes behind them."""

    name: str
    first: int
    last: int
    size: int


class _Files:
    """How a file is dealt and read."""

    def __init__(self, place: Place, bytes_per_task: int, first_games: int | None):
        self.place, self.bytes_per_task, self.first_games = place, bytes_per_task, first_games

    def runs(self, name: str) -> list[Run]:
        with self.place.open(name) as f:
            size = f.size()
            if self.first_games is not None:
                return [Run(name, 0, size, size)]
            out, first, last = [], 0, 0
            for a, b in frames(f, size):
                if b - first > self.bytes_per_task and a > first:
                    out.append(Run(name, first, a, size))
                    first = a
                last = b
            return [*out, Run(name, first, last, size)] if last > first else out

    def rows(self, run: Run) -> Iterator[tuple]:
        with self.place.open(run.name) as f:
            own = ((p, False) for p in decoded(f, run.first, run.last))
            behind = ((p, True) for p in decoded(f, run.last, run.size)) if run.last < run.size else iter(())
            both = (x for part in (own, behind) for x in part)
            for no, game in enumerate(games(both, run.first == 0)):
                if self.first_games is not None and no >= self.first_games:
                    return
                yield run.name, run.first, no, game.decode("utf-8", "replace")


class _Reader(ds.DataSourceReader):
    def __init__(self, options):
        place = Place(told_path(options))
        first = options.get("first_games")
        self.files, self.folder = _Files(place, int(options.get("bytes_per_task", 64 << 20)), None if first is None else int(first)), options["path"]

    def partitions(self):
        from pyarrow import fs

        files, path = self.files.place.at(self.folder)
        if files.get_file_info(path).type == fs.FileType.File:
            names = [path]
        else:
            names = sorted(f.path for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".lz4"))
        return [r for n in names for r in self.files.runs(n)] or [Run("", 0, 0, 0)]

    def read(self, partition):
        return self.files.rows(partition) if partition.name else iter(())


class _Stream(Arrivals):
    suffixes = (".lz4",)

    def __init__(self, options):
        super().__init__(options)
        self.files = _Files(self.place, int(options.get("bytes_per_task", 64 << 20)), None)

    def parts(self, name):
        return self.files.runs(name)

    def rows(self, partition):
        return self.files.rows(partition)


class Lz4Games(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def _options(spark: SparkSession, options: dict) -> dict:
    spark.dataSource.register(Lz4Games)
    options = {"shared_path": session_path(spark)} | options
    return {k: str(v) for k, v in options.items() if v is not None}


def read_games(spark: SparkSession, path: str, **options) -> DataFrame:
    """source_file, at (the byte where a task's run begins), no (inside it) and pgn: ordered by these, games are as in the files.

    Options: bytes_per_task, first_games (of each file), shared_path (see `record_files`)."""
    return spark.read.format(FORMAT).options(**_options(spark, options)).load(path)


def stream_games(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The same over files that arrive."""
    return spark.readStream.format(FORMAT).options(**_options(spark, options)).load(folder)
