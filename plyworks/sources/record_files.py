"""Record files as a Spark data source: `spark.read.format("record_files")`, and writing, an index, look-ups and merging.

A file holds records one after the other (compressed each for itself, plain in `.bag` files) and then 8-byte end offsets,
in the file itself or in one of the same name with `limits.` in front. The offsets are all that is needed to number
records: files are counted by their sizes, and only bytes of records that are asked for are read.

    records.register(spark)
    spark.read.format("record_files").load("/data/games@64.bagz").filter("global_idx = 123456")

Options: `limits` ("inside", or "separate" files), `rows_per_task`, `threads` (for looking at many files), `first` (the
global index of the first record, 0 if not given), and
`shared_path`: paths without a scheme, and `file:` ones, are local to each machine, so on a cluster they are refused
unless this says that all machines mount them ("true"), or names a folder that they mount. `read_files` and `write_files`
set it: to "true" for a local session, else to the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..operators.joins import in_intervals
from .records import BATCH, shard_names

FORMAT = "record_files"
SCHEMA = "source_file string, idx long, global_idx long, record binary"
_CHUNK = 8 << 20
_MERGED = "target string, files int, records long, bytes long"


def _local(name: str) -> str:
    return re.sub(r"^file:(//)?(?=/)", "", name)


def told_path(options) -> bool | str:
    """The option `shared_path`."""
    told = str(options.get("shared_path", "false"))
    return told.lower() == "true" if told.lower() in ("true", "false") else told


def session_path(spark: SparkSession) -> bool | str:
    """What a session's machines share: all paths if it is local, else the folder that spark.checkpoint.dir names."""
    if spark.sparkContext.master.startswith("local"):
        return True
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder if folder and re.match(r"/|file:/", folder) else False


class Place:
    """Files of a store: whatever Arrow reaches by URI, and paths that all machines share."""

    def __init__(self, shared_path: bool | str):
        """shared_path: whether all machines share local paths, or the folder below which they do."""
        self.shared_path = shared_path

    def shared(self, path: str) -> bool:
        if isinstance(self.shared_path, bool):
            return self.shared_path
        folder = posixpath.normpath(_local(self.shared_path))
        return f"{posixpath.normpath(path)}/".startswith(f"{folder.rstrip('/')}/")

    def at(self, name: str):
        from pyarrow import fs

        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", name)
        if scheme is None or scheme[1] == "file":
            if not self.shared(path := _local(name)):
                raise ValueError(f"{name} is a local path, which other machines don't see; set shared_path if all of them mount it")
            return fs.LocalFileSystem(), path
        return fs.FileSystem.from_uri(name)

    def open(self, name: str):
        files, path = self.at(name)
        return files.open_input_file(path)

    def create(self, name: str):
        files, path = self.at(name)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return files.open_output_stream(path)

    def move(self, name: str, to: str) -> None:
        (files, path), (_, target) = self.at(name), self.at(to)
        files.move(path, target)

    def remove(self, name: str) -> None:
        from pyarrow import fs

        files, path = self.at(name)
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_file(path)

    def exists(self, name: str) -> bool:
        from pyarrow import fs

        files, path = self.at(name)
        return files.get_file_info(path).type == fs.FileType.File


def limits_name(name: str) -> str:
    return re.sub(r"[^/]+$", lambda m: "limits." + m[0], name)


@dataclass
class RecordFile:
    """One file, read by ranges."""

    place: Place
    name: str
    separate: bool

    @property
    def plain(self) -> bool:
        return self.name.endswith(".bag")

    def layout(self) -> tuple[int, int]:
        """Bytes of the records, and how many records there are; reads 8 bytes at most."""
        if self.separate:
            with self.place.open(limits_name(self.name)) as f:
                n = f.size() // 8
                return (struct.unpack("<q", f.read_at(8, 8 * (n - 1)))[0] if n else 0), n
        with self.place.open(self.name) as f:
            if not f.size():
                return 0, 0
            start = struct.unpack("<q", f.read_at(8, f.size() - 8))[0]
            if not 0 <= start < f.size() or (f.size() - start) % 8:
                raise ValueError(f"{self.name} does not end in offsets")
            return start, (f.size() - start) // 8

    def ends(self, a: int, b: int, body: int) -> np.ndarray:
        """The end offset before record a (0 for the first) and those of records a to b."""
        base, name = (0, limits_name(self.name)) if self.separate else (body, self.name)
        with self.place.open(name) as f:
            low = max(a - 1, 0)
            raw = np.frombuffer(f.read_at(8 * (b - low), base + 8 * low), "<i8").astype(np.int64)
        return raw if a else np.append(0, raw)

    def stored(self, a: int, b: int, body: int) -> list[bytes]:
        """Records a to b as they are stored."""
        ends = self.ends(a, b, body)
        with self.place.open(self.name) as f:
            raw = f.read_at(int(ends[-1] - ends[0]), int(ends[0]))
        return [raw[x - ends[0] : y - ends[0]] for x, y in zip(ends[:-1], ends[1:])]

    def records(self, a: int, b: int, body: int) -> list[bytes]:
        unpack = zstandard.ZstdDecompressor()
        return [r if self.plain or not r else unpack.decompressobj().decompress(r) for r in self.stored(a, b, body)]


@dataclass
class Range(ds.InputPartition):
    """Records first to last of a file; start is the file's first index over all files."""

    name: str
    first: int
    last: int
    start: int
    body: int


class _Reader(ds.DataSourceReader):
    def __init__(self, options):
        self.place, self.separate = Place(told_path(options)), options.get("limits", "inside") == "separate"
        self.names = [n for p in options["path"].split(",") for n in shard_names(p)]
        self.step, self.threads = int(options.get("rows_per_task", 100_000)), int(options.get("threads", 16))
        self.bounds, self.first = {"idx": (0, 1 << 62), "global_idx": (0, 1 << 62)}, int(options.get("first", 0))

    def pushFilters(self, filters):
        """Bounds of idx and global_idx are taken; what is only partly met by a range is left to Spark, too."""
        for f in filters:
            column, value = (f.attribute[0] if getattr(f, "attribute", None) else None), getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            if column in self.bounds and whole and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
                low, high = self.bounds[column]
                if isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual, ds.GreaterThan)):
                    low = max(low, value + isinstance(f, ds.GreaterThan))
                if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual, ds.LessThan)):
                    high = min(high, value + (not isinstance(f, ds.LessThan)))
                self.bounds[column] = low, high
            else:
                if column in self.bounds and isinstance(f, ds.In) and f.value and all(isinstance(v, int) for v in f.value):
                    low, high = self.bounds[column]
                    self.bounds[column] = max(low, min(f.value)), min(high, max(f.value) + 1)
                yield f

    def layouts(self) -> list[tuple[int, int]]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda n: RecordFile(self.place, n, self.separate).layout(), self.names))

    def partitions(self):
        out, start = [], self.first
        for name, (body, n) in zip(self.names, self.layouts()):
            (low, high), (glow, ghigh) = self.bounds["idx"], self.bounds["global_idx"]
            first, last = max(low, glow - start), min(n, high, ghigh - start)
            out += [Range(name, a, min(a + self.step, last), start, body) for a in range(first, last, self.step)]
            start += n
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, partition):
        file = RecordFile(self.place, partition.name, self.separate)
        for a in range(partition.first, partition.last, BATCH):
            b = min(a + BATCH, partition.last)
            idx = np.arange(a, b)
            arrays = [pa.array([partition.name] * (b - a)), pa.array(idx), pa.array(idx + partition.start), pa.array(file.records(a, b, partition.body), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["source_file", "idx", "global_idx", "record"])


@dataclass
class _Written(ds.WriterCommitMessage):
    partition: int
    name: str


def _count_name(path: str, run: str) -> str:
    return f"{path.rsplit('/', 1)[0]}/_count-{run}"


class _Writer(ds.DataSourceArrowWriter):
    """A task streams its records into a file of its own; offsets are all that it holds. Files get their names when all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.place, self.separate, self.overwrite = Place(told_path(options)), options.get("limits", "inside") == "separate", overwrite
        self.path, self.run, self.told = options["path"], options.get("run") or uuid.uuid4().hex, options.get("run") is not None
        self.plain = self.path.endswith(".bag")
        if "@" not in self.path.rsplit("/", 1)[-1]:
            raise ValueError("the last part of the path names the shards: name@.bagz")

    def _own(self, partition: int) -> str:
        folder, name = self.path.rsplit("/", 1)
        return f"{folder}/_run-{self.run}/{partition:06d}-{uuid.uuid4().hex}{'.bag' if self.plain else '.bagz'}"

    def write(self, iterator):
        packer, own = zstandard.ZstdCompressor(), self._own(TaskContext.get().partitionId())
        ends, done = [np.zeros(0, "<i8")], 0
        try:
            with self.place.create(own) as out:
                for batch in iterator:
                    stored = [(r if self.plain else packer.compress(r)) if r else b"" for r in batch.column(batch.schema.get_field_index("record")).to_pylist()]
                    out.write(b"".join(stored))
                    ends.append(done + np.cumsum([len(r) for r in stored], dtype="<i8") if stored else ends[0])
                    done = int(ends[-1][-1]) if len(ends[-1]) else done
                if not self.separate:
                    for e in ends:
                        out.write(e.astype("<i8").tobytes())
            if self.separate:
                with self.place.create(limits_name(own)) as out:
                    for e in ends:
                        out.write(e.astype("<i8").tobytes())
        except BaseException:
            self._drop(own)
            raise
        return _Written(TaskContext.get().partitionId(), own)

    def _drop(self, name: str) -> None:
        for n in (name, limits_name(name)):
            self.place.remove(n)

    def _clear(self) -> None:
        files, folder = self.place.at(f"{self.path.rsplit('/', 1)[0]}/_run-{self.run}")
        try:
            files.delete_dir(folder)
        except FileNotFoundError:
            pass

    def commit(self, messages):
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        names = shard_names(re.sub(r"@\d*", f"@{len(done)}", self.path))
        if not self.overwrite and any(self.place.exists(n) for n in names):
            self.abort(messages)
            raise FileExistsError(f"{self.path} has files; overwrite them or name others")
        for m, name in zip(done, names):
            if self.separate:
                self.place.move(limits_name(m.name), limits_name(name))
            self.place.move(m.name, name)
        self._clear()
        if self.told:
            with self.place.create(_count_name(self.path, self.run)) as out:
                out.write(str(len(done)).encode())

    def abort(self, messages):
        for m in messages:
            if m is not None:
                self._drop(m.name)
        self._clear()


class RecordFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)

    def streamReader(self, schema):
        from .arrivals import Arrivals

        class Stream(Arrivals):
            """Record files that arrive; global_idx is that of a record in its file, as files are in no order."""

            suffixes = (".bag", ".bagz")

            def __init__(self, options):
                super().__init__(options)
                self.reader = _Reader(options | {"path": ""})

            def parts(self, name):
                if name.rsplit("/", 1)[-1].startswith("limits."):
                    return []
                self.reader.names = [name]
                return [p for p in self.reader.partitions() if p.name]

            def rows(self, partition):
                return self.reader.read(partition)

        return Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters on idx and global_idx into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordFiles)


def _options(spark: SparkSession, options: dict) -> dict:
    options = {"shared_path": session_path(spark)} | options
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}


def reached(spark: SparkSession, names: list[str], threads: int = 16) -> bool:
    """Whether all these are files that can be read by ranges: of a store that Arrow reaches, or below a path that all machines share."""
    place = Place(session_path(spark))
    try:
        with ThreadPoolExecutor(threads) as pool:
            return all(pool.map(lambda n: "," not in n and place.exists(n), names))
    except (ValueError, OSError, NotImplementedError):  # what Arrow says of other stores, and Place of other paths
        return False


def read_files(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """source_file, idx, global_idx (over all files, in the order named) and record. A path may name shards as `name@N`."""
    register(spark)
    return spark.read.format(FORMAT).options(**_options(spark, options)).load(",".join(paths))


def read_sets(spark: SparkSession, sets: list[tuple[str, str]], **options) -> DataFrame:
    """Several sets of files, (path, limits) each, under one index: dataset (from 0), source_file, idx, global_idx (over all sets, one after the other) and record.

    Sets are counted by their files' sizes, so each record is read once, and neither joined nor moved to be numbered."""
    parts, first = [], 0
    for k, (path, limits) in enumerate(sets):
        own = options | {"limits": limits, "first": first}
        parts.append(read_files(spark, path, **own).select(F.lit(k).alias("dataset"), "*"))
        first += sum(n for _, n in _Reader({"path": path} | _options(spark, own)).layouts())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Records of files that arrive in a folder."""
    register(spark)
    return spark.readStream.format(FORMAT).options(**_options(spark, options)).load(folder)


def write_files(df: DataFrame, path: str, *, record: str = "record", order: list | None = None, shards: int | None = None, overwrite: bool = False, **options) -> str:
    """One file a partition, or `shards` files by ranges of `order`; `path` has a `@` for the shards in its last part. Gives the path with their number.

    Ask for files by the path that is given: few rows or equal ones make fewer ranges than asked for.
    No task holds more than a batch of records and its offsets, and files appear only once all tasks are done."""
    register(df.sparkSession)
    rows = df.repartitionByRange(shards, *order).sortWithinPartitions(*order) if order and shards else df.repartition(shards) if shards else df
    rows = rows.select(F.col(record).cast("binary").alias("record"))
    given = _options(df.sparkSession, options | {"run": uuid.uuid4().hex})
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").options(**given).save(path)
    place, count = Place(told_path(given)), _count_name(path, given["run"])
    with place.open(count) as f:
        n = int(f.read())
    place.remove(count)
    return re.sub(r"@\d*", f"@{n}", path)


def file_index(spark: SparkSession, *paths: str, limits: str = "inside", shared_path: bool | str | None = None) -> DataFrame:
    """source_file, n, body (bytes of its records), first and last (of its global indices, the last one excluded). No record is read."""
    place = Place(session_path(spark) if shared_path is None else shared_path)
    names = [n for p in paths for n in shard_names(p)]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [RecordFile(place, n, limits == "separate").layout() for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int64()), pa.array([b for b, _ in found], pa.int64())], names=["no", "source_file", "n", "body"])

    listed = spark.createDataFrame(list(enumerate(names)), "no long, source_file string").repartition(min(len(names), 1000))
    from ..operators.ordered import running_total

    counted = running_total(listed.mapInArrow(sizes, "no long, source_file string, n long, body long"), ["no"], F.col("n"), "first")
    return counted.select("source_file", "n", "body", "first", (F.col("first") + F.col("n")).alias("last"))


def look_up(wanted: DataFrame, index: DataFrame, *, column: str = "global_idx", limits: str = "inside", shared_path: bool | str | None = None) -> DataFrame:
    """`wanted` with source_file, idx and record: each index meets its file in an interval join, and a task reads the records of a file in order.

    Indices that no file holds have no row. Neighbouring records are read together."""
    spark = wanted.sparkSession
    place = Place(session_path(spark) if shared_path is None else shared_path)
    placed = in_intervals(wanted, column, index.filter("n > 0").select("first", "last", "source_file", "body"), "first", "last").filter("source_file is not null")
    rows = placed.select(*wanted.columns, "source_file", (F.col(column) - F.col("first")).alias("idx"), "body")
    dealt = rows.repartition("source_file", F.floor(F.col("idx") / 100_000)).sortWithinPartitions("source_file", "idx")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, idx, bodies = batch.column("source_file").to_pylist(), np.asarray(batch.column("idx")), batch.column("body").to_pylist()
            found, at = [], 0
            while at < len(names):
                to = at + 1
                while to < len(names) and to - at < 4096 and names[to] == names[at] and idx[to] - idx[to - 1] <= 1:
                    to += 1
                run = RecordFile(place, names[at], limits == "separate").records(int(idx[at]), int(idx[to - 1]) + 1, bodies[at])
                found += [run[i - idx[at]] for i in idx[at:to].tolist()]
                at = to
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["body"]).columns, pa.array(found, pa.binary())], names=[*[c for c in batch.schema.names if c != "body"], "record"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.drop("body").schema)
    return dealt.mapInArrow(read, f"{schema}, record binary")


def merge_files(spark: SparkSession, sources: list[str], target: str, *, limits: str = "inside", shared_path: bool | str | None = None) -> DataFrame:
    """Joins files to `target` (one file, or `name@N`: runs of whole files, as many each), and tells what each new file holds.

    Nothing is decoded: bodies are copied in pieces and offsets are raised by the bytes that lie before. A task writes one new file
    under a name of its own and renames it when it is whole. Sources and targets are all plain or all compressed."""
    place, separate = Place(session_path(spark) if shared_path is None else shared_path), limits == "separate"
    names, targets = [n for s in sources for n in shard_names(s)], shard_names(target)
    if len({n.endswith(".bag") for n in [*names, *targets]}) != 1:
        raise ValueError("plain and compressed files can't be joined without decoding them")
    size, longer = divmod(len(names), len(targets))
    cuts = np.cumsum([0, *[size + (k < longer) for k in range(len(targets))]]).tolist()
    plan = spark.createDataFrame([(t, names[a:b]) for t, a, b in zip(targets, cuts, cuts[1:])], "target string, files array<string>").repartition(len(targets), "target")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for new, files in zip(*(c.to_pylist() for c in batch.columns)):
                own = f"{new}.{uuid.uuid4().hex}{'.bag' if new.endswith('.bag') else '.bagz'}"
                try:
                    yield _merged(new, own, files)
                except BaseException:
                    place.remove(own)
                    place.remove(limits_name(own))
                    raise

    def _merged(new: str, own: str, files: list[str]) -> pa.RecordBatch:
        layouts, start = [RecordFile(place, f, separate).layout() for f in files], 0
        with place.create(own) as out:
            for f, (body, _) in zip(files, layouts):
                with place.open(f) as source:
                    for at in range(0, body, _CHUNK):
                        out.write(source.read_at(min(_CHUNK, body - at), at))
            with place.create(limits_name(own)) if separate else _same(out) as ends:
                for f, (body, n) in zip(files, layouts):
                    for a in range(0, n, _CHUNK // 8):
                        b = min(n, a + _CHUNK // 8)
                        ends.write((RecordFile(place, f, separate).ends(a, b, body)[1:] + start).astype("<i8").tobytes())
                    start += body
        if separate:
            place.move(limits_name(own), limits_name(new))
        place.move(own, new)
        return pa.RecordBatch.from_arrays([pa.array([new]), pa.array([len(files)], pa.int32()), pa.array([sum(n for _, n in layouts)]), pa.array([start])], names=["target", "files", "records", "bytes"])

    done = plan.mapInArrow(join, _MERGED).collect()  # a row a new file
    return spark.createDataFrame([tuple(r) for r in sorted(done)], _MERGED)


class _same:
    """The same stream once more, left open."""

    def __init__(self, stream):
        self.stream = stream

    def __enter__(self):
        return self.stream

    def __exit__(self, *_):
        return False
