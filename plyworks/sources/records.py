"""Indexed record files (zstd records, then little-endian end offsets) and JSON-lines tables.

Files are read by ranges of their records; a file is the unit of work where it is written, so large sets are kept in shards (`name@N`).
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records that a task decodes at a time.
BATCH = 4096


def _ends(data: bytes, limits: bytes | None = None) -> np.ndarray:
    """Where the records of a file end. Its last 8 bytes name where these offsets start, unless `limits` holds them."""
    if limits is None:
        limits = data[struct.unpack("<q", data[-8:])[0] :] if len(data) else b""
    return np.frombuffer(limits, "<i8")


def decode_records(data: bytes, limits: bytes | None = None, compressed: bool = True) -> list[bytes]:
    """Records of one file. The last 8 bytes name where the offsets start, unless `limits` holds them."""
    ends = _ends(data, limits).tolist()
    unpack = zstandard.ZstdDecompressor()
    one = (lambda r: unpack.decompressobj().decompress(r)) if compressed else bytes
    return [one(data[a:b]) if b > a else b"" for a, b in zip([0, *ends], ends)]


def encode_records(records: list[bytes], compressed: bool = True) -> bytes:
    """One file of the records: its end offsets follow; an empty list is an empty file. The last offset is where they start."""
    packer, body, ends = zstandard.ZstdCompressor(), bytearray(), []
    for r in records:
        body += (packer.compress(r) if compressed else r) if r else b""
        ends.append(len(body))
    return bytes(body) + struct.pack(f"<{len(ends)}q", *ends)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source_file, idx and record of files that came whole (source_file, content, limits), some records at a time."""
    for batch in batches:
        for name, content, limits in zip(*batch.columns):
            name, data = name.as_py(), memoryview(content.as_buffer())
            ends = _ends(data, memoryview(limits.as_buffer()) if limits.is_valid else None)
            for a in range(0, len(ends), BATCH):
                some, begin = ends[a : a + BATCH], ends[a - 1] if a else 0
                records = decode_records(data[begin : some[-1]], (some - begin).tobytes(), not name.endswith(".bag"))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(np.arange(a, a + len(some))), pa.array(records, pa.binary())], names=["source_file", "idx", "record"])


def shard_names(path: str) -> list[str]:
    """The files of `name@N`, in order; a path without `@N` is one file."""
    found = re.findall(r"@(\d+)", path)
    if len(found) != 1:
        return [path]
    return [re.sub(r"@\d+", f"-{k:05d}-of-{int(found[0]):05d}", path) for k in range(int(found[0]))]


def read_records(spark: SparkSession, path: str, *, separate_limits: bool = False) -> DataFrame:
    """source_file, idx (within the file), record. `path` may name shards as `name@N`.

    With `separate_limits` the offsets are read from a file of the same name with `limits.` in front. Files that end in
    .bag hold plain records, all others compressed ones. A task reads a range of a file's records (`record_files`); only files
    that Arrow doesn't reach, or that a folder or a pattern names, come whole, by Spark, each in one task.
    """
    from . import record_files

    names = shard_names(path)
    if record_files.reached(spark, names):
        return record_files.read_files(spark, path, limits="separate" if separate_limits else "inside").select("source_file", "idx", "record")
    name = F.element_at(F.split("path", "/"), -1)
    load = lambda paths: spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_file"), name.alias("__name"), "content")
    files = load(names)
    if separate_limits:
        beside = [re.sub(r"[^/]+$", lambda m: "limits." + m[0], n) for n in names]
        limits = load(beside).select(F.regexp_replace("__name", r"^limits\.", "").alias("__name"), F.col("content").alias("__limits"))
        files = files.join(limits, "__name")
    else:
        files = files.withColumn("__limits", F.lit(None).cast("binary"))
    return files.select("source_file", "content", "__limits").mapInArrow(_unpacked, "source_file string, idx long, record binary")


def _numbered(records: DataFrame, out: str, *keys: str) -> DataFrame:
    """Adds the index over all files, which follow each other by `keys`. One row per file is ordered in a single task and sent to all; records stay where they are."""
    sizes = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return records.join(F.broadcast(starts), [*keys]).withColumn(out, F.col("__start") + F.col("idx")).drop("__start")


def with_global_index(records: DataFrame, *, out: str = "global_idx") -> DataFrame:
    """Adds the index over all files, which follow each other by name. This reads all records once more to count them; `record_files` counts by offsets."""
    return _numbered(records, out, "source_file")


def concat_records(*parts: DataFrame) -> DataFrame:
    """One set of several: dataset (from 0), source_file, idx and an index over all of them, data set by data set. See `record_files.read_sets`, too."""
    rows = parts[0].withColumn("dataset", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("dataset", F.lit(k)))
    return _numbered(rows, "global_idx", "dataset", "source_file")


def record_at(records: DataFrame, index: int, column: str = "global_idx") -> DataFrame:
    return records.filter(F.col(column) == index)


def dump_records(records: DataFrame, start: int, limit: int, *, column: str = "global_idx", as_hex: bool = False) -> DataFrame:
    """Records from `start` on, `limit` of them, as text or in hexadecimal."""
    shown = F.hex("record") if as_hex else F.decode("record", "UTF-8")
    return records.filter((F.col(column) >= start) & (F.col(column) < start + limit)).select(column, shown.alias("record"))


def empty_records(records: DataFrame, most: int = 10, *, column: str = "global_idx") -> DataFrame:
    """Indices of the first empty records."""
    return records.filter(F.octet_length("record") == 0).select(column).orderBy(column).limit(most)


def json_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as one record of compact JSON, in UTF-8."""
    return df.withColumn(out, F.encode(F.to_json(F.struct(*df.columns)), "UTF-8"))


def parsed_records(records: DataFrame, schema: str) -> DataFrame:
    """The columns of JSON records; what can't be read is null."""
    return records.select(*[c for c in records.columns if c != "record"], F.from_json(F.decode("record", "UTF-8"), schema).alias("r")).select("*", "r.*").drop("r")


def pack_shards(df: DataFrame, record: str, order: str, shards: int, *, compressed: bool = True) -> DataFrame:
    """shard, content: the bytes of each of `shards` record files, rows dealt by a hash of `order` and kept in its order."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        content = encode_records([bytes(r) for r in rows.sort_values("order")["record"]], compressed)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "content": [content]})

    rows = df.select(F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("shard"), F.col(order).alias("order"), F.col(record).alias("record"))
    return rows.groupBy("shard").applyInPandas(one, "shard int, content binary")


def write_records(df: DataFrame, record: str, order: str, path: str, shards: int) -> list[str]:
    """Write `shards` files under `path`, a URI of a store that all executors reach, with `@N` in its name; gives the files' names.

    A task writes under a name of its own and then renames, so one that runs twice leaves one file. A shard is held in
    memory by its task: choose `shards` by the size of the data. A shard without rows is an empty file.
    """
    _shared(df.sparkSession, path)
    names = shard_names(f"{path}" if "@" in path else f"{path}@{shards}")
    if len(names) != shards:
        raise ValueError("the path names another number of shards")
    plain = path.endswith(".bag")
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    packed = every.join(pack_shards(df, record, order, shards, compressed=not plain), "shard", "left")

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            for shard, content in zip(part["shard"], part["content"]):
                target = names[int(shard)]
                files, place = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
                files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                own = f"{place}.{uuid.uuid4().hex}"
                with files.open_output_stream(own) as out:
                    out.write(b"" if content is None else content)
                files.move(own, place)
                yield pd.DataFrame({"name": [target]})

    return sorted(r["name"] for r in packed.mapInPandas(store, "name string").collect())


def moves_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row per line: fen, moves (map), `reason` (null, or what is wrong with the line) and `line`, the text of one that is no JSON. Spark reads .gz itself."""
    rows = spark.read.schema("fen string, moves map<string,bigint>, line string").option("columnNameOfCorruptRecord", "line").json(path)
    return rows.withColumn("reason", F.when(F.col("line").isNotNull(), "no JSON of this kind").when(F.col("fen").isNull(), "no position").when(F.col("moves").isNull(), "no moves"))


def read_moves_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """fen, moves (map); malformed lines are left out (`moves_errors` counts them)."""
    return moves_lines(spark, path).filter("line is null and fen is not null").select("fen", "moves")


def moves_errors(spark: SparkSession, path: str, examples: int = 3) -> DataFrame:
    """reason, lines (how many) and the first few of them by their text."""
    bad = moves_lines(spark, path).filter("reason is not null").select("reason", F.coalesce("line", "fen", F.lit("")).alias("line"))
    first = bad.withColumn("__n", F.row_number().over(Window.partitionBy("reason").orderBy("line"))).filter(F.col("__n") <= examples)
    shown = first.groupBy("reason").agg(F.array_sort(F.collect_list("line")).alias("examples"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")).join(shown, "reason")


def fixed_json_records(df: DataFrame, decimals: dict[str, int], out: str = "record") -> DataFrame:
    """Each row as compact JSON, where the numbers of `decimals` have so many places after the point, as files of records have them. Nulls are left out."""
    def field(name: str) -> Column:
        plain = F.to_json(F.struct(F.col(name).alias("v")))
        value = F.format_string(f"%.{decimals[name]}f", F.col(name).cast("double")) if name in decimals else F.substr(plain, F.lit(6), F.length(plain) - 6)
        return F.when(F.col(name).isNotNull(), F.concat(F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.lit(len(name) + 2)), F.lit(":"), value))

    return df.withColumn(out, F.encode(F.concat(F.lit("{"), F.concat_ws(",", *[field(c) for c in df.columns]), F.lit("}")), "UTF-8"))


#: What a bucket file holds, in JSON.
BUCKETS = (
    "boundaries array<double>, n_buckets int, scheme string, time_control string, statistics map<string,double>, bucket_probabilities array<double>, "
    "bucket_widths array<double>, bucket_empirical_distributions array<struct<type:string,distribution:map<string,double>,coverage:double>>"
)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Bucket files, a row each; an open last bound is infinite. `reason` says what is wrong with a file, null if nothing is."""
    df = spark.read.schema(BUCKETS).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    bounds = F.transform("boundaries", lambda b: F.coalesce(b, F.lit(float("inf"))))
    return df.withColumn("boundaries", bounds).withColumn("reason", bucket_reason())


def bucket_reason() -> Column:
    """The first rule that a bucket row breaks."""
    d, n = F.col("bucket_empirical_distributions"), F.col("n_buckets")
    bad = lambda test: F.exists(d, lambda x: F.coalesce(test(x), F.lit(True)))
    rules = [
        (F.col("boundaries").isNull() | n.isNull(), "no boundaries"), (F.size("boundaries") != n + 1, "boundaries don't fit the number of buckets"),
        (F.exists(F.sequence(F.lit(1), n), lambda i: F.get("boundaries", i) <= F.get("boundaries", i - 1)), "boundaries don't rise"),
        (d.isNull(), "no distributions"), (F.size(d) != n, "distributions don't fit the number of buckets"), (bad(lambda x: x["type"].isNull()), "a distribution has no type"),
        (bad(lambda x: ~x["type"].isin("seconds", "frequent_values")), "a distribution's type is unknown"), (bad(lambda x: F.size(x["distribution"]) < 1), "a distribution is empty"),
    ]
    out = F.lit(None).cast("string")
    for rule, reason in reversed(rules):
        out = F.when(rule, reason).otherwise(out)
    return out


def read_record_ranges(spark: SparkSession, path: str, *, rows_per_task: int = 100_000, wanted: tuple[int, int] | None = None) -> DataFrame:
    """source_file, idx, record: as `read_records`, but a task reads a range of a file's records, and of the file only these and their offsets.

    For files with their offsets at the end, at a path or URI that all executors reach. `wanted` names the first index and the one
    after the last, within each file, so a single record can be looked up.
    """
    _shared(spark, path)
    names = spark.createDataFrame([(n,) for n in shard_names(path)], "source_file string").repartition(len(shard_names(path)))

    def sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"source_file": part["source_file"], "n": [_offsets(n)[1] for n in part["source_file"]]})

    counted = names.mapInPandas(sizes, "source_file string, n long")
    low, high = wanted or (0, 1 << 62)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_per_task).cast("long")))
    ranges = counted.filter("n > 0").select("source_file", "n", first.alias("first"))
    ranges = ranges.select("source_file", F.greatest("first", F.lit(low).cast("long")).alias("first"), F.least(F.col("first") + rows_per_task, "n", F.lit(high).cast("long")).alias("last")).filter("first < last")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, a, b in zip(part["source_file"], part["first"], part["last"]):
                found = _range(name, int(a), int(b))
                yield pd.DataFrame({"source_file": name, "idx": range(int(a), int(b)), "record": found})

    return ranges.repartition("source_file", "first").mapInPandas(rows, "source_file string, idx long, record binary")


def _shared(spark: SparkSession, path: str) -> None:
    if "://" not in path and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} is a local path, which other machines don't see; name a store, or see record_files")


def _open(name: str):
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
    return files.open_input_file(place)


def _offsets(name: str) -> tuple[int, int]:
    """Where a file's offsets start, and how many records it has."""
    with _open(name) as f:
        if not f.size():
            return 0, 0
        start = struct.unpack("<q", f.read_at(8, f.size() - 8))[0]
        return start, (f.size() - start) // 8


def _range(name: str, a: int, b: int) -> list[bytes]:
    start, _ = _offsets(name)
    with _open(name) as f:
        ends = struct.unpack(f"<{b - a}q", f.read_at(8 * (b - a), start + 8 * a))
        begin = struct.unpack("<q", f.read_at(8, start + 8 * (a - 1)))[0] if a else 0
        body = f.read_at(ends[-1] - begin, begin)
    return decode_records(body, np.array([e - begin for e in ends], "<i8").tobytes(), not name.endswith(".bag"))
