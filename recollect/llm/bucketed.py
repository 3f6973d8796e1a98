"""A pair of tables in buckets by one key: each bucket of a table is one sorted file, so that the two join file by file.

write() is the general operator. Rows become byte strings that sort as the rows do: the
number of the file, then every column in its order. An RDD with a partitioner of its
own (a file's rows go to the partition of its number) sorts them on the way by
repartitionAndSortWithinPartitions, which spills; the sorted strings stream back into
columns and into one Parquet writer a file. So a task holds some ten thousand rows of
columns, however many a file has, and a file is written by one task. A task writes
under a name of its own and reports it when it is done; what tasks that failed have
left is removed, so lost executors and attempts that run twice do no harm.

op11_cobucketed_pair writes sales and lines into files by other rules first, then
buckets them where they lie. A starting file that already holds exactly a bucket's rows
stays as it is and is not read again. The digests it returns are read back from the
files, bucket by bucket, both tables' files of a bucket side by side.

Sort order: the key descending, the other columns ascending, nulls first, strings by
their UTF-8 bytes, NaN above all numbers, 0.0 and -0.0 alike.

Edge cases: equal rows are all kept; null keys have a bucket; sales with a null sale_id
lie in bucket 151, as null lines do; of several sales of one sale_id each is a row, and
n_joined counts their products; strings with NUL characters, empty and very long ones
are kept as they are; empty tables give no files and no rows; extra columns are columns
like others, whatever their names. Columns may be integers, doubles, floats, booleans,
strings, binaries, dates and timestamps; others are refused.

The folder must be of a file system that pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, shared_folder, small_batches

BUCKETS = 150
#: Rows that become columns at once, and rows of a row group.
CHUNK, GROUP = 16_384, 131_072
#: Column types and their bytes as sortable unsigned integers; strings and binaries have no fixed width.
WIDTHS = {pa.bool_(): 1, pa.int8(): 1, pa.int16(): 2, pa.int32(): 4, pa.int64(): 8, pa.float32(): 4, pa.float64(): 8, pa.date32(): 4}


def width(kind: pa.DataType) -> int:
    """Bytes of a column in a row's string; 0 for strings and binaries."""
    if pa.types.is_timestamp(kind):
        return 8
    if kind in (pa.string(), pa.binary()):
        return 0
    if kind not in WIDTHS:
        raise TypeError(f"no order for columns of {kind}")
    return WIDTHS[kind]


def ordered(column: pa.Array, kind: pa.DataType, down: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """A fixed column's flag and value as rows of bytes that sort as it does, nulls first; and where a double is -0.0."""
    w, minus = width(kind), None
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(kind):
        x = column.fill_null(0).to_numpy(zero_copy_only=False)
        minus = (x == 0) & np.signbit(x)
        x = np.where(np.isnan(x), np.array(np.nan, x.dtype), np.where(x == 0, np.array(0, x.dtype), x))
        bits = x.view(f"u{w}")
        top = np.array(1 << (8 * w - 1), bits.dtype)
        bits = np.where(bits & top, ~bits, bits | top)
    elif kind == pa.bool_():
        bits = column.fill_null(False).to_numpy(zero_copy_only=False).astype("u1")
    else:
        x = column.cast(pa.int64() if w == 8 else pa.int32()).fill_null(0).to_numpy(zero_copy_only=False) if w >= 4 else column.fill_null(0).to_numpy(zero_copy_only=False)
        bits = x.astype(f"i{w}").view(f"u{w}") ^ np.array(1 << (8 * w - 1), f"u{w}")
    bits = np.where(null, np.array(0, bits.dtype), ~bits if down else bits)
    return np.concatenate([(~null).astype("u1")[:, None], bits.astype(f">u{w}")[:, None].view("u1").reshape(len(bits), w)], 1), minus


def restored(raw: np.ndarray, kind: pa.DataType, down: bool, minus: np.ndarray | None) -> pa.Array:
    """The column that ordered() gave."""
    w = width(kind)
    null = raw[:, 0] == 0
    bits = np.ascontiguousarray(raw[:, 1:]).view(f">u{w}").ravel().astype(f"u{w}")
    bits = ~bits if down else bits
    top = np.array(1 << (8 * w - 1), bits.dtype)
    if pa.types.is_floating(kind):
        x = np.where(bits & top, bits ^ top, ~bits).view(f"f{w}")
        return pa.array(np.where(minus, -x, x) if minus is not None and minus.any() else x, kind, mask=null)
    if kind == pa.bool_():
        return pa.array(bits.astype(bool), kind, mask=null)
    return pa.array((bits ^ top).view(f"i{w}"), pa.int32() if w == 4 else pa.int64() if w == 8 else kind, mask=null).cast(kind)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of length each, one run after the other."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


def strings(number: pa.Array, row: list[pa.Array], schema: pa.Schema, down: str | None) -> list[bytes]:
    """Each row as bytes that sort as (file's number, columns) do.

    A string has its bytes, NUL as NUL FF, and NUL behind it; behind all columns stand
    each string's length (4 bytes) and each float's sign of zero (1 byte).
    """
    n = len(number)
    parts, tail = [number.to_numpy().astype(">u2")[:, None].view("u1").reshape(n, 2)], []
    for field, column in zip(schema, row, strict=True):
        if width(field.type):
            fixed, minus = ordered(column, field.type, field.name == down)
            parts.append(fixed)
            if minus is not None:
                tail.append(minus.astype("u1")[:, None])
            continue
        values = [None if x is None else x.replace(b"\0", b"\0\xff") for x in column.cast(pa.binary()).to_pylist()]
        length = np.array([len(x or b"") for x in values], np.int64)
        parts.append((np.array([x is not None for x in values], "u1"), np.frombuffer(b"".join(x or b"" for x in values), "u1"), length))
        tail.append(length.astype(">u4")[:, None].view("u1").reshape(n, 4))
    parts += [np.zeros((n, 1), "u1"), *tail]
    sizes = [np.full(n, p.shape[1]) if isinstance(p, np.ndarray) else p[2] + 2 for p in parts]
    whole = np.sum(sizes, 0)
    begin = np.cumsum(whole) - whole
    out, at = np.zeros(int(whole.sum()), "u1"), begin.copy()
    for p, size in zip(parts, sizes, strict=True):
        if isinstance(p, np.ndarray):
            out[at[:, None] + np.arange(p.shape[1])] = p
        else:
            out[at] = p[0]
            out[ragged(at + 1, p[2])] = p[1]
        at = at + size
    data = out.tobytes()
    return [data[a:b] for a, b in zip(begin.tolist(), (begin + whole).tolist(), strict=True)]


def columns(rows: list[bytes], schema: pa.Schema, down: str | None) -> pa.RecordBatch:
    """The rows that strings() gave."""
    n, data = len(rows), np.frombuffer(b"".join(rows), "u1")
    whole = np.fromiter(map(len, rows), np.int64, n)
    end = np.cumsum(whole)
    tails = [4 if not width(f.type) else 1 if pa.types.is_floating(f.type) else 0 for f in schema]
    tail_at = end - sum(tails)
    at, out = end - whole + 2, []
    for field, t in zip(schema, tails, strict=True):
        extra = data[tail_at[:, None] + np.arange(t)] if t else None
        tail_at = tail_at + t
        w = width(field.type)
        if w:
            out.append(restored(data[at[:, None] + np.arange(w + 1)], field.type, field.name == down, extra.ravel().astype(bool) if t else None))
            at = at + w + 1
            continue
        length = np.ascontiguousarray(extra).view(">u4").ravel().astype(np.int64)
        body, null = data[ragged(at + 1, length)].tobytes(), data[at] == 0
        if b"\0" in body:
            ends = np.cumsum(length).tolist()
            out.append(pa.array([None if x else body[a:b].replace(b"\0\xff", b"\0") for x, a, b in zip(null, [0, *ends], ends, strict=False)], pa.binary()).cast(field.type))
        else:
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
            out.append(pa.Array.from_buffers(field.type, n, [valid, offsets, pa.py_buffer(body)]))
        at = at + length + 2
    return pa.RecordBatch.from_arrays(out, schema=schema)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, by URI or plain path, and the path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def rows_of(table: DataFrame, *more: Column) -> DataFrame:
    """(row, ...): each row of table as one struct, whatever its columns' names are."""
    return table.select(F.struct("*").alias("row"), *more)


def write(rows: DataFrame, number: Column, files: int, folder: str, name: str, down: str | None = None) -> list[tuple[int, str, int]]:
    """Writes the structs row into folder, one Parquet file for each number (0 up to files) that has rows, sorted by all columns, down descending: (number, path, rows) of each file."""
    schema = to_arrow_schema(rows.select("row.*").schema)
    for f in schema:
        width(f.type)
    small_batches(rows.sparkSession, CHUNK)
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = strings(b.column(0), b.column(1).flatten(), schema, down)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(keys)], pa.binary()), pa.array([np.fromiter(map(len, keys), "u4", len(keys)).tobytes()], pa.binary())], names=["keys", "sizes"])

    def unpacked(r) -> Iterator[tuple[bytes, None]]:
        ends = np.cumsum(np.frombuffer(r[1], "u4"), dtype=np.int64).tolist()
        data = bytes(r[0])
        return ((data[a:b], None) for a, b in zip([0, *ends], ends, strict=False))

    def written(pairs: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, str, int]]:
        fs, path = opened(folder)
        keys = (k for k, _ in pairs)
        for number, own in groupby(keys, key=lambda k: k[:2]):
            file = f"{name}-{int.from_bytes(number, 'big'):05d}-{uuid.uuid4().hex}.parquet"
            held, total = [], 0
            with pq.ParquetWriter(f"{path}/{file}", schema, filesystem=fs) as writer:
                while chunk := list(islice(own, CHUNK)):
                    held.append(columns(chunk, schema, down))
                    total += len(chunk)
                    if len(held) * CHUNK >= GROUP:
                        writer.write_table(pa.Table.from_batches(held), row_group_size=GROUP)
                        held = []
                if held:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=GROUP)
            yield int.from_bytes(number, "big"), file, total

    keyed = rows.select(number.cast("int").alias("number"), "row").mapInArrow(packed, "keys binary, sizes binary").rdd.flatMap(unpacked)
    done = keyed.repartitionAndSortWithinPartitions(files, partitionFunc=lambda k: (k[0] << 8) | k[1]).mapPartitions(written).collect()  # a row a file
    kept = {file for _, file, _ in done}
    for left in fs.get_file_info(pafs.FileSelector(path)):
        if left.base_name.startswith(f"{name}-") and left.base_name not in kept:
            fs.delete_file(left.path)
    return sorted((number, f"{folder}/{file}", total) for number, file, total in done)


def crc(*parts: Column) -> Column:
    return F.pmod(F.crc32(F.concat(*parts).cast("binary")), F.lit(BUCKETS)).cast("int")


def bucket_of(key: Column) -> Column:
    """The bucket of a key that has one of its own."""
    return F.when(key.isNull(), BUCKETS + 1).otherwise(crc(F.lit("pair"), key.cast("string")))


def rebucketed(spark: SparkSession, starts: list[tuple[int, str, int]], bucketed: Callable[[DataFrame], DataFrame], folder: str, key: str) -> list[dict]:
    """Deals the starting files (number, path, rows) of a table into buckets, by bucketed, which adds bucket to rows: bucket, path, n_rows, rewritten and lineage ((start, rows), ...) of every file there is then."""
    if not starts:
        return []
    number = F.split(F.element_at(F.split("_metadata.file_path", "/"), -1), "-")[1].cast("int").alias("number")
    held = bucketed(rows_of(spark.read.parquet(*(path for _, path, _ in starts)), number)).groupBy("number", "bucket").count()
    lineage: dict[int, dict[int, int]] = {}
    for r in held.collect():  # a row for each starting file and bucket at most
        lineage.setdefault(r["bucket"], {})[r["number"]] = r["count"]
    total = {number: n for number, _, n in starts}
    stays = {s: b for b, of in lineage.items() for s, n in of.items() if len(of) == 1 and total[s] == n}
    out = [{"bucket": stays[s], "path": path, "n_rows": n, "rewritten": False} for s, path, n in starts if s in stays]
    moved = [path for s, path, _ in starts if s not in stays]
    if moved:
        rows = bucketed(rows_of(spark.read.parquet(*moved)))
        out += [{"bucket": b, "path": path, "n_rows": n, "rewritten": True} for b, path, n in write(rows, F.col("bucket"), BUCKETS + 2, folder, "bucket", key)]
        for path in moved:
            fs, at = opened(path)
            fs.delete_file(at)
    return [r | {"lineage": sorted(lineage[r["bucket"]].items())} for r in out]


def cobucketed(sales: DataFrame, lines: DataFrame, folder: str) -> dict[str, list[dict]]:
    """Both tables in folder, first in their starting files, then in buckets by sale_id: the final files of each (see rebucketed)."""
    spark = sales.sparkSession
    b = bucket_of(F.col("row.sale_id"))
    item = F.col("row.item_id")
    first = {
        "sales": write(rows_of(sales), F.when(b % 5 == 1, b - 1).otherwise(b), BUCKETS + 2, f"{folder}/sales", "start", "sale_id"),
        "sale_lines": write(rows_of(lines), F.when(item.isNull(), 0).otherwise(crc(item.cast("string"))), BUCKETS, f"{folder}/sale_lines", "start", "sale_id"),
    }
    # a shuffle by the key, as the number of sales has no bound; nothing but that shuffle below the join, so that a key with very many lines is split
    known = checkpointed(sales.select(F.col("sale_id").alias("known")).where("known is not null").distinct()).hint("merge")

    def lines_bucketed(rows: DataFrame) -> DataFrame:
        own = F.when(F.col("row.sale_id").isNotNull() & F.col("known").isNull(), BUCKETS).otherwise(b)
        return rows.join(known, F.col("row.sale_id") == F.col("known"), "left").withColumn("bucket", own).drop("known")

    return {
        "sales": rebucketed(spark, first["sales"], lambda rows: rows.withColumn("bucket", b), f"{folder}/sales", "sale_id"),
        "sale_lines": rebucketed(spark, first["sale_lines"], lines_bucketed, f"{folder}/sale_lines", "sale_id"),
    }


def keys_in(path: str, key: str) -> Iterator[pa.Array]:
    """The key column of a file, some rows at a time."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        for b in pq.ParquetFile(f).iter_batches(CHUNK, columns=[key]):
            yield b.column(0)


def runs(path: str, key: str) -> Iterator[tuple[int, int]]:
    """(key, rows) of a file that is sorted by it, null keys left out."""
    last, n = None, 0
    for keys in keys_in(path, key):
        x = keys.drop_null().to_numpy(zero_copy_only=False)
        if not len(x):
            continue
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        for k, count in zip(x[at].tolist(), np.diff([*at, len(x)]).tolist(), strict=True):
            if k != last:
                if n:
                    yield last, n
                last, n = k, 0
            n += count
    if n:
        yield last, n


def joined(left: str, right: str, key: str) -> int:
    """Rows of the inner join of two files that are sorted by the key, descending: one pass over both, without a shuffle."""
    total, other = 0, runs(right, key)
    k, n = next(other, (None, 0))
    for own, count in runs(left, key):
        while k is not None and k > own:
            k, n = next(other, (None, 0))
        if k is None:
            break
        total += count * n if k == own else 0
    return total


def digest(path: str, key: str) -> str:
    """sha256 of the keys of a file in its order: decimal, null empty, comma-joined."""
    h, comma = hashlib.sha256(), b""
    for keys in keys_in(path, key):
        h.update(comma + b",".join((x or "").encode() for x in keys.cast(pa.string()).to_pylist()))
        comma = b","
    return h.hexdigest()


RESULT = "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean"


def op11_cobucketed_pair(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each final file: table_name, path, columns, ids_sha256, lineage_sha256, bucket, n_rows, n_joined, rewritten."""
    spark = sales.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", "") or shared_folder(spark)
    files = cobucketed(sales, lines, f"{base.rstrip('/')}/pair-{uuid.uuid4().hex}")
    names = {"sales": ",".join(sales.columns), "sale_lines": ",".join(lines.columns)}
    pairs: dict[int, list] = {}
    for table, own in files.items():
        for r in own:
            lineage = hashlib.sha256(",".join(f"{s}:{n}" for s, n in r["lineage"]).encode()).hexdigest()
            pairs.setdefault(r["bucket"], []).append((table, r["path"], names[table], lineage, r["n_rows"], r["rewritten"]))

    def described(pair) -> Iterator[tuple]:
        bucket, own = pair
        n = joined(own[0][1], own[1][1], "sale_id") if len(own) == 2 else 0
        for table, path, columns_, lineage, rows, rewritten in own:
            yield table, path, columns_, digest(path, "sale_id"), lineage, bucket, rows, n, rewritten

    found = spark.sparkContext.parallelize(sorted(pairs.items()), max(1, len(pairs))).flatMap(described)  # a row a bucket
    return spark.createDataFrame(found, RESULT)
