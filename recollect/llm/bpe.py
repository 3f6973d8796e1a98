"""BPE encoding and decoding by way of a distinct-word table.

A word is a stretch of white space and what follows it: a text is cut before
each space that stands before something other than white space, and around
control strings. Byte-level BPE never merges across such a cut, so a text's ids
are its words' ids in a row.

1. split: Spark cuts the texts. In the same pass each block (some MB of text)
   becomes its distinct words, packed by hash bucket, and one compressed array
   with the number of the word at every position. Both leave in one shuffle, the
   words to their bucket, the positions to their block's place, where they stay.
2. encode: all rows of a bucket meet in one place, one after the other, so each
   distinct word of the corpus is encoded once, by the tokenizers library; the
   table of a bucket is dropped when the next one begins.
3. join back: a block's words go to its place with their ids and are cogrouped
   with the positions, which pick the ids.
4. decode: ids are joined with the id-to-piece table by id (one piece for each id
   of the vocabulary; a table of bounded size, so the join is a look-up in a
   broadcast array).

A block is named by partition and number. Documents from files come in the same
order whenever a task is run again; others go through a checkpoint first, so a
lost executor can't mix two orders. No group grows with the corpus: a word is in a
bucket once a block, and a bucket's rows stream by.

Edge cases: null text counts as empty, empty texts have no ids; the control
string of the vocabulary becomes its own id, as the library does; very long texts
are encoded whole, in a block of their own; repeated rows are encoded each; a null
doc_id stays null; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, small_batches, steady, tidied

#: Bytes of text and documents of a block.
BLOCK, BLOCK_ROWS = 12 << 20, 1 << 16
#: Documents that are joined with their ids at a time.
STRIDE = 256


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, opened when it is first used on a machine."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}

    def __getstate__(self):
        return {"path": self.path, "special": self.special, "tokenizer": None}

    def encode(self, words: list[str]) -> list[list[int]]:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> list[bytes]:
        """The id-to-piece table: the bytes that each id stands for."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = json.load(open(self.path, encoding="utf-8"))["model"]["vocab"]
        table = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in piece)
        for piece, i in self.special.items():
            table[i] = piece.encode()
        return table


def words_of(text: Column, special: tuple[str, ...] = ()) -> Column:
    """The words of a text in order; joined they are the text (an empty text is one empty word). Control strings stand alone."""
    cut = r"(?U)(?= \S)"
    if not special:
        return F.split(text, cut, -1)
    any_of = "(?:" + "|".join(re.sub(r"([^\w])", r"\\\1", x) for x in special) + ")"
    with_special = F.split(text, rf"(?U)(?= (?!{any_of})\S)|(?={any_of})|(?<={any_of})", -1)
    held = F.lit(False)
    for x in special:
        held = held | F.contains(text, F.lit(x))
    return F.when(held, with_special).otherwise(F.split(text, cut, -1))


def packed(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed string."""
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(parts)) + lengths.tobytes() + b"".join(parts))


def unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and joined bytes of what packed() made."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    return np.frombuffer(raw, np.uint32, n, 4), raw[4 + 4 * n :]


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all their first bytes, all their second ones and so on, which packs better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(doc_ids, words of each, all words) of some MB of documents at a time."""
    held, size, rows = [], 0, 0
    for b in batches:
        words = b.column(1)
        held.append((b.column(0), np.diff(words.offsets.to_numpy()), words.flatten()))
        size += held[-1][2].nbytes
        rows += b.num_rows
        if size >= BLOCK or rows >= BLOCK_ROWS:
            yield tuple(f(x) for f, x in zip((pa.concat_arrays, np.concatenate, pa.concat_arrays), zip(*held, strict=True), strict=True))
            held, size, rows = [], 0, 0
    if rows:
        yield tuple(f(x) for f, x in zip((pa.concat_arrays, np.concatenate, pa.concat_arrays), zip(*held, strict=True), strict=True))


#: kind 0: words of a bucket, 1: ids of such words, 2: positions; home: where a row goes next.
ROWS = "block string, kind int, bucket int, home string, body binary"
SCHEMA = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("home", pa.string()), ("body", pa.binary())])


def split_blocks(buckets: int):
    """Step 1: documents with their words to rows of words, a row for each bucket, and a row of positions, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, (ids, counts, words) in enumerate(blocks(batches)):
            coded = words.dictionary_encode()
            raw = coded.dictionary.cast(pa.binary()).to_pylist()
            home = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            alphabetic = pc.sort_indices(coded.dictionary).to_numpy()
            by = alphabetic[np.argsort(home[alphabetic], kind="stable")]  # by bucket, like words side by side
            edge = np.searchsorted(home[by], np.arange(buckets + 1))
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            some = np.flatnonzero(np.diff(edge)).tolist()
            name = f"p{part}-{no}"
            null = ids.is_null().to_numpy(zero_copy_only=False)
            body = packed([null.astype(np.uint8).tobytes(), ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), counts.astype(np.int64).tobytes(), planes(rank), planes(coded.indices.to_numpy())])
            bodies = [packed([raw[i] for i in by[edge[k] : edge[k + 1]]]) for k in some]
            n = len(some)
            for a in range(0, n, 64):
                z = min(a + 64, n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (z - a)), pa.array([0] * (z - a), pa.int32()), pa.array(some[a:z], pa.int32()), pa.array([f"w{k}" for k in some[a:z]]), pa.array(bodies[a:z], pa.binary())], schema=SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([2], pa.int32()), pa.array([-1], pa.int32()), pa.array([name]), pa.array([body], pa.binary())], schema=SCHEMA)

    return tidied(run)


def word_ids(vocabulary: Vocabulary):
    """Step 2: rows sorted by bucket, words to their ids, sent to their block; each distinct word of a bucket is encoded when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for b in batches:
            for block, kind, bucket, body in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "bucket", "body")), strict=True):
                if kind != 0:
                    continue
                if bucket != at:
                    at, known = bucket, {}
                lengths, raw = unpacked(body)
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                words = [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                if new := [w for w in words if w not in known]:
                    for w, ids in zip(new, vocabulary.encode([w.decode("utf-8", "surrogatepass") for w in new]), strict=True):
                        known[w] = np.array(ids, np.uint32).tobytes()
                ids = [known[w] for w in words]
                body = packed([np.fromiter((len(x) // 4 for x in ids), np.uint8 if max(map(len, ids)) < 1024 else np.uint32).tobytes(), planes(np.frombuffer(b"".join(ids), np.uint32))])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], names=["home", "bucket", "body"])

    return tidied(run)


def taken(values: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches pick of values, whose lengths are given, joined; and the lengths of what was picked."""
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    n = lengths[pick].astype(np.int64)
    shift = first[pick] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(n.sum())], n


def joined(decode=None):
    """Step 3: a block's positions and the ids of its words to documents with their ids; and step 4 if decode is given."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *([("text", pa.string())] if decode else [])])

    def run(positions: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        if positions.num_rows:
            lengths, values = [], []
            for body in words.sort_by("bucket").column("body"):
                (cut, _), raw = unpacked(body.as_py())
                ids = of_planes(raw[cut:])
                n = np.frombuffer(raw[:cut], np.uint8)
                lengths.append((n if int(n.sum()) == len(ids) else n.view(np.uint32)).astype(np.int64))
                values.append(ids)
            per_word, all_ids = np.concatenate(lengths), np.concatenate(values)
            del lengths, values
            sizes, raw = unpacked(positions.column("body")[0].as_py())
            ends = np.cumsum(sizes, dtype=np.int64)
            null = np.frombuffer(raw[: ends[0]], np.uint8).astype(bool)
            docs, counts = np.frombuffer(raw[ends[0] : ends[1]], np.int64), np.frombuffer(raw[ends[1] : ends[2]], np.int64)
            rank, at = of_planes(raw[ends[2] : ends[3]]), of_planes(raw[ends[3] :])
            stop = np.cumsum(counts)
            for a in range(0, len(docs), STRIDE):  # some documents at a time, for memory
                z = min(a + STRIDE, len(docs))
                ids, n = taken(all_ids, per_word, rank[at[stop[a] - counts[a] : stop[z - 1]]])
                edge = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts[a:z])])]
                own = [ids[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
                cols = [pa.array(docs[a:z], pa.int64(), mask=null[a:z]), pa.array([x.tobytes() for x in own], pa.binary())]
                out.append(pa.RecordBatch.from_arrays([*cols, *([pa.array([decode(x) for x in own], pa.string())] if decode else [])], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def encode(documents: DataFrame, path: str, buckets: int | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers; with decoded, the text that they decode to as well."""
    spark = documents.sparkSession
    small_batches(spark)
    vocabulary, n = Vocabulary(path), n_partitions(spark)
    rows = steady(documents.select("doc_id", "text")).select("doc_id", words_of(F.coalesce("text", F.lit("")), tuple(vocabulary.special)).alias("words"))
    rows = rows.mapInArrow(split_blocks(buckets or 2 * n), ROWS).repartition(n, "home")
    # the random term keeps the filter above the shuffle, which is then one for words and positions
    positions = rows.where((F.coalesce("kind", F.lit(-1)) + F.floor(F.rand())) == 2)
    words = rows.sortWithinPartitions("bucket").mapInArrow(word_ids(vocabulary), "home string, bucket int, body binary").repartition(n, "home")
    both = positions.groupBy("home").cogroup(words.groupBy("home"))
    if not decoded:
        return both.applyInArrow(joined(), "doc_id long, ids binary")
    return both.applyInArrow(joined(decoder(spark, path)), "doc_id long, ids binary, text string")


def decoder(spark: SparkSession, path: str):
    """A function from ids to text, over the id-to-piece table that every executor gets once; bytes that are no UTF-8 become U+FFFD."""
    table = Vocabulary(path).pieces()
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), np.fromiter(map(len, table), np.int64, len(table))))

    def run(ids: np.ndarray) -> str:
        return taken(*shared.value, ids)[0].tobytes().decode("utf-8", "replace")

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): step 4 over a table of ids; null ids count as none."""
    run = decoder(encoded.sparkSession, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [run(np.frombuffer(x or b"", np.uint32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(decoded), "doc_id long, ids binary, text string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe_round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    out = encode(documents, path or vocabulary_path(), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
