"""A full-text index over the fields title, cwd and text, in segments that follow their table.

Words are runs of letters and digits of any script, in lower case, without the
accents of Latin letters. A segment is written once and holds, for each of its rows,
the words with their counts by field and their positions, and from that the postings:
a row for each word and block of BLOCK rows, sorted by word, with the largest counts
and the least length in the block beside it. A change writes a new segment and, for
rows that are gone, tombstones with what they take away from the statistics; segments
of one size are merged when there are FANOUT of them. A manifest, a small file that is
written whole under the next number, names what is live, so a reader keeps to one
version and two writers can't both win.

Scores are those of BM25 over weighted fields: a phrase's count is the weighted sum of
its counts by field, a row's length that of all fields.

Where it is asked for, a segment also has the runs of up to three code points of its
lower-cased texts, with a bit for each row of a block that holds them, so a literal of
any length is looked for only in rows that hold all its runs.

top() reads the heads of the blocks first, then only blocks that may hold one of the
best rows. Two waves do: the most promising blocks give a score that the best reach,
and the blocks that can't reach it are left unread.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import lexical, versions
from .batches import pieces, small, tidied
from .versions import Conflict  # noqa: F401  part of this module's surface

K1, B = 1.2, 0.75
FIELDS = ("title", "cwd", "text")
#: Rows of a block (a power of two), segments of one size that are merged, blocks of the first wave.
BLOCK, FANOUT, FIRST = 256, 8, 48
#: Numbers of 64 bits that have a bit for each row of a block.
PLACES = 4
#: Where the positions of a field begin, so that no phrase runs from one into the next.
APART = 1 << 28
#: Keys of a change that are looked up as literals; more are joined.
LITERALS = 1_000
WORD = "term string, title int, cwd int, text int, pos array<int>"
ROW = f"id long, ref string, hash long, len int, grams array<int>, words array<struct<{WORD.replace(' int', ':int').replace(' string', ':string').replace(' array', ':array')}>>"
ARROW_WORD = pa.struct([("term", pa.string()), ("title", pa.int32()), ("cwd", pa.int32()), ("text", pa.int32()), ("pos", pa.list_(pa.int32()))])


class Clause(NamedTuple):
    """One phrase of a query: words one after the other (the last one's beginning, if prefix), in any field or one."""

    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


def clauses(query: str) -> list[Clause]:
    """The phrases of a query as it is typed: words, "words in a row", beginning*, field: before any of them; OR between them is read over."""
    out = []
    for field, quoted, word, star in re.findall(r'(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s"*:]+))(\*?)', query):
        if field and field not in FIELDS:
            quoted, word, field = (quoted, f"{field} {word}", "") if word else (f"{field} {quoted}", word, "")
        if word in ("OR", "AND") and not field:
            continue
        words = tuple(T.words_of(quoted or word))
        if words:
            out.append(Clause(words, bool(star), field or None))
    return list(dict.fromkeys(out))


class Syntax(ValueError):
    """The query is none of the index's language."""


def parsed(query: str) -> tuple[list[Clause], Column]:
    """A query of the SQL surface's MATCH: its phrases, and whether a row with counts f0, f1, ... matches.

    Words beside each other must all be there, AND alike; OR and NOT in capitals,
    parentheses, "words in a row", word*, field: before a phrase or parentheses, and
    + between words that stand in a row. NOT binds closer than AND, AND closer than OR.
    """
    tokens = re.findall(r'"(?:[^"]|"")*"|[()*:+{}^]|[^\s"()*:+{}^]+', query)
    asked: list[Clause] = []
    at = 0

    def peek(n: int = 0) -> str:
        return tokens[at + n] if at + n < len(tokens) else ""

    def take(expected: str = "") -> str:
        nonlocal at
        if not peek() or expected and peek() != expected:
            raise Syntax(f"{expected or 'a word'} expected in {query!r}")
        at += 1
        return tokens[at - 1]

    def either(field: str | None) -> Column:
        test = every(field)
        while peek() == "OR":
            take()
            test = test | every(field)
        return test

    def every(field: str | None) -> Column:
        test = without(field)
        while peek() and peek() not in ("OR", ")"):
            if peek() == "AND":
                take()
            test = test & without(field)
        return test

    def without(field: str | None) -> Column:
        test = one(field)
        while peek() == "NOT":
            take()
            test = test & ~one(field)
        return test

    def one(field: str | None) -> Column:
        if peek(1) == ":" and peek().lower() in FIELDS:
            field = take().lower()
            take(":")
        if peek() == "(":
            take()
            test = either(field)
            take(")")
            return test
        words = list(T.words_of(word()))
        while peek() == "+":
            take()
            words += T.words_of(word())
        prefix = peek() == "*"
        if prefix:
            take()
        if not words:  # a phrase without words matches nothing
            return F.lit(False)
        clause = Clause(tuple(words), prefix, field)
        if clause not in asked:
            asked.append(clause)
        return F.col(f"f{asked.index(clause)}") > 0

    def word() -> str:
        w = take()
        if w in ("AND", "OR", "NOT") or len(w) == 1 and w in "()*:+{}^" or w == "NEAR" and peek() == "(":
            raise Syntax(f"{w} isn't expected in {query!r}")
        return w

    test = either(None)
    if at < len(tokens):
        raise Syntax(f"{peek()} isn't expected in {query!r}")
    return asked, test


def grams(text: str) -> np.ndarray:
    """Numbers of the runs of one, two and three code points of a text, each once."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    b = a * np.uint32(2_654_435_761) + np.uint32(97)
    two = b[:-1] * np.uint32(31) + a[1:] * np.uint32(40_503)
    three = two[:-1] * np.uint32(2_246_822_519) + a[2:] * np.uint32(3_266_489_917) if len(a) > 2 else a[:0]
    return np.unique(np.concatenate([b, two, three])).view(np.int32)


def grams_of(text: str) -> list[int]:
    return grams(text).tolist()


def worded(b: pa.RecordBatch, substrings: bool) -> pa.RecordBatch:
    """ROW of a batch (id, ref, hash, title, cwd, text, low): every row's words, counted in one pass, and the grams of low."""
    lens, ends, terms, counts, pos, pos_ends = [], [0], [], ([], [], []), [], [0]
    for fields in zip(*(b.column(f).to_pylist() for f in FIELDS), strict=True):
        own: dict[str, list] = {}
        n = 0
        for k, value in enumerate(fields):
            words = T.words_of(value or "")
            n += len(words)
            for at, w in enumerate(words, k * APART):
                held = own.get(w)
                if held is None:
                    held = own[w] = [0, 0, 0, []]
                held[k] += 1
                held[3].append(at)
        lens.append(n)
        terms += own
        for held in own.values():
            for k in range(3):
                counts[k].append(held[k])
            pos += held[3]
            pos_ends.append(len(pos))
        ends.append(len(terms))
    body = pa.StructArray.from_arrays([pa.array(terms, pa.string()), *(pa.array(c, pa.int32()) for c in counts), pa.ListArray.from_arrays(pa.array(pos_ends, pa.int32()), pa.array(pos, pa.int32()))], fields=list(ARROW_WORD))
    runs = [grams(t or "") if substrings else np.zeros(0, np.int32) for t in b.column("low").to_pylist()]
    held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *runs])))
    return pa.RecordBatch.from_arrays([b.column("id"), b.column("ref"), b.column("hash"), pa.array(lens, pa.int32()), held, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), body)], names=["id", "ref", "hash", "len", "grams", "words"])


def forward(rows: DataFrame, substrings: bool) -> DataFrame:
    """ROW of rows (id, source_ref, title, cwd, text): worded() in pieces, so that what a Python worker holds doesn't grow with a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "text"):
                yield worded(piece, substrings)

    held = rows.select(F.col("id").cast("long").alias("id"), F.col("source_ref").cast("string").alias("ref"), content(rows).alias("hash"), *FIELDS, (F.lower("text") if substrings else F.lit("")).alias("low"))
    return held.mapInArrow(tidied(run), ROW)


def by_session(rows: DataFrame, ref: str) -> DataFrame:
    """rows in the order of their sessions, so that a session's rows lie in few blocks; before their words are counted, as finding the ranges' bounds reads them once more."""
    return rows.repartitionByRange(ref, "id").sortWithinPartitions(ref, "id")


def content(rows: DataFrame) -> Column:
    """A hash of what the index holds of a row."""
    return F.xxhash64(F.col("source_ref").cast("string"), *(F.coalesce(F.col(f), F.lit("")) for f in FIELDS))


class FullText:
    """One version of the index at path; changes give the next version."""

    def __init__(self, spark: SparkSession, path: str, version: int, live: dict):
        self.spark, self.path, self.version, self.live = spark, path, version, live

    # versions

    @staticmethod
    def open(spark: SparkSession, path: str) -> FullText:
        """The newest version; an empty one where there is none."""
        version, live = versions.newest(spark, path)
        return FullText(spark, path, version, live or {"segments": {}, "deleted": [], "batches": [], "substrings": False})

    def next(self, live: dict) -> FullText:
        """The next version, if nobody else has made it."""
        return FullText(self.spark, self.path, versions.put(self.spark, self.path, self.version, live), live)

    def vacuum(self) -> None:
        """Removes what no live version names: segments that were merged, tombstones of theirs, older manifests, what failed changes left."""
        for kind, names in {"segments": set(self.live["segments"]), "deleted": set(self.live["deleted"])}.items():
            for name in versions.listed(self.spark, f"{self.path}/{kind}"):
                if name not in names:
                    versions.remove(self.spark, f"{self.path}/{kind}/{name}")
        versions.forget(self.spark, self.path, self.version)

    # changes

    @staticmethod
    def write(rows: DataFrame, path: str, substrings: bool = False) -> FullText:
        """The index of rows (id, source_ref, title, cwd, text), in the place of what is at path; substrings: texts are found by any run of code points too."""
        old = FullText.open(rows.sparkSession, path)
        return FullText(rows.sparkSession, path, old.version, {"segments": {}, "deleted": [], "batches": [], "substrings": substrings}).add(rows)

    def segment(self, rows: DataFrame) -> dict:
        """Writes a segment of forward() rows that are by_session(): {name: statistics}, nothing for no rows."""
        with small(self.spark):
            return self._segment(rows)

    def _segment(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        base = f"{self.path}/segments/{name}"
        # read back, so that rows and postings have the same numbers
        number = F.monotonically_increasing_id()
        held = rows.select(F.lit(name).alias("seg"), F.shiftright(number, BLOCK.bit_length() - 1).alias("block"), F.pmod(number, F.lit(BLOCK)).cast("int").alias("at"), "id", "ref", "hash", "len", "grams", "words")
        held.write.parquet(f"{base}/rows")
        held = self.spark.read.parquet(f"{base}/rows")
        docs, total = held.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not docs:
            versions.remove(self.spark, base)
            return {}
        each = held.select("seg", "block", "at", "id", "len", F.explode("words").alias("w")).select("seg", F.col("w.term").alias("term"), "block", F.struct("at", "id", "len", "w.title", "w.cwd", "w.text", "w.pos").alias("p"))
        blocks = each.repartitionByRange("term", "block").groupBy("seg", "term", "block").agg(
            F.count("*").alias("n"), *(F.count_if(F.col(f"p.{f}") > 0).alias(f"n_{f}") for f in FIELDS), *(F.max(f"p.{f}").alias(f"most_{f}") for f in FIELDS),
            F.min("p.len").alias("least_len"), F.array_sort(F.collect_list("p")).alias("post"))  # BLOCK entries at most
        blocks.sortWithinPartitions("term", "block").write.option("parquet.block.size", 16 << 20).parquet(f"{base}/terms")
        if self.live["substrings"]:
            bits = held.select("seg", "block", "at", "grams").mapInArrow(tidied(bitmaps), f"seg string, gram int, block long, {', '.join(f'b{k} long' for k in range(PLACES))}")
            bits.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.option("parquet.block.size", 16 << 20).parquet(f"{base}/grams")
        return {name: {"docs": docs, "len": total, "gone": 0, "gone_len": 0}}

    def add(self, rows: DataFrame, batch: str | None = None) -> FullText:
        """The version with rows added, those of an id that is there already in its place; a batch that was added before changes nothing."""
        if batch is not None and batch in self.live["batches"]:
            return self
        index = self.without(rows.select(F.col("id").cast("long").alias("id")).distinct(), "id") if self.live["segments"] else self.live
        live = index | {"segments": index["segments"] | self.segment(forward(by_session(rows, "source_ref"), self.live["substrings"])), "batches": [*self.live["batches"], *([batch] if batch else [])][-1000:]}
        return self.next(self.merged(live))

    def delete(self, keys: DataFrame, column: str = "ref") -> FullText:
        """The version without the rows of these refs (or ids)."""
        return self.next(self.merged(self.without(keys.select(column).distinct(), column)))

    def sync(self, table: DataFrame) -> FullText:
        """The version that holds just the rows of table: only what differs by content is written."""
        now = table.select(F.col("id").cast("long").alias("id"), content(table).alias("hash"))
        held = self.rows().select("id", "hash") if self.live["segments"] else now.limit(0)
        fresh = table.join(now.join(held, ["id", "hash"], "left_anti").select("id"), "id", "left_semi")
        left = held.join(now, "id", "left_anti").select("id")
        index = self if left.isEmpty() else self.delete(left, "id")
        return index if fresh.isEmpty() else index.add(fresh)

    def without(self, keys: DataFrame, column: str) -> dict:
        """What is live when the rows of keys have tombstones; the cost is that of finding them by sorted files, and of their own words."""
        rows = self.rows(["seg", "block", "at", "id", "ref", "len", "words"])
        few = [r[0] for r in keys.limit(LITERALS + 1).collect()]
        gone = rows.where(F.col(column).isin(few)) if len(few) <= LITERALS else rows.join(keys, column, "left_semi")
        name = uuid.uuid4().hex
        path = f"{self.path}/deleted/{name}"
        gone.write.parquet(f"{path}/rows")
        gone = self.spark.read.parquet(f"{path}/rows")
        of = {r["seg"]: (r["n"], r["len"]) for r in gone.groupBy("seg").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()}  # a row a segment
        if not of:
            return self.live
        each = gone.select("seg", F.explode("words").alias("w"))
        each.groupBy("seg", F.col("w.term").alias("term")).agg(F.count("*").alias("n"), *(F.count_if(F.col(f"w.{f}") > 0).alias(f"n_{f}") for f in FIELDS)).write.parquet(f"{path}/terms")
        segments = {s: x | {"gone": x["gone"] + of.get(s, (0, 0))[0], "gone_len": x["gone_len"] + of.get(s, (0, 0))[1]} for s, x in self.live["segments"].items()}
        return self.live | {"segments": segments, "deleted": [*self.live["deleted"], name]}

    def merged(self, live: dict) -> dict:
        """live with FANOUT segments of a size as one, and without those that have no row left; their tombstones end with them."""
        live = live | {"segments": {s: x for s, x in live["segments"].items() if x["gone"] < x["docs"]}}
        tiers: dict[int, list[str]] = {}
        for s, x in live["segments"].items():
            tiers.setdefault(max(0, (x["docs"] - x["gone"]).bit_length() // 3), []).append(s)
        for names in tiers.values():
            if len(names) >= FANOUT:
                part = FullText(self.spark, self.path, self.version, live | {"segments": {s: live["segments"][s] for s in names}})
                new = self.segment(by_session(part.rows(["id", "ref", "hash", "len", "grams", "words"]), "ref"))
                return self.merged(live | {"segments": {s: x for s, x in live["segments"].items() if s not in names} | new})
        return live if any(x["gone"] for x in live["segments"].values()) else live | {"deleted": []}

    # reading

    def rows(self, columns: list[str] | None = None) -> DataFrame:
        """The live rows of the index."""
        held = self.spark.read.parquet(*(f"{self.path}/segments/{s}/rows" for s in self.live["segments"]))
        return self.alive(held).select(*(columns or ["seg", "block", "at", "id", "ref", "hash", "len"]))

    def tombstones(self, kind: str) -> DataFrame | None:
        """The tombstones of live segments: rows, or terms with their counts."""
        if not self.live["deleted"]:
            return None
        return self.spark.read.parquet(*(f"{self.path}/deleted/{d}/{kind}" for d in self.live["deleted"])).where(F.col("seg").isin([s for s, x in self.live["segments"].items() if x["gone"]]))

    def alive(self, rows: DataFrame) -> DataFrame:
        gone = self.tombstones("rows")
        return rows if gone is None else rows.join(gone.select("seg", "block", "at").distinct(), ["seg", "block", "at"], "left_anti")

    def size(self) -> tuple[int, float]:
        """(live rows, their mean length)."""
        docs = sum(x["docs"] - x["gone"] for x in self.live["segments"].values())
        return docs, sum(x["len"] - x["gone_len"] for x in self.live["segments"].values()) / max(1, docs)

    def blocks(self, asked: list[Clause]) -> DataFrame:
        """The postings' blocks of the clauses' words."""
        terms = sorted({w for c in asked for w in (c.words[:-1] if c.prefix else c.words)})
        begins = sorted({c.words[-1] for c in asked if c.prefix})
        test = [F.col("term").isin(terms)] if terms else []
        test += [F.col("term").startswith(w) for w in begins]
        return self.spark.read.parquet(*(f"{self.path}/segments/{s}/terms" for s in self.live["segments"])).where(reduce(lambda a, b: a | b, test, F.lit(False)))

    def hits(self, asked: list[Clause], blocks: DataFrame) -> DataFrame:
        """(seg, block, at, id, len, f0, f0_title, ...): rows of blocks that hold any clause, with its counts by field; a clause bound to a field counts there alone."""
        each = blocks.select("seg", "block", "term", F.explode("post").alias("p")).select("seg", "block", "term", "p.*")
        cols = []
        for i, c in enumerate(asked):
            fields = [c.field] if c.field else FIELDS
            if len(c.words) == 1:
                test = F.col("term").startswith(c.words[0]) if c.prefix else F.col("term") == c.words[0]
                cols += [F.coalesce(F.sum(F.when(test, F.col(f))), F.lit(0)).cast("int").alias(f"f{i}_{f}") for f in fields]
                continue
            # places where the words stand one after the other, by the first one's position
            for j, w in enumerate(c.words):
                test = F.col("term").startswith(w) if c.prefix and j == len(c.words) - 1 else F.col("term") == w
                cols.append(F.flatten(F.collect_list(F.when(test, F.transform("pos", shifted(j))))).alias(f"p{i}_{j}"))
        rows = each.groupBy("seg", "block", "at", "id", "len").agg(*cols)
        for i, c in enumerate(asked):
            fields = [c.field] if c.field else FIELDS
            if len(c.words) > 1:
                begin = reduce(F.array_intersect, [F.col(f"p{i}_{j}") for j in range(len(c.words))])
                rows = rows.withColumn(f"p{i}", begin).drop(*(f"p{i}_{j}" for j in range(len(c.words))))
                for f in fields:
                    rows = rows.withColumn(f"f{i}_{f}", F.size(F.filter(f"p{i}", within(FIELDS.index(f)))))
                rows = rows.drop(f"p{i}")
            for f in FIELDS:
                if f not in fields:
                    rows = rows.withColumn(f"f{i}_{f}", F.lit(0))
            rows = rows.withColumn(f"f{i}", sum((F.col(f"f{i}_{f}") for f in fields), F.lit(0)))
        some = reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(asked))])
        return self.alive(rows.where(some))

    def frequencies(self, asked: list[Clause]) -> list[int]:
        """The live rows that hold each clause; for single words by the blocks' heads alone."""
        plain = [c for c in asked if len(c.words) == 1 and not c.prefix]
        out: dict[Clause, int] = {}
        if plain:
            heads = self.blocks(plain).select("term", "n", *(f"n_{f}" for f in FIELDS))
            gone = self.tombstones("terms")
            if gone is not None:
                minus = gone.where(F.col("term").isin([c.words[0] for c in plain]))
                heads = heads.unionByName(minus.select("term", *((-F.col(c)).alias(c) for c in ("n", *(f"n_{f}" for f in FIELDS)))))
            found = {r["term"]: r for r in heads.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", *(f"n_{f}" for f in FIELDS)))).collect()}  # a row a word asked for
            out |= {c: found[c.words[0]][f"n_{c.field}" if c.field else "n"] if c.words[0] in found else 0 for c in plain}
        rest = [c for c in asked if c not in out]
        if rest:
            n = self.hits(rest, self.blocks(rest)).agg(*(F.count_if(F.col(f"f{i}") > 0) for i in range(len(rest)))).first()
            out |= dict(zip(rest, n, strict=True))
        return [out[c] for c in asked]

    def weights(self, asked: list[Clause]) -> list[Column]:
        """Each clause's weight: ln((N - n + 0.5) / (n + 0.5)), a millionth where that isn't positive."""
        docs, _ = self.size()
        raw = [F.log(F.lit((docs - n + 0.5) / (n + 0.5))) for n in self.frequencies(asked)]
        return [F.when(w <= 0, F.lit(1e-6)).otherwise(w) for w in raw]

    def part(self, weight: Column, count: Column, length: Column) -> Column:
        _, mean = self.size()
        return weight * (count * (K1 + 1)) / (count + K1 * (1 - B + B * length / F.lit(max(mean, 1e-9))))

    def scored(self, asked: list[Clause], by_field: tuple[float, float, float] = (1.0, 1.0, 1.0), blocks: DataFrame | None = None, weights: list[Column] | None = None) -> DataFrame:
        """(id, score, f0, f0_title, ...) of every live row that holds a clause, or of those in blocks."""
        if not asked or not self.live["segments"]:
            return self.spark.createDataFrame([], "id long, score double")
        weights = weights or self.weights(asked)
        rows = self.hits(asked, self.blocks(asked) if blocks is None else blocks)
        each = []
        for i, w in enumerate(weights):
            count = sum((F.lit(float(b)) * F.col(f"f{i}_{f}") for b, f in zip(by_field, FIELDS, strict=True)), F.lit(0.0))
            each.append(F.when(count > 0, self.part(w, count, F.col("len"))).otherwise(0.0))
        return rows.select("id", reduce(lambda a, b: a + b, each).alias("score"), *(c for c in rows.columns if re.match(r"f\d", c)))

    def top(self, asked: list[Clause], k: int = 10, by_field: tuple[float, float, float] = (1.0, 1.0, 1.0), report: dict | None = None) -> DataFrame:
        """(id, score): the k best rows for any of the clauses, ties to the smaller id; report gets the blocks there are and those read.

        Phrases and beginnings have no bound by block, so a query with one is scored whole.
        """
        best = [F.desc("score"), F.col("id")]
        if not asked or not self.live["segments"] or any(len(c.words) > 1 or c.prefix for c in asked):
            return self.scored(asked, by_field).select("id", "score").orderBy(*best).limit(k)
        weights = self.weights(asked)
        held = self.blocks(asked)
        bound = F.lit(0.0)
        for c, w in zip(asked, weights, strict=True):
            most = sum((F.lit(float(b)) * F.col(f"most_{f}") for b, f in zip(by_field, FIELDS, strict=True) if c.field in (None, f)), F.lit(0.0))
            bound = bound + F.when((F.col("term") == c.words[0]) & (most > 0), self.part(w, most, F.col("least_len"))).otherwise(0.0)
        potential = held.select("seg", "block", bound.alias("bound")).groupBy("seg", "block").agg((F.sum("bound") * (1 + 1e-9)).alias("bound"))
        first = potential.orderBy(F.desc("bound"), "seg", "block").limit(FIRST).collect()
        inside = reduce(lambda a, b: a | b, [(F.col("seg") == s) & F.col("block").isin([r["block"] for r in first if r["seg"] == s]) for s in sorted({r["seg"] for r in first})], F.lit(False))
        found = self.scored(asked, by_field, held.where(inside), weights).select("id", "score").orderBy(*best).limit(k).collect()
        floor = found[-1]["score"] if len(found) == k else float("-inf")
        rest = potential.where(~inside & (F.col("bound") >= floor))
        more = rest.count() if len(first) == FIRST else 0
        if report is not None:
            report |= {"blocks": potential.count(), "read": len(first) + more}
        known = self.spark.createDataFrame([tuple(r) for r in found], "id long, score double")
        if not more:
            return known.orderBy(*best)
        late = self.scored(asked, by_field, held.join(rest.select("seg", "block"), ["seg", "block"], "left_semi"), weights).select("id", "score")
        return known.unionByName(late.where(F.col("score") >= floor)).orderBy(*best).limit(k)

    def matching(self, asked: list[Clause]) -> DataFrame:
        """(id, hits): rows that hold any clause, and how many of them."""
        rows = self.hits(asked, self.blocks(asked))
        return rows.select("id", sum((F.when(F.col(f"f{i}") > 0, 1).otherwise(0) for i in range(len(asked))), F.lit(0)).alias("hits"))


    def match(self, query: str, by_field: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
        """(id, rank) of the rows that a query of parsed() matches; rank falls as a match gets better, as the SQL surface has it."""
        asked, test = parsed(query)
        if not asked or not self.live["segments"]:
            return self.spark.createDataFrame([], "id long, rank double")
        return self.scored(asked, by_field).where(test).select("id", (-F.col("score")).alias("rank"))

    def holding(self, literal: str) -> DataFrame:
        """The ids of rows whose lower-cased text may hold the lower-cased literal, and of all that do: those that hold all its grams."""
        if not self.live["substrings"]:
            raise ValueError("the index was written without substrings")
        grams = grams_of(literal.lower())
        if not self.live["segments"] or not grams:
            return self.rows(["id"]) if self.live["segments"] else self.spark.createDataFrame([], "id long")
        held = self.spark.read.parquet(*(f"{self.path}/segments/{s}/grams" for s in self.live["segments"])).where(F.col("gram").isin(grams))
        # a block may lie in two files, and then has two rows for a gram
        each = held.groupBy("seg", "block", "gram").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(PLACES)))
        every = each.groupBy("seg", "block").agg(F.count("*").alias("n"), *(F.bit_and(f"b{k}").alias(f"b{k}") for k in range(PLACES))).where(F.col("n") == len(grams))
        bit = F.posexplode(F.array(*(f"b{k}" for k in range(PLACES)))).alias("place", "bits")
        at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1))
        places = every.select("seg", "block", bit).where("bits != 0").select("seg", "block", "place", at.alias("i"))
        places = places.select("seg", "block", (64 * F.col("place") + F.col("i")).cast("int").alias("at"))
        return self.rows(["seg", "block", "at", "id"]).join(places, ["seg", "block", "at"], "left_semi").select("id")

    def literal(self, rows: DataFrame, needle: str, newest: int | None = None, order: str = "id") -> DataFrame:
        """Rows of the indexed table that hold the literal in any case, of the newest ones that do (all: None), with score 100 + 10 * min(count, 5); only rows that hold its grams are read."""
        found = self.holding(needle)
        few = [r["id"] for r in found.limit(LITERALS + 1).collect()]
        rows = rows.where(F.col("id").isin(few)) if len(few) <= LITERALS else rows.join(found, "id", "left_semi")
        return lexical.literal(rows, needle, newest, order)


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, gram, block, b0, ...): which rows of a block hold a gram, a bit for each place in the block; blocks come one after the other."""

    def row(seg: str, block: int, held: list) -> pa.RecordBatch:
        gram = np.concatenate([g for _, g in held])
        at = np.repeat([a for a, _ in held], [len(g) for _, g in held])
        own, index = np.unique(gram, return_inverse=True)
        bits = np.zeros((len(own), PLACES), np.uint64)
        np.bitwise_or.at(bits, (index, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        names = ["seg", "gram", "block", *(f"b{k}" for k in range(PLACES))]
        return pa.RecordBatch.from_arrays([pa.array([seg] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(np.full(len(own), block)), *(pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(PLACES))], names=names)

    now, held = None, []
    for b in batches:
        for seg, block, at, grams in zip(b.column("seg").to_pylist(), b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("grams"), strict=True):
            if (seg, block) != now:
                if held:
                    yield row(*now, held)
                now, held = (seg, block), []
            held.append((at, grams.values.to_numpy()))
    if held:
        yield row(*now, held)


def shifted(n: int):
    return lambda x: x - n


def within(field: int):
    return lambda x: (x >= field * APART) & (x < (field + 1) * APART)
