"""Document fingerprints: a Merkle tree over paragraphs and sections.

The root covers sections, a section covers paragraphs, a paragraph covers
leaves. Paragraphs are lines; a long paragraph is cut into leaves where the
content says so (after a word whose hash is a multiple of CUT, once the leaf has FEW
words, and inside a word of more than LEAST code points after NEAR code points whose
hash is a multiple of INNER), so an edit moves few cuts outside of its place. Runs
without spaces, such as Chinese or base64, are so cut as well: a word is at most MOST
code points, and a leaf LEAF_WORDS words. SECTION paragraphs in a row, cut by content too, make a
section. Every node is the hash of its children's hashes.

A fingerprint is text: the root, then the sections, each with its hash and its
leaves (hash and code points). One rule cuts texts of every length, so a likeness
means the same for all of them; a text of a few words has a leaf or two, and shares
them or not. Equal roots mean equal texts; where roots differ, sections with equal
hashes are skipped and the leaves of the others locate the edits; likeness is the
share of code points that lie in leaves of both.

Edge cases: null text counts as empty, which has a root and no leaves; equal
texts have equal fingerprints; null ids come first; rows of one id follow each
other in the order of their texts, or of a hash of them where an id has very many;
with a single row the next document is the row itself; very long texts are read
whole, one at a time; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, small_batches, tidied

#: A leaf ends after a word whose hash is a multiple of CUT, the FEW-th word at the earliest, or after LEAF_WORDS words.
CUT, FEW, LEAF_WORDS = 3, 3, 16
#: A cut inside a word comes after LEAST code points at the earliest, after MOST at the latest, else where the hash of the last NEAR is a multiple of INNER.
LEAST, MOST, NEAR, INNER = 16, 64, 4, 8
#: A section ends after a paragraph whose hash is a multiple of this.
SECTION = 8
#: Stands for a null id, which comes first; a tie that none passes.
NO_ID, MOST_TIE = -(1 << 63), (1 << 63) - 1


def digest(raw: bytes, size: int) -> str:
    return hashlib.blake2b(raw, digest_size=size).hexdigest()


def cuts(word: str) -> list[int]:
    """Where a word of more than LEAST code points is cut, by its content; the end is no cut."""
    out, at, p = [], 0, LEAST
    while p < len(word):
        if p - at == MOST or zlib.crc32(word[p - NEAR : p].encode("utf-8", "surrogatepass")) % INNER == 0:
            out.append(p)
            at, p = p, p + LEAST
        else:
            p += 1
    return out


def leaves(paragraph: str, known: dict[str, bool]) -> list[str]:
    """The paragraph cut after words chosen by their content, and inside long words."""
    out, at, begin, n = [], 0, 0, 0
    for word in paragraph.split(" "):
        if len(word) > LEAST and (inner := cuts(word)):
            for c in inner:
                out.append(paragraph[begin : at + c])
                begin, n = at + c, 0
            word = word[inner[-1] :]
            at += inner[-1]
        at += len(word) + 1
        n += 1
        cut = known.get(word)
        if cut is None:
            cut = known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % CUT == 0
        if cut and n >= FEW or n == LEAF_WORDS:
            out.append(paragraph[begin:at])
            begin, n = at, 0
    if begin < len(paragraph):
        out.append(paragraph[begin:])
    return out


def named(parts: list[str], hashes: list[str]) -> list[str]:
    return [f"{h[:8]}{len(p)}" for h, p in zip(hashes, parts, strict=True)]


def hashed(parts: list[str]) -> list[str]:
    return [digest(p.encode("utf-8", "surrogatepass"), 12) for p in parts]


def fingerprint(text: str | None, known: dict[str, bool] | None = None) -> str:
    """root|section:leaf,leaf|section:leaf,...; a leaf is 8 hex digits and its code points."""
    known = {} if known is None else known
    if len(known) > 500_000:
        known.clear()
    sections, own, inner = [], [], []
    paragraphs = (text or "").splitlines(keepends=True)
    for paragraph in paragraphs:
        parts = leaves(paragraph, known)
        hashes = hashed(parts)
        own += named(parts, hashes)
        inner.append(digest("".join(hashes).encode(), 16))
        if int(inner[-1][:8], 16) % SECTION == 0:
            sections.append((digest("".join(inner).encode(), 16), own))
            own, inner = [], []
    if inner:
        sections.append((digest("".join(inner).encode(), 16), own))
    root = digest("".join(h for h, _ in sections).encode(), 32)
    return "|".join([root, *(f"{h}:{','.join(x)}" for h, x in sections)])


def likeness(a: str, b: str) -> float:
    """The share of all code points, of both texts, that lie in leaves of both; equal roots are 1."""
    (root, *a), (other, *b) = a.split("|"), b.split("|")
    if root == other:
        return 1.0
    same = Counter(a) & Counter(b)  # equal branches need no descent
    both = sum(int(x[8:]) * n for s, n in same.items() for x in s.split(":")[1].split(","))
    left, right = (Counter(x for s in (Counter(t) - same).elements() for x in s.split(":")[1].split(",")) for t in (a, b))
    shared = sum(int(x[8:]) * n for x, n in (left & right).items())
    total = 2 * both + sum(int(x[8:]) * n for x, n in (left + right).items())
    return 2 * (both + shared) / total if total else 1.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where b's text holds leaves that a lacks: stretches of code points [start, end) of b."""
    a, b = a.split("|")[1:], b.split("|")[1:]
    rest, at, out = Counter(x for s in a for x in s.split(":")[1].split(",")), 0, []
    for leaf in (x for s in b for x in s.split(":")[1].split(",")):
        n = int(leaf[8:])
        if rest[leaf]:
            rest[leaf] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + n)
        else:
            out.append((at, at + n))
        at += n
    return out


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(documents: DataFrame) -> DataFrame:
    """Documents dealt by ranges of (doc_id, tie, text) and sorted, each range followed by the first rows of the next one (last = true).

    The tie is 0, but a hash of the text for an id that has more rows than a fair
    share of one range, so that a hot id, or null, is cut as well. Only quantiles of
    the ids, hot ids and the first key of each range come to the driver, some times
    as many as there are partitions. A range is a partition of its own.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = n_partitions(spark)
    total = rows.count()
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    fair = max(1000, -(-total // n))
    hot = {r.key: -(-r["count"] // fair) for r in rows.groupBy("key").count().where(F.col("count") > fair).collect()}  # n at most
    bounds = {(int(c), MOST_TIE) for c in cuts}
    for key, pieces in hot.items():
        bounds |= {(key - 1, MOST_TIE), (key, MOST_TIE)} | {(key, int(-(1 << 63) + (i << 64) // pieces)) for i in range(1, pieces)}
    bounds = sorted(b for b in bounds if b[0] >= NO_ID)
    tie = F.when(F.col("key").isin(list(hot)), F.xxhash64("text")) if hot else F.lit(None).cast("long")
    rows = rows.withColumn("tie", F.coalesce(tie, F.lit(0).cast("long")))
    # the range is the number of bounds below the row: first among every step-th bound, then within its stretch
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda bs: F.array(*(F.struct(F.lit(k).cast("long").alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in bs))
    below = lambda a: F.size(F.filter(a, lambda b: b < F.struct("key", "tie")))
    coarse = below(literal(bounds[step - 1 :: step])) if bounds else F.lit(0)
    rows = rows.withColumn("coarse", coarse)
    fine = below(F.slice(literal(bounds), F.col("coarse") * step + 1, F.lit(step))) if bounds else F.lit(0)
    rows = rows.withColumn("part", F.col("coarse") * step + fine).drop("coarse")
    first = rows.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("head")).orderBy("part").collect()
    heads = [(r["head"]["key"], r["head"]["tie"], i, (i - 1) % len(first)) for i, r in enumerate(first)]
    numbers = F.broadcast(spark.createDataFrame([(r.part, i) for i, r in enumerate(first)], "part int, place int"))
    ahead = F.broadcast(spark.createDataFrame([h[:2] + h[3:] for h in heads], "head_key long, head_tie long, before int"))
    rows = rows.join(numbers, "part").join(ahead, (F.col("key") == F.col("head_key")) & (F.col("tie") == F.col("head_tie")), "left")
    here, there = F.struct(F.col("place").alias("place"), F.lit(False).alias("last")), F.struct(F.col("before").alias("place"), F.lit(True).alias("last"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    dealt = dealt.select("doc_id", "key", "tie", "text", F.col("to.place").alias("part"), F.col("to.last").alias("last"))
    return dealt.repartitionById(max(1, len(first)), F.col("part")).sortWithinPartitions("part", "last", "key", "tie", "text").drop("key", "tie")


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, bool] = {}
    before = None

    def row(part, doc, text, print_, following, next_print):
        new = edited(text, following)
        other = fingerprint(new, known)
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_, other, likeness(print_, other), likeness(print_, next_print)

    for b in batches:
        out = []
        for doc, text, part, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = fingerprint(text, known)
            if before is not None and before[0] == part:
                out.append(row(*before, text, own))
            before = None if last else (part, doc, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op3_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    small_batches(documents.sparkSession)
    return with_next(documents).mapInArrow(tidied(compared), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
