"""Python steps over texts hold few rows at once, whatever the batch."""

import tracemalloc

import pyarrow as pa
import pytest

from recollect.operators import batches, embeddings, fulltext, lexical

TEXTS = [" ".join(f"w{(i * 7 + j) % 5000}" for j in range(400)) for i in range(4000)]


class Here:
    """Stands for rows: runs the function of mapInArrow in this process."""

    def __init__(self, given):
        self.given = given

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):
        tracemalloc.start()
        try:
            rows = [b.num_rows for b in run(iter([self.given]))]
            self.peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        self.rows = rows
        return self


def test_pieces():
    b = pa.RecordBatch.from_pydict({"id": list(range(6)), "t": ["a" * 10, None, "ä" * 20, "b" * 100, "", "c"]}).slice(1)
    got = [p.column("id").to_pylist() for p in batches.pieces(b, "t", 50)]
    assert got == [[1, 2], [3], [4, 5]]


def test_small_batches_are_undone(spark):
    before = {k: spark.conf.get(k, None) for k in batches.CONF}
    with pytest.raises(KeyError), batches.small(spark):
        assert {k: spark.conf.get(k) for k in batches.CONF} == batches.CONF
        raise KeyError
    assert {k: spark.conf.get(k, None) for k in batches.CONF} == before


def test_postings_are_counted_in_pieces(spark):
    class Rows(Here):
        schema = {"id": type("", (), {"dataType": type("", (), {"simpleString": lambda self: "bigint"})()})()}

    rows = Rows(pa.RecordBatch.from_pydict({"id": list(range(len(TEXTS))), "low": TEXTS}))
    n = sum(len({w for w in t.split() if len(w) > 2}) for t in TEXTS)
    held = lexical.postings(rows)
    assert sum(held.rows) == n and len(held.rows) > 10 and held.peak < 60e6, held.peak


def test_forward_is_counted_in_pieces(spark):
    class Rows(Here):
        pass

    fields = {"id": list(range(len(TEXTS))), "ref": ["r"] * len(TEXTS), "hash": [1] * len(TEXTS), "title": [""] * len(TEXTS), "cwd": [None] * len(TEXTS), "text": TEXTS, "low": TEXTS}
    held = fulltext.forward(Rows(pa.RecordBatch.from_pydict(fields)), True)
    assert sum(held.rows) == len(TEXTS) and len(held.rows) > 10 and held.peak < 60e6, held.peak


def test_pairs_are_counted_in_pieces(spark, monkeypatch):
    class Rows(Here):
        sparkSession = spark

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

    monkeypatch.setattr(embeddings, "PAIRED", 64 << 10)
    words = {f"w{i}": i for i in range(5000)}
    held = embeddings.counted(Rows(pa.RecordBatch.from_pydict({"text": TEXTS[:1000]})), words)
    assert len(held.rows) > 10 and held.peak < 60e6, held.peak
    texts = ["w1 w2 x w3 w1", None, "w2 w1"]
    got = {(r["a"], r["b"]): r["n"] for r in embeddings.paired(texts, words).to_pylist()}
    assert got == {(1, 2): 3, (2, 1): 3, (2, 3): 1, (3, 2): 1, (1, 3): 2, (3, 1): 2, (1, 1): 2}
