"""The corpus pipeline's stages against their operators, each on its own input."""

import hashlib

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_llm import COLS, EMPTY, ODD, brute, docs


def test_pipeline(spark, tmp_path):
    g = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(240):
        w = ["".join(g.choice(list("abcdefghij"), int(g.integers(3, 8)))) for _ in range(60)]
        bad, toxic = i % 6 == 0, i % 5 == 1
        text = " ".join([x + "###" for x in w] if bad else [*w, "zugwurm", "vexling"] if toxic else w)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(500 + i, r[1] + " tail", *r[2:]) for i, r in enumerate(rows[:40])] + [(600, None, None, None, None)]
    spark.createDataFrame(rows, COLS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = cp.table(spark, str(tmp_path), "documents")
    steps = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(d)
        if k < len(cp.STAGES) - 1:
            assert d.columns == cp.COLUMNS
    text = {r[0]: r[1] for r in rows}
    kept = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert not any("###" in (text[i] or "") for i in kept[0])
    assert sum("zugwurm" in (text[i] or "") for i in kept[1]) <= 2
    groups = brute([(i, text[i]) for i in kept[1]])
    assert kept[2] == {i for i in kept[1] if groups[i][1] == i}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert steps[4].where(F.col("n_tokens") > 0).count() >= len(kept[4]) - 1
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == kept[4]


def test_rows_without_an_id_of_their_own(spark):
    def text(i):
        return " ".join(f"w{i}x{j}" for j in range(40))

    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(1) + " tail"), (3, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (None, text(5)), (None, None), (4, ""), (4, None), (5, text(2) + " end")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLS)
    got = cp.near_duplicates_stage(spark, d, "").collect()
    kept = [(r.doc_id, r.text) for r in got]
    assert len(kept) == len(set(kept)) == 8
    assert {(1, text(1)), (3, text(3)), (None, text(4)), (None, text(5)), (None, None), (4, ""), (4, None)} <= set(kept)
    assert len({(1, text(2)), (5, text(2) + " end")} & set(kept)) == 1


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    """A folder with labels for documents 2000 and on: junk is of quality 0, two words are toxic."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(2000 + i, int(i % 4 != 0), int(i % 4 == 1)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def corpus():
    g = np.random.default_rng(4)
    rows = []
    for i in range(240):
        w = ["".join(g.choice(list("abcdefghij"), int(g.integers(3, 8)))) for _ in range(60)]
        rows.append((2000 + i, " ".join([x + "###" for x in w] if i % 4 == 0 else [*w, "zugwurm", "vexling"] if i % 4 == 1 else w)))
    return rows


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_odd_rows_in_every_stage(spark, labels_dir, k):
    stage = cp.STAGES[k][1]
    rows = [*corpus(), *ODD, (None, "without an id"), (None, None), (7, " lead"), (7, "another text of the id")]
    got = [tuple(r) for r in stage(spark, docs(spark, rows, True), labels_dir).collect()]
    assert stage(spark, docs(spark, EMPTY, True), labels_dir).count() == 0
    if k == len(cp.STAGES) - 1:
        assert len(got) == len(rows)
        assert sorted((r[0], r[3]) for r in got if r[0] is not None) == sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows if i is not None)
        return
    assert stage(spark, docs(spark, rows, True), labels_dir).columns == cp.COLUMNS
    kept = [(r[0], r[1]) for r in got]
    assert set(kept) <= set(rows)
    if k == 0:
        assert not any("###" in (t or "") for _, t in kept) and len(kept) > 170
    elif k == 1:
        assert not any("zugwurm" in (t or "") for _, t in kept) and len([1 for i, _ in kept if (i or 0) >= 2000]) > 170
    elif k == 2:
        assert len(kept) == len(set(kept)) and {(None, "without an id"), (None, None), (0, None), (1, "")} <= set(kept)
        assert {(7, " lead"), (7, "another text of the id")} <= set(kept) and len([1 for i, _ in kept if i in (4, 5)]) == 1
    if k != 2:  # repeated rows stay or go together
        assert all(kept.count(r) in (0, rows.count(r)) for r in set(rows))

