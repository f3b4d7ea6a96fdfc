"""Quality sampling where ids repeat or are null, and its counts against plain ones."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandframe.llm import quality
from strandframe.llm.words import WordHash


def test_rows_of_one_id_draw_alone(spark):
    rows = [(None, f"text number {i}") for i in range(40)] + [(7, f"other words {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.resampled(docs, labels).collect()
    assert len({r.gumbel_key for r in got}) == 80 and sum(r.kept for r in got) == 40
    assert 0 < sum(r.kept for r in got if r.doc_id is None) < 40


def test_cell_counts(spark):
    texts = ["a b c a b", "", None, "x", "a b"] * 9
    docs = spark.createDataFrame([(t, i % 3 == 0) for i, t in enumerate(texts)], "text string, good boolean").repartition(4)
    want = [Counter(), Counter()]
    for i, t in enumerate(texts):
        cells = quality._cells(t, WordHash()).tolist()
        want[0].update(cells)
        want[1].update(cells if i % 3 == 0 else [])
    for got, due in zip(quality.cell_counts(docs, F.col("good")), want):
        assert {k: got[k] for k in np.flatnonzero(got)} == due


def test_least_number_of_telling_texts():
    for n_bad, n_fine, needed in ((5, 9, 3.0), (500, 80, 20.0), (3, 1000, 60.0)):
        enough = quality._enough(n_bad, n_fine, needed)
        passes = [b for b in range(1, n_bad + 1) if quality.evidence(np.array([b]), np.array([0]), n_bad, n_fine)[0] > needed]
        assert enough == (passes[0] if passes else n_bad + 1)


def test_labels_by_shuffle_give_the_same(spark, monkeypatch):
    words = "good fine calm bad vile awful plain day night tree".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * k) % 10] for k in range(1, 20))) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 120, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    once = sorted(map(tuple, quality.resampled(docs, labels).collect()))
    monkeypatch.setattr(quality, "LABEL_BYTES", 0)
    assert sorted(map(tuple, quality.resampled(docs, labels).collect())) == once and len(once) == 120
    assert quality.resampled(docs.limit(0), labels).count() == 0
