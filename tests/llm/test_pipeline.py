"""Stages of the corpus pipeline where ids repeat or are null."""

from collections import Counter

import corpus_pipeline as pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def line(k, n=60):
    return " ".join(f"{k}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))


def kept(stage, spark, texts, sf_dir=""):
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in texts], DOC).repartition(3)
    got = stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in got.collect())


def test_decontamination_of_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, line("q", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty, clean = f"{line('a')} {line('q', 12)}", line("b")
    texts = [(None, dirty), (None, clean), (5, dirty), (5, clean), (5, clean), (6, None), (7, "")]
    assert kept(pipeline.decontamination, spark, texts, str(tmp_path)) == Counter(x for x in texts if x[1] != dirty)


def test_minhash_dedup_of_null_and_repeated_ids(spark):
    a, b, c = line("a"), line("b"), line("c")
    texts = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (4, a), (4, line("d")), (9, ""), (9, None)]
    want = [(1, a), (2, b), (None, c), (4, line("d")), (9, ""), (9, None)]
    assert kept(pipeline.minhash_dedup, spark, texts) == Counter(want)
