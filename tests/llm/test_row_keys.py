"""Near duplicates where ids repeat or are null."""

from collections import Counter

from strandframe.llm import near_dedup

SCHEMA = "doc_id long, text string"


def line(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_near_duplicates_by_row(spark):
    a, b, c, d = (line(k) for k in "abcd")
    near = b.replace("wbx59", "other")
    rows = [(1, a), (7, a), (7, near), (8, b), (3, c), (3, c), (3, c), (None, d), (None, d), (9, ""), (9, "")]
    rows += [(20, f"{a} {c}"), (20, f"{b} {c}"), (21, f"{a} {c}"), (22, f"{b} {c}")]
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), n=3, percent=85).select("doc_id", "component_id", "stays").collect())
    want = [(1, 1, True), (7, 1, False), (7, 7, True), (8, 7, False), (3, 3, True), (3, 3, False), (3, 3, False), (None, None, True), (None, None, False)]
    want += [(9, 9, True), (9, 9, True), (20, 20, True), (20, 20, True), (21, 20, False), (22, 20, False)]
    assert got == Counter(want)


def test_kept_follows_the_doc_id(spark):
    a, b = line("a"), line("b")
    rows = [(3, a), (3, a), (4, a), (None, b), (None, b), (5, None)]
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id", "kept", "stays").collect())
    assert got == Counter([(3, 3, True, True), (3, 3, True, False), (4, 3, False, False), (None, None, True, True), (None, None, True, False), (5, 5, True, True)])
