"""Filter audit, Merkle manifest and exact dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import exact_dedup, filter_audit, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, n long, tree string, pos long, run long, digest string"
EXTRA = ("x", 7, "y", 8, 9, "z")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(90)] + ["Été", "NATO", "a|b", "naïve", "😀", "c"]
    line = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=n))
    texts = [None, "", " \n", "a b", "ab", " a\tb ", "A B", "é\x0bé", "éé", " ", "AAA aaa", "#", line(9000), line(250), line(400)]
    texts += [line(rng.randint(1, 300)) for _ in range(40)]
    texts += rng.choices(texts, k=60) + ["the same line"] * 90
    found = [(i, t, rng.choice(["en", "de", "", None, "zh"])) for i, t in enumerate(texts)]
    found += [(3, "a b", "en"), (3, "a b", "en"), (3, "other", "en"), (None, "a b", "de"), (None, None, None), (None, "lone", "en"), (None, "lone", "en")]
    rng.shuffle(found)
    return [(i, t, lang, f"s{j % 3}" if j % 7 else None, len(t) if t and j % 5 else None) for j, (i, t, lang) in enumerate(found)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOC).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_filter_audit(spark, docs, rows):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, None), (9, 1, None)]
    marks = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], q or 0), max(marks[i][1], t or 0)]
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[t or ""].append(i)
    told = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w, given = words(t), [x for x in ids[t] if x is not None]
        again = bool(given) and (i is None or i > min(given))
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": again}
        told.append((lang or "", {k for k, v in fails.items() if v}, *(marks[i] if i is not None else [0, 0])))
    assert {c for _, f, *_ in told for c in f} == set("ABCDE")
    want, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order):
            for part in {p for p, *_ in told}:
                got = [0] * 6
                for p, fails, good, toxic in told:
                    if p == part:
                        earlier, failing = bool(fails & set(order[:step])), letter in fails
                        removed = failing and not earlier
                        for k, v in enumerate((not failing and not earlier, removed, failing and earlier, fails == {letter}, removed and good, removed and toxic)):
                            got[k] += bool(v)
                want[part, order, step + 1] = got
                shapley[part, letter] += got[1]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audited(docs, table).collect()}
    assert found.keys() == want.keys()
    for (part, order, step), r in found.items():
        assert [r[c] for c in filter_audit.OUTCOMES] == want[part, order, step]
        assert r.shapley == shapley[part, order[step - 1]]


def test_packed_counters_do_not_overflow(spark):
    big = (1 << 40) + 12345
    counts = spark.createDataFrame([("p", 31, True, True, big), ("p", 0, False, False, big), ("p", 16, True, False, 3), ("q", 1, False, True, 1)], "part string, mask int, good boolean, toxic boolean, n long")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(counts.repartition(4)).collect()}
    assert len(got) == 1200
    first, second = got["p", "EABCD", 1], got["p", "AEBCD", 2]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.toxic_lost) == (big, big + 3, 0, 3, big + 3, big)
    assert (second.kept, second.removed, second.redundant, second.good_lost) == (big, 3, big, 3)
    assert sum(got["p", "ABCDE", s].shapley for s in range(1, 6)) == 120 * (2 * big + 3 - big)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run_of(nodes, at):
    return nodes[at - at % 8 : at], nodes[at + 1 : at - at % 8 + 8]


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps_of(levels, at):
    for nodes in levels[:-1]:
        yield run_of(nodes, at)
        at //= 8


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_merkle_manifest(docs, rows, depth):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: digest("".join(map(part, (i, s, g, n, t))))
    trees = defaultdict(list)
    for i, t, lang, source, n in rows:
        trees[lang].append((i is not None, i or 0, leaf(i, source, lang, n, t), i, leaf(i, source, lang, n, t.replace("w", "v") if t else t)))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    levels = {}
    for g in names:
        trees[g].sort(key=lambda x: x[:3])
        levels[g] = climb([x[2] for x in trees[g]])
    crown = climb([levels[g][-1][0] for g in names])
    want = []
    for k, g in enumerate(names):
        for at, (_, _, node, i, h) in enumerate(trees[g]):
            path = [*steps_of(levels[g], at), *steps_of(crown, k)]
            for left, right in path:
                h = digest("".join(left) + h + "".join(right))
            want.append((i, g, at, node, levels[g][-1][0], crown[-1][0], tuple(("".join(a), "".join(b)) for a, b in path), h, h == crown[-1][0]))
    found = merkle.manifest(docs, F.regexp_replace("text", "w", "v"), depth=depth).collect()
    assert Counter(tuple(tuple(map(tuple, v)) if isinstance(v, list) else v for v in r) for r in found) == Counter(want)
    assert {r.verified for r in found} == {True, False}


def test_merkle_of_one_row_and_whole_superblocks(spark):
    one = merkle.manifest(spark.createDataFrame([(1, "t", None, None, None, *EXTRA)], DOC)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == [] and one.verified
    for n in (63, 64, 65, 513):
        many = spark.range(n).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'s' as source", "id as n_chars")
        got = merkle.manifest(many, depth=2).orderBy("position").collect()
        assert got[0].root == climb([r.leaf for r in got])[-1][0] and all(r.verified for r in got) and [r.doc_id for r in got] == list(range(n))


@pytest.mark.parametrize("fan", [2, 16])
def test_exact_copies(docs, rows, fan, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 16)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for bare, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            want[m[3], members[0][3], len(members), k == 0, digest(bare)] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_copies(docs, fan=fan).collect()) == want


@pytest.mark.parametrize("parts", [1, 16, 17, 40, 300])
def test_exact_copies_rounds(spark, parts):
    """Any number of merge rounds: one for up to 16 runs, two up to 256, three beyond."""
    docs = spark.range(0, 1200, 1, parts).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    want = Counter((i, i % 500, 3 if i % 500 < 200 else 2, i < 500, digest(f"text{i % 500}")) for i in range(1200))
    assert Counter(tuple(r) for r in exact_dedup.exact_copies(docs).collect()) == want


def test_merge_keeps_digest_bytes():
    rows = np.zeros(2, exact_dedup.RECORD)
    rows["digest"] = np.frombuffer(bytes(range(64)), ">u8").reshape(-1, 4)
    rows["rows"] = 1
    once = exact_dedup.merge([rows])
    assert once.tobytes() == rows.tobytes()
    assert exact_dedup.merge([once, once])["digest"].tobytes() == rows["digest"].tobytes()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(empty, labels).count() == 0
    assert merkle.manifest(empty).count() == 0
    assert exact_dedup.exact_copies(empty).count() == 0
