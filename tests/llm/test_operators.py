"""Corpus operators against brute force on small tables with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import chat, decontaminate, embeddings, language, license, mixing, near_dedup, quality, repeats, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long, component string, band int, rep int"


def sha(words):
    return hashlib.sha256(b" ".join(words)).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "x<y", "[INST]"]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = line(60)
    base = line(200)
    near = base.split()
    near[100] = "changed"
    out = [line(80), shared + " " + line(30), line(20) + "\n" + shared, base, base, " ".join(near), None, "", "  \n", "123 456", "one two", "one two", line(9000)]
    out += [line(rng.randint(1, 60)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}" if i % 5 else None, None, "c", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_repeats(docs, texts):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    got = by_id(repeats.repeated_words(docs))
    for doc, w in enumerate(split):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(w), gone.sum(), sha(left))
    assert sum(r.n_removed for r in got.values()) > 120


def test_repeats_inside_one_text(spark):
    rows = [(1, "a " * 50, None), (None, "b c " * 30, None)]
    got = by_id(repeats.repeated_words(spark.createDataFrame(rows, "doc_id long, text string, at int")))
    assert (got[1].n_removed, got[None].n_removed) == (50, 60)


def test_near_duplicates(docs, texts):
    sets = []
    for t in texts:
        w = words(t.lower() if t and t.isascii() else t)
        w = [x.lower() for x in w]
        n = min(3, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    label = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    got = by_id(near_dedup.near_duplicates(docs, n=3, percent=85))
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(sets))] == [
        (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, label, strict=True))
    ]


def test_near_duplicates_of_edge_rows(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination(spark, docs, texts):
    rng = random.Random(3)
    items = [(i, " ".join((texts[i % 6] or "").split()[k : k + n])) for i, (k, n) in enumerate((rng.randint(0, 30), rng.choice([1, 2, 9, 10, 11, 30])) for _ in range(12))]
    items += [(None, "one"), (99, None), (98, "..."), (11, "one two")]
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for name, t in items:
        w = re.findall(pattern, (t or "").encode().lower())
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if name is None else [str(name)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 200):
        got = by_id(decontaminate.contaminated(docs, bench, block_bytes=block))
        for doc, t in enumerate(texts):
            w = re.findall(pattern, (t or "").encode().lower())
            hit, names = np.zeros(len(w), bool), set()
            for p, held in windows.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit[k : k + len(p)] = True
                        names |= held
            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            r = got[doc]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), hit.sum(), len(names), digest, bool(hit.any()))


def test_index_finds_every_place():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 3000).astype(np.int32)
    ids[1000:1400] = ids[0:400]
    ids[-1] = 0
    index = decontaminate.Index(ids, 4)
    for phrase in ([1], [2, 3], [1, 2, 3], [3, 3, 1, 2]):
        lo, hi = index.search(np.array([phrase]))
        found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert found == [i for i in range(len(ids)) if ids[i : i + len(phrase)].tolist() == phrase]


@pytest.mark.parametrize("spread", [0.02, 0.06, 1.0])
def test_embeddings(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    v = centres[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, 12))
    v[5] = v[4]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] * 12, 0), (1003, [None] * 12, 0), (1004, [1.0, 2.0], 0), (1005, [2.0, 4.0], 0)]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(300)
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=300)) for i in range(300)])
        if (new == label).all():
            break
        label = new
    got = by_id(embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int"), block=90, centres=8), "vec_id")
    assert [(got[i].n_links, got[i].component_id) for i in range(300)] == list(zip(link.sum(1), label, strict=True))
    assert [got[i].n_links for i in range(1000, 1006)] == [0, 0, 0, 0, 1, 1]


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\e\\l\\\\b", "<r:x>", "", None, "\n", "[[<<>>]]\\"]
    rows = [(c, k, role, t) for c, t in enumerate(hard) for k, role in enumerate(("system", "user", "assistant", "odd<>role", None))]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, "assistant", "a"), (52, 0, "user", "q")]
    got = by_id(chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))), "conv_id")
    for c, t in enumerate(hard):
        assert [tuple(x) for x in got[c].turns] == [(r, t or "") for r in ("system", "user", "assistant", "odd<>role", "")]
        assert got[c].loss_text == (t or "")
    assert [got[c].valid for c in (0, 50, 51, 52)] == [False, True, False, False]


def test_language(spark):
    rng = random.Random(1)
    en, de = ("the and of that with", "der und das nicht mit")
    say = lambda v, n: " ".join(rng.choices(v.split(), k=n))
    rows = [(i, say(en if i % 2 else de, 30), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 !", "de"), (102, say(en, 60) + " " + say(de, 60), None), (None, say(en, 20), "en")]
    got = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and got[i].lang_score > 0.9 for i in range(60))
    assert got[100].lang_pred == got[101].lang_pred == "und"
    assert set(got[102].lang_share) == {"en", "de"} and abs(got[102].lang_share["en"] - 0.5) < 0.15
    none = language.identify(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.count() == 0


def test_mixing_budget(spark):
    rows = [("hub", "en", "a0", 100), ("hub", "de", "b0", 1000), ("web", "en", "c", 1000), ("web", "de", "d", 50)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    from pyspark.sql import functions as F

    got = {r.source: r.grant for r in mixing.budgets(leaves, F.lit(1200), {"domain": {"hub": 1.0, "web": 2.0}}, 1).collect()}
    assert got == pytest.approx({"a0": 100, "b0": 300, "c": 750, "d": 50})


def test_mixing_rows(docs, texts):
    got = mixing.mixed(docs, fraction=0.8, epochs=2).collect()
    assert len(got) == len({(r.doc_id, r.mix_epoch) for r in got})
    total = sum(len(words(t)) for t in texts)
    longest = max(len(words(t)) for t in texts)
    assert 0.8 * total <= sum(r.mix_tokens for r in got) <= 0.8 * total + 12 * longest
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_sharding(docs, texts):
    got = sharding.packed(docs, shards=4).collect()
    assert len(got) == len(texts) and sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for t in texts)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    home = {}
    for r in got:
        home.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for t, x in home.items() if t is None or len(t) < 1000)
    assert sharding.packed(docs.limit(0)).count() == 0


def test_best_fit():
    assert sharding.best_fit([(5, "a"), (4, "b"), (3, "c"), (2, "d")], 7) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_quality(spark):
    rows = [(i, " ".join(random.Random(i).choices(("good fine solid" if i % 2 else "junk spam noise").split(), k=20)), i) for i in range(100)] + [(200, None, 1), (201, "", 1)]
    labels = [(i, i % 2, int(i in (1, 3)), 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _q int")
    got = by_id(quality.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")))
    assert len(got) == 102 and not got[1].kept and not got[3].kept
    assert sum(r.kept for i, r in got.items() if i < 100 and i % 2) > 40
    assert quality.resampled(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_quality_rejects_unlabelled_toxic_texts(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    slurs = [f"slur{i}" for i in range(5)]
    rows = []
    for i in range(600):
        w = rng.choices(vocabulary, k=40)
        if i % 4 == 0:
            w[5:7] = rng.sample(slurs, 2)
            w[6] += rng.choice(["", ",", "!"])
        rows.append((i, " ".join(w)))
    labels = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(quality.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert not any(got[i].kept for i in range(0, 600, 4))
    assert sum(r.kept for r in got.values()) == 300 and sum(got[i].kept for i in range(300, 600)) > 100


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(500))
    rows = [(i, f"{' '.join(filler.split()[: i * 7])} {t} {filler}") for i, t in enumerate(license.NOTICES.values())]
    rows += [(10, filler), (11, None), (12, ""), (13, "MIT License")]
    got = by_id(license.licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(name in got[i].licenses for i, name in enumerate(license.NOTICES))
    assert all(got[i].n_licenses == 0 for i in range(10, 14))
