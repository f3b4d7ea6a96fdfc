"""Language search without caps, letters by Unicode category, and texts without a known trigram."""

import numpy as np

from strandframe.llm import language


def plain(cells, logp, rounds=30):
    """The same growth of the language set, trying every language at every step."""
    at, c = np.unique(cells, return_counts=True)
    p, n = np.exp(logp[:, at]), c.sum()
    penalty = 0.5 * np.log(n + 1)
    chosen = [int((logp[:, at] @ c).argmax())]
    share, best = np.ones(1), float(logp[chosen[0], at] @ c)
    while len(chosen) < len(logp):
        trials = []
        for add in set(range(len(logp))) - set(chosen):
            q, w = p[[*chosen, add]], np.append(share * 0.9, 0.1)
            for _ in range(rounds):
                w2 = w * (q @ (c / (w @ q))) / n
                done = np.abs(w2 - w).max() < 1e-4
                w = w2
                if done:
                    break
            trials.append((float(np.log(w @ q) @ c), -add, w))
        gain, add, w = max(trials, key=lambda t: t[:2])
        if gain <= best + penalty:
            break
        best, share, chosen = gain, w, [*chosen, -add]
    out = np.zeros(len(logp))
    out[chosen] = share
    return out


def test_set_search_tries_every_language_that_can_gain():
    rng = np.random.default_rng(2)
    cells = 300
    for _ in range(25):
        logp = np.log(rng.dirichlet(np.full(cells, 0.2), 9) * 0.9 + 0.1 / cells)
        mix = rng.dirichlet(np.full(9, 0.25))
        text = rng.choice(cells, 400, p=mix @ np.exp(logp) / (mix @ np.exp(logp)).sum())
        assert np.allclose(language.proportions(text, logp), plain(text, logp), atol=2e-3)


def test_letters_and_unknown_trigrams(spark):
    train = [(i, "the cat sat on the mat and the dog", "en") for i in range(1, 30)] + [(i, "der hund und die katze", "de") for i in range(30, 40)]
    asked = [(100, "½ ² ①"), (101, "²"), (102, "12_34 !?"), (103, None), (104, ""), (105, "Ⅷ"), (106, "the dog"), (107, "ж"), (108, "a"), (109, "der hund")]
    docs = spark.createDataFrame(train + [(i, t, None) for i, t in asked], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(docs).where("doc_id >= 100").collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102, 103, 104, 105))
    assert got[106][0] == "en" and got[109][0] == "de"
    assert got[107][0] == "en" and 0.5 < got[107][1] < 1  # the share of the training trigrams
