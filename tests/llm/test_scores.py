from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pandas as pd
import pytest

from listingmart.llm import lm, toxicity


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def held_out(i):
    return zlib.crc32(b"" if i is None or i != i else str(int(i)).encode()) % 10 == 0


def check_base(rows, docs):
    counts = collections.Counter(t for i, x in docs if not held_out(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (
            round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), 5), len(tokens(x)),
            sum(counts[t] > 0 for t in tokens(x)), n, held_out(i)
        ) for i,
        x in docs
    )
    got = sorted((round(r.base_score, 5), r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in rows.itertuples())
    assert [w[1:] for w in want] == [g[1:] for g in got]
    assert [w[0] for w in want] == pytest.approx([g[0] for g in got])


def test_base_and_gain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = lm.score_documents(docs).toPandas()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows.n_states.iloc[0] > 0 and rows[rows.held_out].score.sum() > rows[rows.held_out].base_score.sum()


def test_tree_is_a_distribution_and_matches_brute_force(spark, monkeypatch):
    """Score against direct counts of every context, over parts so small that all of the dealing is used."""
    monkeypatch.setattr(lm, "PART", 50)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(9)]
    texts = []
    for _ in range(60):
        t, w = [], 0
        for _ in range(30):
            w = (w + 1) % 9 if rng.random() < 0.8 else int(rng.integers(9))
            t.append(words[w])
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm.score_documents(docs, depth=2, share=0.01, gain=5.0).toPandas()
    check_base(rows, list(enumerate(texts)))
    out = rows[rows.held_out]
    assert rows.n_states.iloc[0] >= 9 and out.score.sum() > out.base_score.sum() + 0.2 * out.n_tokens.sum()
    counts = collections.Counter()
    for i, x in enumerate(texts):
        if not held_out(i):
            t = tokens(x)
            counts.update((a, b) for a, b in zip(t, t[1:]))
    for a in words:
        follow = {b: c for (x, b), c in counts.items() if x == a.encode()}
        assert max(follow, key=follow.get) == words[(words.index(a) + 1) % 9].encode()


def test_lm_awkward(awkward, nothing):
    rows = lm.score_documents(awkward).toPandas()
    check_base(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert np.isfinite(rows.score).all()
    assert lm.score_documents(nothing).count() == 0
    assert lm.score_documents(awkward.filter("doc_id is null")).toPandas().train_tokens.tolist() == [0, 0]


def test_one_model_however_documents_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [
        lm.score_documents(docs.repartition(k, "doc_id"), part=n).toPandas().sort_values("doc_id", ignore_index=True) for k,
        n in ((1, 10**9), (8, 3000), (211, 1))
    ]
    assert all(found[0].equals(other) for other in found[1:])
    want, states = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], 3, lm.GAIN)
    assert found[0].n_states.iloc[0] == len(states) > 0
    assert found[0].score.tolist() == pytest.approx([want[i] for i in found[0].doc_id], abs=1e-7)


def test_far_ids(spark, far_ids):
    far = 2**53 + 1
    for rows in (lm.score_documents(far_ids), toxicity.score_documents(far_ids, toxicity.fit(corpus()))):
        assert {r["doc_id"] for r in rows.collect()} == {far, None, -far}


def test_scores_by_definition(spark):
    """Marginals, their summary and the logistic function, word by word."""
    tagger = toxicity.fit(corpus())
    docs = [(i, t) for i, (t, _) in enumerate(corpus(60, seed=5))] + [(98, "bligg"), (99, "")]
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), tagger).collect()}
    for i, t in docs:
        words = t.lower().split()
        x = np.zeros(3)
        if words:
            emit = [tagger.bias + sum(tagger.weights.get(f, 0.0) for f in toxicity.features(toxicity.normal(w))) for w in words]
            p, _ = chain(np.clip(emit, -30, 30), tagger.move, tagger.begin)
            x = np.array([p.max(), np.log1p(p.sum()), p.mean()])
        want = 1 / (1 + np.exp(-(tagger.logit[0] + x @ tagger.logit[1:])))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6) and got[i]["predicted"] == int(want >= 0.7)


def chain(emit, move, begin):
    w = np.stack([np.ones(len(emit)), np.exp(emit)], 1)
    a = [begin * w[0]]
    for k in range(1, len(emit)):
        a.append((a[-1] @ move) * w[k])
    b = [np.ones(2)]
    for k in range(len(emit) - 1, 0, -1):
        b.insert(0, move @ (w[k] * b[0]))
    return (np.array(a) * np.array(b))[:, 1] / a[-1].sum(), np.log(a[-1].sum())


@pytest.mark.parametrize("starts", [[0], [0, 1, 2, 30], [0, 55]])
def test_forward_backward(starts):
    rng = np.random.default_rng(len(starts))
    emit, move, begin = rng.normal(size=57) * 3, np.exp(rng.normal(size=(2, 2))), np.array([0.3, 0.7])
    p, pairs, z = toxicity.scan(emit, np.array(starts), move, begin, pairs=True)
    want = [chain(emit[a:b], move, begin) for a, b in zip(starts, [*starts[1:], 57])]
    assert np.allclose(p, np.concatenate([w[0] for w in want])) and z == pytest.approx(sum(w[1] for w in want))
    assert pairs.sum() == pytest.approx(57 - len(starts))


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    plain, stems = [f"word{i}" for i in range(200)], ["bligg", "frack", "snorv"]
    rows = []
    for i in range(n):
        t = list(rng.choice(plain, 40))
        if y := int(i % 4 == 0):
            for _ in range(4):
                t[rng.integers(40)] = rng.choice(stems) + rng.choice(["", "en", "ung", "isch", "!!", f"q{i}"])
        rows.append((" ".join(t), y))
    return rows


def test_tagger_on_unseen_forms():
    tagger = toxicity.fit(corpus())
    test = corpus(seed=9)
    score = tagger.score(tagger.summary([t for t, _ in test]))
    y = np.array([y for _, y in test])
    assert ((score >= 0.7) == (y == 1)).mean() > 0.99
    text = "word1 word2 \n bligghaft word3"
    found = [s for _, p in tagger.tagged([text], toxicity.Memo(tagger)) for s in toxicity.spans(text, p)]
    assert [text[s["start"] : s["end"]] for s in found] == ["bligghaft"]


def test_tagger_without_a_class():
    assert toxicity.fit([("a b", 0)]) is None and toxicity.fit([]) is None


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = toxicity.op4_toxicity(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    out = rows[rows.held_out]
    assert ((out.predicted == 1) == (out.toxic == 1)).mean() > 0.94 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()


def test_toxicity_awkward(spark, awkward, nothing):
    tagger = toxicity.fit(corpus())
    rows = toxicity.score_documents(awkward, tagger).toPandas()
    assert len(rows) == 11 and rows.score.between(0, 1).all() and rows.doc_id.isna().sum() == 2
    assert toxicity.score_documents(nothing, tagger).count() == 0 and toxicity.score_documents(awkward, None).toPandas().score.max() == 0
    kept = toxicity.clean_documents(awkward, tagger)
    assert kept.columns == awkward.columns and kept.count() == (rows.score < 0.7).sum() >= 9
    labels = spark.createDataFrame([(1, None), (1, 1), (1, 0), (None, 1), (6, 0)], "doc_id long, toxic int")
    assert all(y in (0, 1) for _, y in toxicity.sample(awkward, labels)) and toxicity.sample(nothing, labels) == []


def brute_force(docs, depth, gain):
    """Scores and kept contexts by the definition, from direct counts of every context."""
    follow, doc_tokens = collections.defaultdict(collections.Counter), [(i, tokens(x)) for i, x in docs]
    for i, t in doc_tokens:
        if not held_out(i):
            for k, w in enumerate(t):
                for d in range(min(k, depth) + 1):
                    follow[tuple(t[k - d : k])][w] += 1
    total, v = sum(follow[()].values()), len(follow[()])

    def chance(s, w):
        if not s:
            return follow[()][w] / total
        n = sum(follow[s].values())
        return (follow[s][w] + n * chance(s[1:], w)) / (2 * n)

    states = {}
    for s in list(follow):
        n = sum(follow[s].values())
        if s and n > 1:
            worth = [
                sum(
                    c * (math.log(c - 1 + a * n * (p := chance(s[1:], w))) - math.log(p)) for w, c in follow[s].items()
                ) - n * math.log(n - 1 + a * n) for a in lm.WEIGHTS
            ]
            if max(worth) >= gain:
                states[s] = (n, n * lm.WEIGHTS[worth.index(max(worth))])
    out = {}
    for i, t in doc_tokens:
        out[i] = 0.0
        for k, w in enumerate(t):
            p = (follow[()][w] + 0.1) / (total + 0.1 * (v + 1))
            for d in range(1, min(k, depth) + 1):
                if (s := tuple(t[k - d : k])) in states:
                    n, mass = states[s]
                    p = (follow[s][w] + mass * p) / (n + mass)
            out[i] += math.log10(p)
    return out, states


def rare_phrase():
    """60 000 symbols; a phrase in 12 documents, far from every 5000th symbol, and the rest without order."""
    rng = np.random.default_rng(3)
    rows = [[f"v{x}" for x in rng.integers(3000, size=199)] for _ in range(300)]
    for i in range(0, 300, 25):
        rows[i][50:56] = "one rare phrase of six words".split()
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_contexts_do_not_need_a_share_of_the_corpus(spark):
    docs = rare_phrase()
    want, states = brute_force(docs, 3, lm.GAIN)
    assert (b"one", b"rare", b"phrase") in states or (b"rare",) in states
    rows = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).toPandas()
    assert rows.n_states.iloc[0] == len(states)
    assert [want[i] for i in rows.doc_id] == pytest.approx(rows.score.tolist(), abs=1e-8)


def test_contexts_count_over_all_parts(spark):
    """A context is spread thinly over the parts; a caller's share is of the whole corpus, however files fall into parts."""
    docs = spark.createDataFrame(rare_phrase(), "doc_id long, text string")
    one, many = (
        lm.score_documents(docs.repartition(k), share=2.5e-4 / 1.5, gain=5.0, part=n).toPandas().sort_values("doc_id") for k,
        n in ((1, 10**6), (6, 300))
    )
    assert one.n_states.iloc[0] == many.n_states.iloc[0] > 0
    assert one.score.tolist() == pytest.approx(many.score.tolist(), abs=1e-8)
