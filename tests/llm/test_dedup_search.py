from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from listingmart.llm import decontam, simhash, topk, urls

FAR = 2**53 + 1


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(docs):
    """Component by brute force: smallest id, nulls last."""
    fps = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    low = {k: min((d[0] for d, x in zip(docs, label) if x == k and d[0] is not None), default=None) for k in set(label)}
    return fps, [low[x] for x in label]


def test_components(spark, awkward, nothing):
    rng = random.Random(0)
    words = [f"v{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(80)] for _ in range(12)]
    docs = [(i, " ".join(w if rng.random() > 0.01 else "zz" for w in base[i % 12])) for i in range(60)]
    docs += [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect() if r["text"] is None or len(r["text"]) < 100]
    fps, low = classes(docs)
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(zip([d[0] for d in docs], fps, low), key=key)
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    # of the blank texts, the four with the same words, and the others one row each
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "2", "5", "7", "8"]


def test_clashing_columns_keep_their_values(awkward):
    kept = simhash.one_of_each(awkward)
    assert {(r["_key"], r["fp"], r["size"]) for r in kept.collect()} == {(9, 9, 9)}


def test_far_ids(spark, far_ids):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(far_ids).collect()}
    assert got == {(FAR, FAR), (None, FAR), (-FAR, -FAR)}
    assert {r["doc_id"] for r in simhash.one_of_each(far_ids).collect()} == {FAR, -FAR}
    bench = spark.createDataFrame([(FAR + 2, "b c d e f g"), (None, "b c d e f g")], "item_id long, text string")
    assert {
        (r["doc_id"], r["item_id"]) for r in decontam.contaminated(far_ids, bench).collect()
    } == {(d, i) for d in (FAR, None) for i in (FAR + 2, None)}
    pages = spark.createDataFrame([(FAR, "x://b.com/y"), (None, "x://b.org/y")], "page_id long, url string").coalesce(1)
    assert {r["page_id"] for r in urls.judge(pages).collect()} == {FAR, None}


@pytest.mark.parametrize("block", [3, 17])
def test_cut_tiles(spark, block):
    """Blocks so small that most tiles are cut, against all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(
        np.concatenate(
            [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(5)] + [np.arange(60, dtype=np.uint64)]
        )
    )
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.linked(fps, 3, block)).collect()}
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 3)
    label = np.arange(len(x))
    node, root = simhash.forest(i, j, len(x))
    label[node] = root
    signed = x.view(np.int64)
    least = {k: min(int(signed[n]) for n in np.flatnonzero(label == k)) for k in set(label.tolist())}
    assert all(found.get(int(v), int(v)) == least[int(k)] for v, k in zip(signed, label, strict=True))


def test_tiles(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for _ in range(6)]))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 3)
    monkeypatch.setattr(simhash, "WHOLE", 50)
    every = np.arange(len(x))
    found = list(simhash.links(x, every, every, 3))
    label = np.arange(len(x))
    node, root = simhash.forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(x))
    label[node] = root
    want = np.arange(len(x))
    node, root = simhash.forest(i, j, len(x))
    want[node] = root
    assert (label == want).all() and sum(len(f[0]) for f in found) < len(i)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_decontamination(spark, data, awkward, nothing):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = lambda t: " " + " ".join(decontam.words_of(t)) + " "
    want = {(d, i) for d, t in rows for i, x in items if plain(x) in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert want and want <= got
    assert got == {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, items=7).collect()}
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in got}
    tests = spark.createDataFrame(
        [(1, "a b c d e f"), (None, "A, B c d e f!"), (2, None), (3, ""), (4, "..."), (5, "é ü"), (5, "é ü")], "item_id long, text string"
    )
    found = decontam.contaminated(awkward, tests).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in found) == sorted(
        [(d, i) for d in ("1", "None", "6", "6") for i in ("1", "None")] + [("7", "5"), ("7", "5")]
    )
    assert decontam.contaminated(nothing, tests).count() == 0 and decontam.contaminated(awkward, tests.filter("item_id > 9")).count() == 0


def test_near_copy_and_clean(spark):
    item = [f"q{i}" for i in range(30)]
    edited = [*item[:8], "other", *item[9:]]
    docs = [
        (1, "x " * 50 + " ".join(item) + " y" * 50), (2, "x " * 70 + " ".join(edited)), (3, " ".join(item[:14]) + " z" * 40),
        (4, " ".join(reversed(item)))
    ]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2} and got[1]["score"] == pytest.approx(1.0) and 0.8 <= got[2]["overlap"] < 1


def all_matches(docs, items):
    """Every (document, item) by the definition: BM25 of every passage and item, then the overlaps."""
    split = [(i, decontam.words_of(t)) for i, t in items if decontam.words_of(t)]
    n, mean = len(split), sum(len(w) for _, w in split) / max(1, len(split))
    df = {}
    for _, w in split:
        for t in set(w):
            df[t] = df.get(t, 0) + 1

    def weights(w):
        raw = {
            t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)
        }
        return {t: x / sum(raw.values()) for t, x in raw.items()}

    out = {}
    for i, w in split:
        own, cut, length = weights(w), -(-2 * len(w) // 3), max(16, 1 << (len(w) - 1).bit_length())
        size, stride, five = 2 * length + 10, length + 5, min(5, len(w))
        grams = {tuple(w[k : k + five]) for k in range(len(w) - five + 1)}
        for d, words in docs:
            for at in range(0, max(1, len(words) - size + stride), stride):
                p = words[at : at + size]
                here = set(p)
                score = sum(x for t, x in own.items() if t in here)
                have = {tuple(p[k : k + five]) for k in range(len(p) - five + 1)}
                shares = [len(grams & have) / len(grams)] + [len(set(part) & here) / len(set(part)) if part else 1.0 for part in (w[:cut], w[cut:])]
                if score >= 0.5 and min(shares) >= 0.8 and shares[0] > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (shares[0], score)
    return out


def test_matches_by_definition(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], decontam.words_of(r["text"] or "")) for r in docs.filter("length(text) < 20000").collect()]
    want = all_matches(rows, [(r["item_id"], r["text"]) for r in bench.collect()])
    got = {
        (r["doc_id"], r["item_id"]): (r["overlap"], r["score"]) for r in decontam.contaminated(
            docs.filter("length(text) < 20000"), bench, items=9
        ).collect()
    }
    assert set(got) == set(want) and len(want) >= 3
    assert [got[k] for k in sorted(want)] == [pytest.approx(want[k]) for k in sorted(want)]


def test_wand_skips():
    """Block maxima let WAND pass over most items."""
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice([f"c{rng.randrange(40)}", f"r{rng.randrange(3000)}"]) for _ in range(30))) for i in range(2000)]
    (index,) = decontam.Matcher.of_texts(items).indexes
    seen = decontam.Counter()
    for k in range(0, 2000, 50):
        assert k in [item for item, _ in index.search(sorted(set(index.words[k])), seen=seen)]
    assert seen["skips"] > 0 and seen["scored"] < 40 * 2000 / 20


def test_wand(data):
    items = pd.read_parquet(f"{data}/benchmark.parquet")
    matcher, rng = decontam.Matcher.of_texts(list(zip(items.item_id, items.text))), random.Random(1)
    for index in matcher.indexes:
        for _ in range(100):
            own = set(rng.choice(index.words)) | set(rng.sample(range(len(matcher.known)), 20))
            own = [t for t in sorted(rng.sample(sorted(own), rng.randrange(1, len(own)))) if t in index.items]
            score = dict.fromkeys(range(len(index.ids)), 0.0)
            for t in own:
                for k, x in zip(index.items[t], index.impact[t]):
                    score[k] += x
            want = [k for k, x in score.items() if x >= index.threshold - 1e-9]
            assert sorted(k for k, _ in index.search(own)) == want
            tops = index.tops(len(matcher.known))[own].sum(axis=0)
            assert sorted(k for k, _ in index.search(own, np.flatnonzero(tops >= index.threshold - 1e-6).tolist())) == want


def top(rows, k):
    """rows: (id, ints or None)"""
    out = []
    for q, v in rows:
        if q is not None and q % 20 == 0 and v is not None:
            best = sorted(((-int(np.dot(v, w)), c) for c, w in rows if w is not None and c is not None and c != q and len(w) == len(v)))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 100_000])
def test_top_k(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:200] = v[7]  # ties
    rows = [(i, v[i].tolist()) for i in range(300)]
    rows += [
        (1000, None), (1020, [1.0] * 7 + [float("nan")]), (1040, [1.0] * 7 + [float("inf")]), (1060, [1.0] * 7 + [None]), (None, [1.0] * 8),
        (1080, [2.0, 1.0]), (1100, [0.0] * 8), (1101, [3.0, 1.0]), (1120, [])
    ]
    df = spark.createDataFrame([(i, x, 5, 6) for i, x in rows], "vec_id long, embedding array<float>, rank int, v int")
    ints = [
        (i, None if x is None or any(y is None or not np.isfinite(y) for y in x) else [int(np.floor(64.0 * float(np.float32(y)))) for y in x]) for i,
        x in rows
    ]
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, block=block).collect()
    assert sorted(tuple(r) for r in got) == [r for r in top([x for x in ints if x[1] != []], 20)]
    assert topk.top_k(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_exclude():
    """No bound is below a score, and near one another's cluster few candidates are evaluated."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 48)) * 60
    v = np.floor(centres[rng.integers(30, size=4000)] + rng.normal(size=(4000, 48)) * 8)
    top = float((v * v).sum(axis=1).max())
    pivots = topk.Pivots.of(v[:2048], 42, top)
    q = v[:25]
    far_q, far_c = pivots.distances(q, False), pivots.distances(v, True)
    bounds = pivots.bounds((q * q).sum(axis=1), pivots.tips(far_q), pivots.tips(far_c))
    single = np.abs(np.sqrt(far_q)[:, None, :] - np.sqrt(far_c)[None]).max(axis=2)
    assert (bounds >= q @ v.T - 1e-6).all() and (bounds <= ((q * q).sum(axis=1)[:, None] + top - single**2) / 2 + 1e-5 * top + 1).all()
    floors = np.array([topk.floor_of(x, i, v[:2048], np.arange(2048), 20) for i, x in enumerate(q)])
    found = list(topk.search_block(q, np.arange(25), floors, v, np.arange(4000), pivots, far_q, far_c, 20))
    assert np.mean([f[3] for f in found]) < 400
    for i, ids, scores, _ in found:
        s = q[i] @ v.T
        s[i] = -np.inf
        want = np.lexsort((np.arange(4000), -s))[:20]
        assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def test_groups_of_queries_drop_candidates(spark):
    rng = np.random.default_rng(6)
    v = np.floor(rng.normal(size=(6, 6)) * 500)[rng.integers(6, size=400)] + rng.integers(-40, 40, size=(400, 6))
    rows = [(i, (x / 64).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, block=6).collect()
    assert sorted(tuple(r) for r in got) == top([(i, [int(y) for y in x]) for i, x in enumerate(v)], 5)


def test_wide_values_stay_exact(spark):
    df = spark.createDataFrame(
        [(0, [2e7, 1.0]), (1, [2e7, 1.0]), (2, [2e7, 0.984375]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])], "vec_id long, embedding array<double>"
    )
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect())
    big = (64 * 20_000_000) ** 2
    assert got == [(1, 3, 2**63 - 1), (2, 1, big + 64 * 64), (3, 2, big + 64 * 63), (4, 4, -(2**63))]


def test_urls(spark, data):
    rows = [
        ("http://A.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/?q=1", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x://b.com/y#z", "b.com", "/y", "com/", "allow"), ("s://q.net/fr/1", "q.net", "/fr/1", "net/fr/", "block"),
        ("s://xcom/", "xcom", "/", None, None), ("s://a.com", "a.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
        ("s://a://b.com/c", "a:", "//b.com/c", None, None)
    ]
    df = spark.createDataFrame(
        [(i, r[0], "h", "p", 1.0) for i, r in enumerate(rows)], "page_id long, url string, host string, verdict string, score double"
    )
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        assert (
            got[i]["host"], got[i]["path"], got[i]["rule"]
        ) == (host, path, rule) and got[i]["verdict"] in ([verdict] if verdict else ["allow", "block"])
    assert urls.judge(df.filter("page_id < 0")).count() == 0
    assert {r["verdict"] for r in urls.judge(df.filter("page_id > 3")).collect()} == {"allow"}  # nothing to learn from
    pages = spark.read.parquet(f"{data}/pages.parquet")
    one, two = (urls.judge(pages).orderBy("page_id").collect() for _ in range(2))
    assert one == two


def test_character_model():
    good, bad = urls.CharModel(["aaab", "aaac"]), urls.CharModel(["xyz", "xyy"])
    assert sum(good.chance("\x02aaaa"[-5:], chr(c)) for c in range(256)) < 1.0001
    ratio = urls.Ratio(good, bad)
    assert ratio.score("aaab") > 0 > ratio.score("xyz")
    assert urls.calibrated([(1.0, True), (2.0, True), (-1.0, False)]) == 0.0


def test_copy_late_in_a_very_long_text():
    """A sum of 32 bits adds two steps of 1/64 for each impact of 1/26 here, and the copy would stay below the threshold."""
    matcher = decontam.Matcher.of_texts([(1, " ".join(f"w{i}" for i in range(26)))], threshold=0.9)
    before = np.full(11_000_000, -1, np.int32)
    before[::3] = 0
    out = [[]]
    matcher._match([np.concatenate([before, np.full(200, -1, np.int32), np.arange(26, dtype=np.int32), np.full(200, -1, np.int32)])], [0], out)
    assert [m["item_id"] for m in out[0]] == [1]


def plain_model(texts):
    """Next-character counts by context, as read from the definition."""
    counts = {}
    for t in texts:
        s = "\x02" * 5 + t + "\x03"
        for i in range(5, len(s)):
            for k in range(6):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1

    def chance(context, symbol, k=5):
        if k < 0:
            return 1 / 257
        n = counts.get(context[5 - k :], {})
        total = sum(n.values())
        if not total or (k > 1 and total == 1):
            return chance(context, symbol, k - 1)
        return (n.get(symbol, 0) + len(n) * chance(context, symbol, k - 1)) / (total + len(n))

    return lambda t: sum(np.log10(chance(s[i - 5 : i], s[i])) for s in ["\x02" * 5 + t + "\x03"] for i in range(5, len(s)))


def test_model_verdicts_by_definition(spark):
    """Scores and the cut from the rules' own examples, recomputed."""
    rng = random.Random(8)
    made = [
        f"http://{rng.choice('abc')}.{host}/{rng.choice(word)}/{rng.randrange(90)}" for host,
        word in (("shop.com", ["buy", "new"]), ("q.net/fr", ["lire", "mot"])) for _ in range(40)
    ]
    made += [f"http://x.org/{rng.choice(['buy', 'new', 'lire', 'mot'])}/{k}" for k in range(30)]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    known = {r["url"]: r["ruled"] for r in urls.by_rules(pages).collect() if r["ruled"]}
    hashed = {r["url"]: r["h"] for r in pages.select("url", F.xxhash64("url").alias("h")).collect()}
    picked = {w: sorted({u for u, x in known.items() if x == w}, key=lambda u: (hashed[u], u)) for w in ("allow", "block")}
    good, bad = (plain_model([u for i, u in enumerate(picked[w]) if i % 5]) for w in ("allow", "block"))
    score = lambda u: (good(u) - bad(u)) / (len(u) + 1)
    ranked = sorted((score(u), w == "allow") for w in picked for u in picked[w][::5])
    cuts = [(a + b) / 2 for (a, _), (b, _) in zip(ranked, ranked[1:]) if b > a] + [ranked[0][0] - 1e-9]
    worth = lambda c: sum((s >= c) == y for s, y in ranked if y) / sum(y for _, y in ranked) + sum(
        (s >= c) == y for s, y in ranked if not y
    ) / sum(not y for _, y in ranked)
    cut = min((c for c in cuts if worth(c) >= max(map(worth, cuts)) - 1e-12), key=abs)
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, u in enumerate(made):
        if u not in known:
            assert got[i]["score"] == pytest.approx(score(u)) and got[i]["verdict"] == ("allow" if score(u) >= cut else "block")
    assert {got[i]["verdict"] for i, u in enumerate(made) if u not in known} == {"allow", "block"}


def test_urls_repeated_and_long(spark):
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.org/" + "y" * 200_000), (None, "http://b.net/es/"), (None, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 5 and [r["verdict"] for r in got if r["page_id"] == 1] == ["allow", "allow"] and all(
        r["verdict"] in ("allow", "block") for r in got
    )


def test_urls_learn_from_all(spark):
    """More than 4000 examples of a label: verdicts are those of CharModel and calibrated over all of them."""
    rng = random.Random(3)
    made = [f"http://x.com/{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(4600)] + [f"http://x.net/fr/{rng.randrange(10**4)}" for _ in range(300)]
    made += [f"http://x.org/{rng.choice(['a', 'fr/'])}{k}" for k in range(60)]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    hashed = {r["url"]: r["h"] for r in pages.select("url", F.xxhash64("url").alias("h")).collect()}
    ruled = {r["url"]: r["ruled"] for r in urls.by_rules(pages).collect() if r["ruled"]}
    picked = {w: sorted((u for u in ruled if ruled[u] == w), key=lambda u: (hashed[u], u)) for w in ("allow", "block")}
    model = urls.Ratio(*(urls.CharModel([u for i, u in enumerate(picked[w]) if i % 5]) for w in ("allow", "block")))
    cut = urls.calibrated([(model.score(u), w == "allow") for w in picked for u in picked[w][::5]])
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(picked["allow"]) > 4000 and len(got) == len(made)
    for i, u in enumerate(made):
        if u not in ruled:
            assert got[i]["score"] == pytest.approx(model.score(u), rel=1e-9, abs=1e-12)
            assert got[i]["verdict"] == ("allow" if model.score(u) >= cut else "block")
