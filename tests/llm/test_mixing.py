from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listingmart.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2.0) == pytest.approx([20, 1495])
    assert mixing.targets([], [], 1.5, 2.0) == [] and mixing.targets([0, 0], [1, 1], 1.5, 2.0) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    x = np.arange(n)
    y = mixing.permute(x, n, 12345)
    assert sorted(y) == list(x) and (mixing.permute(y, n, 12345, inverse=True) == x).all()


def test_slots_hold_the_target():
    rng = np.random.default_rng(0)
    for _ in range(300):
        size, block = int(rng.integers(1, 500)), int(rng.integers(1, 40))
        share = float(rng.uniform(0, 2))
        p = mixing.plan_sources([("s", size)], [1], share, 2.0, block, 7)[0]
        j = np.arange(p["slots"])
        at = np.concatenate([mixing.permute(j[j // p["n"] == e] % p["n"], p["n"], mixing._key("s", e, 7)) for e in range(3)]) if len(j) else j
        words = np.minimum(block, size - at * block)
        if p["last"]:
            assert 0 < p["last"] <= words[-1]
            words[-1] = p["last"]
        assert words.sum() == int(p["target"] + 1e-6)
        assert len(at) == 0 or np.bincount(at).max() <= 2


def test_shards():
    counts = mixing.plan_shards([5000, 0, 1, 2999], 1000, 100, 3)
    assert counts.sum(axis=0).tolist() == [5000, 0, 1, 2999] and len(counts) == 8 and set(counts.sum(axis=1)) == {1000}


def brute(docs: pd.DataFrame, manifest: pd.DataFrame, names: list, block: int) -> dict:
    """Words taken of each document by walking through every slot's block word by word."""
    taken = dict.fromkeys(docs.index, 0)
    for k, s in enumerate(names):
        owner = [i for i in docs.index if docs.loc[i, "source"] == s for _ in range(docs.loc[i, "size"])]
        for slot in manifest[manifest.k == k].itertuples():
            for i in owner[slot.block * block : slot.block * block + slot.words]:
                taken[i] += 1
    return taken


def test_mix_like_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60")
    got, manifest = mixing.mix(docs, block=32, shard_slots=16)
    # the stream's order shows in the result of a mix that takes everything once
    rows = got.toPandas()
    m = manifest.toPandas()
    again = mixing.mix(docs, block=32, shard_slots=16)[0].toPandas()
    key = ["doc_id", "size", "taken"]
    assert rows[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    by = rows.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all() and ((by.taken - by.target).abs() <= 1).all() and (rows.taken <= 2 * rows["size"]).all()
    names = sorted(by.index)
    assert m.groupby("k").words.sum().tolist() == by.loc[names].taken.tolist()
    stream = docs.withColumn("h", F.xxhash64("doc_id", "source", "text")).withColumn("chunk", F.pmod("h", F.lit(mixing.CHUNKS))).toPandas()
    stream["size"] = [len((t or "").encode().split()) for t in stream.text]
    stream = stream.sort_values(["chunk", "doc_id", "h"], ignore_index=True)
    want = brute(stream, m, names, 32)
    assert dict(zip(stream.doc_id, want.values(), strict=True)) == dict(zip(rows.doc_id, rows.taken, strict=True))
    order = rows.sort_values("doc_id")
    full = {s: sum(order[order.source == s]["size"]) for s in names}
    assert full == by["size"].to_dict() and set(m.groupby(["k", "block"]).size()) <= {1, 2}


def test_awkward(awkward, nothing):
    rows = mixing.mix(awkward, block=64)[0].toPandas()
    assert len(rows) == 11 and (rows.taken <= 2 * rows["size"]).all() and rows[rows["size"] == 0].taken.sum() == 0
    assert rows[rows.source.isna()].target.max() == 0  # the null source has no words
    assert mixing.mix(nothing)[0].count() == 0
    again = mixing.resampled(awkward, block=64)
    assert again.columns == awkward.columns and again.filter("text is null").count() == 0
    assert mixing.resampled(nothing).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.33, 0.65, 1.4])
def test_whole_documents_meet_the_target(spark, share):
    """Documents of many blocks are all taken at about the source's ratio; some must go and some stay."""
    docs = spark.createDataFrame([(i, "w " * (2000 + i % 7), "s" if i % 2 else None) for i in range(120)], "doc_id long, text string, source string")
    got = mixing.resampled(docs, weights=(1, 1), share=share, block=16).groupBy("source").agg({"text": "count"}).collect()
    assert {r[0]: r[1] for r in got} == pytest.approx({"s": 60 * share, None: 60 * share}, abs=1.01)


def test_clashing_columns_keep_their_values(awkward):
    again = mixing.resampled(awkward, weights=(1,), share=2.0, block=64)
    values = {(r["_key"], r["size"], r["fp"], r["predicted"], r["score"]) for r in again.collect()}
    assert again.columns == awkward.columns and values == {(9, 9, 9, 9, 0.5)}
    with pytest.raises(ValueError, match="clash"):
        mixing.mix(awkward, carry=("size",))


def test_sources_meet_their_targets_in_whole_documents(spark):
    """The tables' sources, whose longest documents hold a large part of their words, to 1 % each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = mixing.n_words(F.col("text")).alias("size")
    aims = {r["source"]: r["target"] for r in mixing.mix(docs)[0].select("source", "target").distinct().collect()}
    got = mixing.resampled(docs).select("doc_id", "source", size)
    for r in got.groupBy("source").agg(F.sum("size").alias("words")).collect():
        assert r["words"] == pytest.approx(aims[r["source"]], rel=0.01)
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_copies_follow_the_words():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = np.sort(rng.integers(1, 3000, 200))[::-1]
        rows = rng.integers(1, 4, 200)
        taken = (size * rows * rng.uniform(0, 2, 200)).astype(np.int64)
        copies = mixing.whole_copies(size, rows, taken, 2)
        assert (copies <= 2 * rows).all() and abs((copies * size).sum() - taken.sum()) <= max(size[-5:])
