"""Mixing sources to target weights.

Each source's documents, in a fixed order, form one stream of words that is cut into blocks of
`block` words (the last one may be shorter). A driver-side plan of one row per (output shard, source)
draws how many slots of a shard each source fills: multinomial draws with chances in proportion to
what the source has still to give, so the shards vary and the totals meet the targets. Slot j of a
source is in pass j // n_blocks; a keyed Feistel permutation of the block numbers, another one for each
pass, says which block it takes. Slots and document pieces then meet by (source, block).

Only word counts are shuffled, never texts. A hot source is dealt over many (source, chunk) groups and
its blocks over all partitions.

Defined results: a null or blank text has size 0 and nothing is taken from it; a null source is a source
of its own, last in order; equal rows are interchangeable, the multiset of their results is fixed; an
empty table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words, row_key, table

#: Chunks of a source at least, and documents for each chunk; different rows of a chunk of whole documents, about.
CHUNKS, SHARE, KINDS = 1024, 50_000, 4096
#: Rows of the plan at most: with many sources there are fewer shards.
PLAN = 2_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split share * sum(sizes) by weight; what exceeds cap * size is dealt again until none does."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        parts = {i: left * weights[i] / total for i in open_}
        full = [i for i in open_ if parts[i] > cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else parts[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1: four Feistel rounds, walked until inside the range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> h, v & mask
        with np.errstate(over="ignore"):
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    a, b = b ^ (_mix64(a + k) & mask), a
                else:
                    a, b = b, a ^ (_mix64(b + k) & mask)
        return (a << h) | b

    out = once(np.asarray(x, dtype=np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _key(source: str | None, epoch: int, seed: int) -> int:
    return (zlib.crc32(b"\0" if source is None else b"\1" + source.encode()) << 20) + (epoch << 8) + seed


def plan_sources(totals: list[tuple[str | None, int]], weights: Sequence[float], share: float, cap: float, block: int, seed: int) -> list[dict]:
    """One entry per source, by code point and null last: target, blocks, slots, words of the last slot."""
    totals = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    aims = targets([t[1] for t in totals], [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    out = []
    for k, ((source, size), aim) in enumerate(zip(totals, aims, strict=True)):
        n = -(-size // block)
        full, rest = divmod(int(aim + 1e-6), size) if size else (0, 0)
        slots, last = full * n, 0
        if rest:
            short = size - (n - 1) * block
            at = int(permute(np.array([n - 1]), n, _key(source, full, seed), inverse=True)[0])
            if at >= -(-rest // block):
                used, last = -(-rest // block), (rest - 1) % block + 1
            elif rest <= at * block + short:
                used, last = at + 1, rest - at * block
            else:
                over = rest - at * block - short
                used, last = at + 1 + -(-over // block), (over - 1) % block + 1
            slots += used
        out.append({"k": k, "source": source, "size": size, "target": float(aim), "n": n, "slots": slots, "last": last})
    return out


def plan_shards(slots: Sequence[int], shard_slots: int, max_shards: int, seed: int) -> np.ndarray:
    """Slots of each (shard, source): multinomial draws from what is left, the last shard takes the rest."""
    left = np.array(slots, dtype=np.int64)
    shards = max(1, min(max_shards, -(-int(left.sum()) // shard_slots)))
    rng, out = np.random.default_rng(seed), []
    for k in range(shards):
        want = -(-int(left.sum()) // (shards - k))
        drawn = np.zeros_like(left)
        while (need := want - int(drawn.sum())) > 0:
            room = left - drawn
            drawn += np.minimum(rng.multinomial(need, room / room.sum()), room)
        out.append(drawn)
        left = left - drawn
    return np.array(out).reshape(shards, len(slots))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 1024, shard_slots: int = 4096,
    max_shards: int = 1024, max_sources: int = 100_000, seed: int = 7, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, source, size, source_size, target, taken and the carried columns;
    the manifest: shard, slot, source number, block, words).

    The plan holds one row per source and per (shard, source); sources are checked against max_sources
    and shards held to max_shards and PLAN rows in all, beyond which they hold more than shard_slots slots,
    so its size is bounded whatever the input. Carried columns must not be called as the result's or with a leading underscore
    but `_key`.
    """
    spark = docs.sparkSession
    if bad := [
        c for c in carry if c != "_key" and (
            c.startswith("_") or c.lower() in ("doc_id", "source", "size", "source_size", "target", "taken", "k", "block", "uses")
        )
    ]:
        raise ValueError(f"carried columns clash: {bad}")
    sized = docs.select("doc_id", "source", *carry, n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("_h"))
    sized = materialize(sized, "mix-sizes")
    chunks = max(CHUNKS, -(-sized.count() // SHARE))
    sized = sized.withColumn("_chunk", F.pmod("_h", F.lit(chunks)).cast("int"))
    by_chunk = sized.groupBy("source", "_chunk").agg(F.sum("size").alias("_words"))
    totals = by_chunk.groupBy("source").agg(F.sum("_words").alias("size")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than max_sources={max_sources} sources")
    plan = plan_sources([(r["source"], int(r["size"])) for r in totals], weights, share, cap, block, seed)
    named = spark.createDataFrame([(p["k"], p["source"], p["size"], p["target"]) for p in plan], "k int, _s string, source_size long, target double")

    counts = plan_shards([p["slots"] for p in plan], shard_slots, max(1, min(max_shards, PLAN // max(1, len(plan)))), seed)
    first = np.cumsum(counts, axis=0) - counts
    rows = [
        (
            s, p["k"], p["source"], p["n"], p["size"], p["slots"], p["last"], int(first[s, p["k"]]), int(counts[s, p["k"]])
        ) for s in range(len(counts)) for p in plan if counts[s, p["k"]]
    ]

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for lo in range(r.first, r.first + r.count, 1 << 18):
                    j = np.arange(lo, min(lo + (1 << 18), r.first + r.count), dtype=np.int64)
                    at = np.empty_like(j)
                    for e in np.unique(j // r.n):
                        own = j // r.n == e
                        at[own] = permute(j[own] % r.n, r.n, _key(r.source, int(e), seed))
                    words = np.minimum(block, r.size - at * block)
                    if r.last:
                        words[j == r.slots - 1] = r.last
                    yield pd.DataFrame({"shard": r.shard, "slot": j, "k": r.k, "block": at, "words": words})

    shape = "shard int, k int, source string, n long, size long, slots long, last long, first long, count long"
    manifest = spark.createDataFrame(rows, shape).repartition(max(1, min(len(rows), 256)), "shard", "k").mapInPandas(
        slots, "shard int, slot long, k int, block long, words long"
    )

    ahead = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = by_chunk.withColumn("_head", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).join(named, F.col("source").eqNullSafe(F.col("_s")))
    heads = heads.select(F.col("source").alias("_hs"), F.col("_chunk").alias("_hc"), "_head", "k", "source_size", "target")
    inside = Window.partitionBy("source", "_chunk").orderBy("doc_id", "_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(
        heads, F.col("source").eqNullSafe(F.col("_hs")) & (F.col("_chunk") == F.col("_hc"))
    ).withColumn("_start", F.col("_start") + F.col("_head"))
    keep = ["doc_id", "source", *carry, "size", "source_size", "target"]

    uses = manifest.withColumn("_full", F.col("words")).groupBy("k", "block").agg(F.collect_list("words").alias("uses"))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")))
    low = F.greatest(F.col("_start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("_start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    got = F.expr("aggregate(uses, 0L, (a, w) -> a + greatest(least(_high, w) - _low, 0L))")
    taken = pieces.join(uses, ["k", "block"], "left").withColumn("_got", F.coalesce(got, F.lit(0)))
    # (k, _start) names one document of any words
    out = taken.groupBy("k", "_start", *keep).agg(F.sum("_got").alias("taken")).select(*keep, "taken")
    none = placed.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none), manifest


def whole_copies(size: np.ndarray, rows: np.ndarray, taken: np.ndarray, most: int) -> np.ndarray:
    """Copies of each kind of row, in order, so that the words given follow the words taken; at most `most` a row.

    What a kind's copies leave or exceed is carried to the next kind. With sizes in falling order the end is off by about
    half a short document."""
    out, owed = np.zeros(len(size), np.int64), 0
    for k, (n, r, t) in enumerate(zip(size.tolist(), rows.tolist(), taken.tolist(), strict=True)):
        owed += t
        out[k] = copies = min(max((2 * owed + n) // (2 * n), 0), most * r)
        owed -= copies * n
    return out


def resampled(docs: DataFrame, cap: float = 2.0, **how) -> DataFrame:
    """The mix as whole documents, all columns as they are: each row as often as the mix takes its words, rounded with the rest
    carried, and at most `cap` times.

    A source's rows are dealt by hash into chunks of about KINDS different ones; in each, from the longest row on, copies
    are given as words come due. So a source's words meet its target to about a short document a chunk."""
    key, rows_, times_, n, own, copy = fresh(("_key", "_rows", "_times", "_n", "_own", "_copy"), docs.columns)
    keyed = docs.withColumn(key, row_key(docs, docs.columns))
    bare = keyed.select("doc_id", "source", "text", F.col(key).alias("_key"))  # the only columns that the mix looks at
    taken = mix(bare, carry=("_key",), cap=cap, **how)[0].filter("size > 0")
    # rows that are equal in all columns share a key and are one kind
    taken = taken.groupBy("_key", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    taken = materialize(taken, "mix-taken")
    chunks = taken.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / KINDS).alias("_chunks")).withColumnRenamed("source", "_s")  # a row a source
    dealt = taken.join(F.broadcast(chunks), F.col("source").eqNullSafe(F.col("_s")))
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.col("_chunks")))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "_key"], ascending=[False, True])
        times = whole_copies(*(g[c].to_numpy() for c in ("size", "rows", "taken")), most=int(cap))
        return pd.DataFrame({key: g["_key"].to_numpy(), times_: times, rows_: g["rows"].to_numpy()})

    times = dealt.groupBy("source", "_chunk").applyInPandas(choose, f"`{key}` string, `{times_}` long, `{rows_}` long").filter(F.col(times_) > 0)
    same = Window.partitionBy(key).orderBy(key)
    rows = keyed.join(times, key).withColumn(n, F.row_number().over(same))
    rows = rows.withColumn(own, F.expr(f"{times_} div {rows_} + if({n} <= {times_} % {rows_}, 1, 0)")).filter(F.col(own) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own)))).select(*docs.columns)


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_targets(spark, sf_dir):
    """Sizes and targets alone, targets rounded."""
    return op1_mixing(spark, sf_dir).select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"))


#: The cap holds for the sources whose size by weight is least; the level that the others share follows from prefix sums.
MIX_TARGETS_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
p AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS gone FROM r WINDOW before AS (ORDER BY most, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, most) AS level FROM (SELECT (total - capped) / (weights - gone) AS level, most FROM p) WHERE level <= most)
SELECT doc_id, d.source, size, source_size, round(least(2.0::DOUBLE * source_size, weight * (SELECT level FROM l)), 3) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
