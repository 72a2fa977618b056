"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

Equal fingerprints are one node first. Nodes are dealt into tiles by the population counts of their
halves; two fingerprints within the radius differ by at most the radius in the summed differences of any
blocks' counts, so only tile pairs that near meet. Large tiles are cut into blocks of about BLOCK fingerprints
before they are dealt, so no task's memory grows with a tile. A pair of blocks is compared whole by numpy
exclusive-or and bit counts; a large pair is first cut into smaller tiles by the counts of quarters, bytes, half
bytes, and pairs of these beyond the radius are skipped. A task returns a spanning forest of the links it finds, never
all pairs; large-star/small-star rounds over tables in the shared folder join the forests to components.

Defined results: null texts and texts without words have fingerprint zero and link like any other; a null
id never names a component unless all ids in it are null; equal rows share a component; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, kept, materialize, row_key, slices, table

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Comparisons of a tile pair that is not cut further.
WHOLE = 1 << 20
#: Fingerprints of a block, about.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(found) <= words:
        hashes = np.array([digest(joined)], dtype=np.uint64)
        return int(hashes.view(np.int64)[0])
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: 1 - words - 1] + 1).tolist()] if words > 1 else [0, *(ends[:-1] + 1).tolist()]
    stops = ends[words - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(stops)
    for lo in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b]) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, as they are, and fp."""
    shape = T.StructType([*(docs.schema[c] for c in carry), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash", dict)  # drops what other operators left
        for b in slices(batches):
            fp = pa.array(np.fromiter(map(fingerprint, b.column(len(carry)).to_pylist()), np.int64, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], fp], names=shape.names)

    return docs.select(*carry, "text").mapInArrow(run, shape)


def counts_by_block(x: np.ndarray, level: int) -> np.ndarray:
    """Population counts of the 2**level equal blocks of each 64-bit number."""
    width = 64 >> level
    if width >= 8:
        return np.bitwise_count(x.view(f"<u{width // 8}")).reshape(len(x), -1)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1)
    return bits.reshape(len(x), 1 << level, width).sum(axis=2, dtype=np.uint8)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n links (node, smallest node of its component) with the components of the links u-v."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, level: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between x[a] and x[b] (places, for one tile a is b), as forests of tile pairs."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= WHOLE or level > 4:
        step = max(1, WHOLE // len(b))
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[b][None, :]) <= radius)
            u, v = part[i], b[j]
            if a is b:
                u, v = u[u < v], v[u < v]
            if len(u):
                own, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                node, root = forest(at[: len(u)], at[len(u) :], len(own))
                yield own[node], own[root]
        return

    def tiles(p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        kinds, at = np.unique(counts_by_block(x[p], level), axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        return kinds.astype(np.int16), np.split(p[order], np.cumsum(np.bincount(at.ravel()))[:-1])

    kinds_a, parts_a = tiles(a)
    kinds_b, parts_b = (kinds_a, parts_a) if a is b else tiles(b)
    for i, kind in enumerate(kinds_a):
        for j in np.flatnonzero(np.abs(kinds_b - kind).sum(axis=1) <= radius):
            if a is not b or i <= j:
                yield from links(x, parts_a[i], parts_b[j], radius, level + 1)


def linked(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """u, v: forests of the links among distinct fingerprints (fp)."""
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    own = fps.select("fp", half(0).alias("p"), half(32).alias("q"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near))
    dealt = own.withColumn("s", F.explode(steps)).withColumn("p2", F.col("p") + F.col("s.i")).withColumn("q2", F.col("q") + F.col("s.j"))
    dealt = dealt.filter(F.col("p2").between(0, 32) & F.col("q2").between(0, 32))
    here, there = F.col("p") * 33 + F.col("q"), F.col("p2") * 33 + F.col("q2")
    # a tile is cut into blocks of about `block` fingerprints, and a task compares two blocks
    sizes = own.groupBy((F.col("p") * 33 + F.col("q")).alias("_tile")).agg(F.count(F.lit(1)).alias("_size"))  # 33 x 33 rows at most
    parts = lambda name: F.broadcast(sizes.select(F.col("_tile").alias(name), F.ceil(F.col("_size") / block).cast("int").alias(f"{name}_parts")))
    dealt = dealt.select(here.alias("here"), there.alias("there"), "fp").join(parts("here"), "here").join(parts("there"), "there")  # empty tiles go
    mine = F.pmod(F.xxhash64("fp"), F.col("here_parts")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("there_parts") - 1)))
    turn = (F.col("here") > F.col("there")) | ((F.col("here") == F.col("there")) & (F.col("mine") > F.col("other")))
    ends = [F.struct(F.col(tile).alias("tile"), F.col(part).alias("part")) for tile, part in (("here", "mine"), ("there", "other"))]
    dealt = dealt.select(F.least(*ends).alias("first"), F.greatest(*ends).alias("last"), turn.alias("second"), "fp")
    dealt = dealt.select("first.tile", "first.part", F.col("last.tile").alias("tile2"), F.col("last.part").alias("part2"), "second", "fp")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        second, alone = g["second"].to_numpy(bool), (g["tile"].iloc[0], g["part"].iloc[0]) == (g["tile2"].iloc[0], g["part2"].iloc[0])
        x = g["fp"].to_numpy(np.int64).view(np.uint64)
        one = np.flatnonzero(~second)
        other = one if alone else np.flatnonzero(second)
        found = list(links(x, one, other, radius))
        if not found:
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        node, root = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(x))
        y = x.view(np.int64)
        return pd.DataFrame({"u": y[node], "v": y[root]})

    return dealt.groupBy("tile", "part", "tile2", "part2").applyInPandas(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its smallest node) of every node that has a link; large-star and small-star in turn."""
    down = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = materialize(down(edges), "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(down(small), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component (the smallest fingerprint that links reach) of the distinct fingerprints."""
    fps = marked.select("fp").distinct()
    roots = components(linked(fps, radius))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach."""
    marked = materialize(fingerprints(docs, ("doc_id",)), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("low")).join(classes(marked, radius), "fp")
    ids = least.groupBy("component").agg(F.min("low").alias("component_id"))
    return marked.join(least.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns as they are: the one of smallest id, null ids last, then of smallest key."""
    key, n = fresh(("_key", "_n"), docs.columns)
    keyed = docs.withColumn(key, row_key(docs, docs.columns))
    marked = fingerprints(keyed, ("doc_id", key)).toDF("doc_id", "_key", "fp")
    marked = materialize(marked, "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    best = marked.groupBy("fp").agg(F.min(first).alias("best")).join(classes(marked, radius), "fp")
    chosen = best.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best._key").alias(key)).distinct()
    same = Window.partitionBy(key).orderBy(key)  # rows that are equal in all columns
    return keyed.join(chosen, key).withColumn(n, F.row_number().over(same)).filter(F.col(n) == 1).select(*docs.columns)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash(spark, sf_dir):
    docs = near_duplicates(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
