"""URL filters: allow and block rules first, a character-model ratio for the rest.

Two smoothed variable-order Markov models (up to ORDER characters of context, Witten-Bell back-off to
shorter ones) learn from URLs that a rule accepts or rejects. A URL's score is the difference of the two
log10 likelihoods per character, its end included; the threshold is the one of best balanced accuracy on
held-back training URLs: every fifth of each class in the order of hashes. All distinct URLs that a rule judges
take part. Counts, chances and the threshold are tables: each block of URLs gets the ratios of its own grams
only, so neither the driver nor a worker holds a model. CharModel and calibrated define the same for few texts.

Defined results: a null URL counts as empty; without "://" host and path are empty, no rule fits and the
model judges the text; equal rows get equal verdicts; if a class has no example, what no rule judges is
allowed; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import LOWER, UPPER, table

ORDER, SYMBOLS = 5, 257
BLOCK, STEPS = 500_000, 4096  # characters of a block of URLs; steps of scores
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


class CharModel:
    """Witten-Bell Markov model over characters; "\\x03" ends a text."""

    def __init__(self, texts: Sequence[str]):
        self.next: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for text in texts:
            s = "\x02" * ORDER + text + "\x03"
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.next[s[i - k : i]][s[i]] += 1
        self.next = {c: dict(n) for c, n in self.next.items() if len(c) < 2 or sum(n.values()) > 1}

    def chance(self, context: str, symbol: str) -> float:
        p = 1.0 / SYMBOLS
        for k in range(ORDER + 1):
            if not (n := self.next.get(context[len(context) - k :])):
                break
            total = sum(n.values())
            p = (n.get(symbol, 0) + len(n) * p) / (total + len(n))
        return p


class Ratio(dict):
    """ORDER + 1 characters: log10 of accepted over rejected chance of the last; bounded memo."""

    def __init__(self, good: CharModel, bad: CharModel):
        super().__init__()
        self.good, self.bad = good, bad

    def __missing__(self, gram: str) -> float:
        if len(self) > 400_000:
            self.clear()
        self[gram] = out = math.log10(self.good.chance(gram[:-1], gram[-1]) / self.bad.chance(gram[:-1], gram[-1]))
        return out

    def score(self, text: str) -> float:
        s = "\x02" * ORDER + text + "\x03"
        return sum(self[s[i - ORDER : i + 1]] for i in range(ORDER, len(s))) / (len(text) + 1)

    def __reduce__(self):
        return Ratio, (self.good, self.bad)


def calibrated(scores: Sequence[tuple[float, bool]]) -> float:
    """The cut of best balanced accuracy between neighbouring scores; of ties the one nearest 0."""
    good, bad = sum(y for _, y in scores), sum(not y for _, y in scores)
    if not good or not bad:
        return 0.0
    ranked, passed, kept = sorted(scores), 0, 0
    cuts = [(1.0, ranked[0][0] - 1e-9)]
    for i, (s, y) in enumerate(ranked):
        passed, kept = passed + y, kept + (not y)
        if i + 1 < len(ranked) and ranked[i + 1][0] > s:
            cuts.append(((good - passed) / good + kept / bad, (s + ranked[i + 1][0]) / 2))
    best = max(c[0] for c in cuts)
    return min((c[1] for c in cuts if c[0] >= best - 1e-12), key=abs)


def split_url(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)([^?#]*+)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, null if none does."""
    verdict = rule = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        verdict, rule = F.when(fits, F.lit(what)).otherwise(verdict), F.when(fits, F.lit(text)).otherwise(rule)
    return verdict, rule


def by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, ruled (the rule's verdict) and rule; both null where none fits."""
    host, path = split_url(F.col("url"))
    found = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    verdict, rule = rule_of(F.col("host"), F.col("path"), rules)
    return found.withColumn("ruled", verdict).withColumn("rule", rule)


def grams(text: str) -> Iterator[str]:
    """The context and the character at each place, the end included."""
    s = "\x02" * ORDER + text + "\x03"
    return (s[i - ORDER : i + 1] for i in range(ORDER, len(s)))


def examples(ruled: DataFrame) -> DataFrame:
    """Distinct URLs that a rule judges: url, label and place, from 0, in the order of hashes within a label."""
    known = ruled.filter("ruled is not null").select("url", F.col("ruled").alias("label")).distinct()
    known = known.withColumn("_h", F.xxhash64("url")).withColumn("_b", F.shiftright("_h", 48))
    before = F.sum("_n").over(Window.partitionBy("label").orderBy("_b")) - F.col("_n")
    starts = known.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_n")).select("label", "_b", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", "url")) - 1
    return known.withColumn("_i", within).join(starts, ["label", "_b"]).select("url", "label", (F.col("_before") + F.col("_i")).alias("place"))


def counted(train: DataFrame) -> DataFrame:
    """gram, good and bad: how often it occurs in URLs of each label, in parts to be added."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {"allow": Counter(), "block": Counter()}

        def flush() -> pa.RecordBatch:
            both = list(seen["allow"].keys() | seen["block"].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), *(pa.array([seen[w][g] for g in both], pa.int64()) for w in seen)], names=["gram", "good", "bad"]
            )
            for c in seen.values():
                c.clear()
            return out

        for b in batches:
            for url, label in zip(b.column("url").to_pylist(), b.column("label").to_pylist(), strict=True):
                seen[label].update(grams(url))
                if sum(map(len, seen.values())) > 100_000:
                    yield flush()
        yield flush()

    return train.select("url", "label").mapInArrow(count, "gram string, good long, bad long")


def needed(rows: DataFrame) -> DataFrame:
    """block and gram, once each."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, str]] = set()

        def flush() -> pa.RecordBatch:
            out = [pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.string())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names=["block", "gram"])

        for b in batches:
            for block, url in zip(b.column("block").to_pylist(), b.column("url").to_pylist(), strict=True):
                seen.update((block, g) for g in grams(url))
                if len(seen) > 100_000:
                    yield flush()
        yield flush()

    return rows.select("block", "url").mapInArrow(find, "block long, gram string").distinct()


def ratios(counts: DataFrame) -> DataFrame:
    """gram and ratio of all grams of counts (one row each): the chances of CharModel, from short contexts to long ones."""
    last = None
    for k in range(ORDER + 1):
        context = F.substring("gram", ORDER + 1 - k, k) if k else F.lit("")
        level = counts.groupBy(context.alias("c"), F.substring("gram", ORDER + 1, 1).alias("s")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        of = Window.partitionBy("c")  # an alphabet at most
        level = level.withColumns({f"{x}_{n}": f.over(of) for x in ("good", "bad") for n, f in (("all", F.sum(x)), ("kinds", F.count_if(F.col(x) > 0)))})
        if last is None:
            level = level.withColumns({f"p_{x}": F.lit(1.0 / SYMBOLS) for x in ("good", "bad")})
        else:
            level = level.join(last, (F.substring("c", 2, k) == F.col("_c")) & (F.col("s") == F.col("_s"))).drop("_c", "_s")
        level = level.withColumns({
            f"p_{x}": F.when(F.col(f"{x}_all") > (1 if k > 1 else 0),
                             (F.col(x) + F.col(f"{x}_kinds") * F.col(f"p_{x}")) / (F.col(f"{x}_all") + F.col(f"{x}_kinds"))).otherwise(F.col(f"p_{x}"))
            for x in ("good", "bad")})
        last = level.select(F.col("c").alias("_c"), F.col("s").alias("_s"), "p_good", "p_bad")
    return last.select(F.concat("_c", "_s").alias("gram"), F.log10(F.col("p_good") / F.col("p_bad")).alias("ratio"))


def threshold(held: DataFrame) -> float:
    """calibrated() over rows of score and label; no task sorts more than a step of scores."""
    held = held.groupBy("score").agg(F.count_if(F.col("label") == "allow").alias("g"), F.count_if(F.col("label") == "block").alias("b"))
    low, high, good, bad = held.agg(F.min("score"), F.max("score"), F.sum("g"), F.sum("b")).first()
    if not good or not bad:
        return 0.0
    step = F.floor((F.col("score") - low) / ((high - low) or 1.0) * STEPS)
    held = held.withColumn("step", step)
    up = Window.orderBy("step")
    steps = held.groupBy("step").agg(F.sum("g").alias("sg"), F.sum("b").alias("sb"), F.min("score").alias("first"))  # STEPS + 1 rows at most
    steps = steps.select(
        "step", (F.sum("sg").over(up) - F.col("sg")).alias("sg"), (F.sum("sb").over(up) - F.col("sb")).alias("sb"), F.lead("first").over(up).alias("next")
    )
    inner = Window.partitionBy("step").orderBy("score")
    cuts = held.join(steps, "step").select(
        ((good - F.col("sg") - F.sum("g").over(inner)) / good + (F.col("sb") + F.sum("b").over(inner)) / bad).alias("worth"),
        ((F.col("score") + F.coalesce(F.lead("score").over(inner), "next")) / 2).alias("cut")
    ).filter("cut is not null")
    first = (1.0, low - 1e-9)
    best = max(first[0], cuts.agg(F.max("worth")).first()[0] or 0.0)
    found = cuts.filter(F.col("worth") >= best - 1e-12).agg(F.min(F.struct(F.abs("cut").alias("a"), "cut")).alias("x")).first()["x"]
    ties = [first[1]] if first[0] >= best - 1e-12 else []
    return min(ties + ([found["cut"]] if found else []), key=abs)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score: the model's, null where a rule judges."""
    ruled = by_rules(pages, rules).withColumn("page_id", F.col("page_id").cast("long"))
    known = materialize(examples(ruled), "examples")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ruled.select(
            "page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.when(F.col("ruled").isNull(), 0.0).alias("score")
        )
    alone = [w for w, n in sizes.items() if n == 1]  # a label's only URL is learnt from, too
    train = known.filter((F.col("place") % 5 != 0) | F.col("label").isin(alone))
    no = F.lit(None).cast("string")
    text = F.coalesce("url", F.lit(""))
    rows = ruled.filter("ruled is null").select("page_id", "host", "path", text.alias("url"), no.alias("label")).unionByName(
        known.filter("place % 5 = 0").select(F.lit(None).cast("long").alias("page_id"), no.alias("host"), no.alias("path"), "url", "label")
    )
    blocks = (rows.agg(F.sum(F.length("url") + 1)).first()[0] or 0) // BLOCK + 1
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "urls")
    wanted = materialize(needed(rows), "needed")
    zero = F.lit(0).cast("long")
    counts = counted(train).unionByName(wanted.select("gram", zero.alias("good"), zero.alias("bad")).distinct())
    counts = materialize(counts.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")
    own = wanted.join(ratios(counts), "gram").select("block", "gram", "ratio")

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        ratio = dict(zip(told.column("gram").to_pylist(), told.column("ratio").to_pylist(), strict=True))
        found = [sum(ratio[g] for g in grams(u)) / (len(u) + 1) for u in texts.column("url").to_pylist()]
        names = ["page_id", "host", "path", "label"]
        return pa.table([*(texts.column(c) for c in names), pa.array(found, pa.float64())], names=[*names, "score"])

    scored = materialize(
        rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, "page_id long, host string, path string, label string, score double"),
        "scores"
    )
    cut = threshold(scored.filter("label is not null"))
    verdict = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return ruled.filter("ruled is not null").select(
        "page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score")
    ).unionByName(scored.filter("label is null").select("page_id", "host", "path", no.alias("rule"), verdict.alias("verdict"), "score"))


def op9_urls(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir):
    """What the rules alone say of every page."""
    return by_rules(table(spark, sf_dir, "pages")).drop("url")


_fits = [
    (
        f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')", what, r
    ) for what,
    r in sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
]
URL_RULES_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {test} THEN '{what}'" for test, what, _ in _fits)} END AS ruled, CASE {" ".join(f"WHEN {test} THEN '{r}'" for test, _, r in _fits)} END AS rule FROM h
"""
