"""Personal data: pattern matches, then bootstrapped contextual extraction. DataFrame functions only.

Base spans are valid matches of four kinds (email, ip, card, phone). They are the seeds. Look-alikes
(numbers of 7 or more digits, addresses without a full domain or spelt with (at) and (dot)) that no base span
covers are candidates. A fifth kind, secret, has no base spans: runs of 16 or more letters, digits and _ + / = -
with a letter and a digit are its candidates, and those with a digest's form its seeds, which too are
reported only where their context is confident.
The lexical patterns of an instance are its places' words before and after: the last word, the last two words,
the next word. Patterns and instances form a graph, held as a table of distinct (kind, pattern, instance)
links, and score each other for ROUNDS rounds: a pattern's confidence is the mean score of its instances
(pulled towards 0 by PRIOR pseudo-instances), an instance's score is the noisy-or of its patterns' confidence;
seeds stay at 1, candidates start at 0. A candidate place is accepted if one of its own patterns has confidence
CONFIDENT or more from SUPPORT or more seeds, and its instance scores CONFIDENT. A pattern must also be
specific: of all places of its (rarer) word in the corpus, SPECIFIC or more have an instance beside them, so
common words are no evidence. Base spans always stay.

Copies of a text give one link a pattern, so they add no evidence. Hot patterns are summed before they are
shuffled, and the graph holds links only, never texts.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; null ids are
rows like any other, equal rows each give their spans; an empty table gives an empty result; further
columns are not looked at. Expressions are written without unbounded regex recursion or rescans, so long
runs of digits or letters are read once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches, written so that each match starts where a run does and no run is tried twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a kind's valid matches must hold besides; m is the match, d its digits.
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) <= 255)",
    "card": "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(d, -i, 1)), int(element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, "
    "9), int(substr(d, -i, 1)) + 1)))) % 10 = 0",
    "phone": "length(d) BETWEEN 8 AND 15",
}
#: Look-alikes: numbers (kind by their digits and dots) and addresses.
NUMBER = r"[0-9](?<![0-9A-Za-z_][0-9])(?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z_])"
ADDRESS = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)*+"
#: Secrets' look-alikes, and their seeds' form: 16, 20 or 32 bytes in hexadecimal.
SECRET, LONGEST_SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+", 512
DIGEST = "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
SECRET_KIND = len(KINDS)
ROUNDS, PRIOR, SUPPORT, CONFIDENT, SPECIFIC = 3, 0.5, 3, 0.8, 0.1
CONTEXT = 64
#: Up to so many words (of CONTEXT letters at most) are sent to all executors; more are counted by a shuffle.
SENT = 50_000
EDGE = r"[^\p{L}\p{N}]+"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, m)."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(at: Column, one: Column) -> Column:
        start = at["at"] + F.length(one["gap"])
        end = start + F.length(one["m"])
        return F.struct(
            end.alias("at"), F.concat(at["all"], F.array(F.struct(start.alias("start"), end.alias("end"), one["m"].alias("m")))).alias("all")
        )

    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    none = F.expr("named_struct('at', 0, 'all', cast(array() as array<struct<start:int,end:int,m:string>>))")
    return F.aggregate(steps, none, step, lambda at: at["all"])


def _when(test: Column, value: Column, like: str) -> Column:
    return F.when(test, value).otherwise(F.expr(f"cast(array() as {like})"))


PLACES = "array<struct<start:int,end:int,m:string>>"
SPANS = "array<struct<kind:int,start:int,end:int,m:string,left1:string,left2:string,right1:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with base: valid spans by kind, then start; and near: look-alikes outside them."""
    holds = {"email": F.contains("_t", F.lit("@")), "phone": F.contains("_t", F.lit("+"))}
    digits = F.rlike("_t", F.lit("[0-9]"))
    out = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_digits", digits)
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", _when(holds.get(kind, F.col("_digits")), located(F.col("_t"), PATTERNS[kind]), PLACES))
    out = out.withColumn("_number", _when(F.col("_digits"), located(F.col("_t"), NUMBER), PLACES))
    out = out.withColumn("_address", _when(F.rlike("_t", F.lit(r"@|[(\[]at[)\]]")), located(F.col("_t"), ADDRESS), PLACES))
    out = out.withColumn("_secret", _when(F.col("_digits"), located(F.col("_t"), SECRET), PLACES))
    kept = [
        f"transform(filter(_{kind}, x -> exists(array(struct(x.m AS m, regexp_replace(x.m, '[^0-9]', '') AS d)), y -> {_bound(VALID[kind])})), "
        f"x -> struct({k} AS kind, x.start, x.end, x.m))" for k,
        kind in enumerate(KINDS)
    ]
    out = out.withColumn("_base", F.expr(f"concat({', '.join(kept)})"))
    number = "length(regexp_replace(x.m, '[^0-9]', ''))"
    near = f"""concat(transform(_address, x -> struct(0 AS kind, x.start, x.end, x.m)),
        transform(_number, x -> struct(if(x.m RLIKE '^[0-9]+([.][0-9]+){{3}}$', 1, if({number} >= 12, 2, 3)) AS kind, x.start, x.end, x.m)),
        transform(filter(_secret, x -> length(x.m) <= {LONGEST_SECRET} AND x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]'), x -> struct({SECRET_KIND} AS kind, x.start, x.end, x.m)))"""
    out = out.withColumn("_near", F.expr(f"filter({near}, x -> NOT exists(_base, y -> x.start < y.end AND y.start < x.end))"))
    around = lambda name: _when(F.size(name) > 0, F.transform(name, _in_context), SPANS)
    return out.withColumn("base", around("_base")).withColumn("near", around("_near")).select(*docs.columns, "base", "near")


def _bound(test: str) -> str:
    """The test's m and d as fields of y."""
    return re.sub(r"\b([md])\b(?!')", r"y.\1", test)


def _in_context(x: Column) -> Column:
    """The span with its lexical patterns: lower-cased words, marks stripped; empty at a text's edge."""
    low = F.greatest(x["start"] - CONTEXT, F.lit(0))
    before, after = F.lower(F.substr("_t", low + 1, x["start"] - low)), F.lower(F.substr("_t", x["end"] + 1, F.lit(CONTEXT)))
    words = F.filter(F.split(before, EDGE), lambda w: w != "")
    last = lambda k: F.coalesce(F.try_element_at(words, F.lit(-k)), F.lit(""))
    following = F.coalesce(F.try_element_at(F.filter(F.split(after, EDGE), lambda w: w != ""), F.lit(1)), F.lit(""))
    return F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), last(1).alias("left1"),
        F.concat(last(2), F.lit(" "), last(1)).alias("left2"), following.alias("right1")
    )


def patterns(x: Column) -> Column:
    """A place's patterns as texts."""
    named = F.array(F.concat(F.lit("<1 "), x["left1"]), F.concat(F.lit("<2 "), x["left2"]), F.concat(F.lit(">1 "), x["right1"]))
    return F.filter(named, lambda p: F.length(F.trim(F.substr(p, F.lit(3)))) > 0)


def words_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split(F.lower("text"), EDGE)).alias("word"))


def specific(useful: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, pattern) of the patterns that are specific. Common words fail on the documents with a digit or an at sign
    already, whose words are summed first; the few words left are counted over all documents."""
    def passing(totals: DataFrame) -> DataFrame:
        rows = useful.join(totals, "word").groupBy("kind", "pattern", "places").agg(F.min("total").alias("total"))
        return rows.filter(F.col("places") >= SPECIFIC * F.col("total")).select("kind", "pattern")

    total = F.count(F.lit(1)).alias("total")
    some = words_of(docs.filter(F.rlike("text", F.lit("[0-9@]")))).groupBy("word").agg(total)
    left = materialize(useful.join(passing(some), ["kind", "pattern"], "left_semi"), "pii-rare")
    wanted = left.select("word").distinct()
    words = words_of(docs)
    if wanted.limit(SENT + 1).count() <= SENT:  # the size is checked
        return passing(words.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(total))
    return passing(words.groupBy("word").agg(total).join(wanted, "word", "left_semi"))


def confident_patterns(spans: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame] | None:
    """(kind, pattern, conf) and (kind, m, score) of what passes, from rows with base and near; None if nothing can."""
    seed = F.when((F.col("x.kind") == SECRET_KIND) & F.rlike("x.m", F.lit(DIGEST)), 1.0).otherwise(0.0)
    near = spans.select(F.explode("near").alias("x")).withColumn("seed", seed)
    places = spans.select(F.explode("base").alias("x"), F.lit(1.0).alias("seed")).unionByName(near)
    links = places.select(F.col("x.kind").alias("kind"), F.col("x.m").alias("m"), "seed", F.explode(patterns(F.col("x"))).alias("pattern"))
    links = materialize(links.groupBy("kind", "pattern", "m").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("places")), "pii-places")
    # a pattern without enough seeds, or without look-alikes (as secrets' seeds are), decides nothing
    useful = links.groupBy("kind", "pattern").agg(F.sum("seed").alias("seeds"), F.count(F.lit(1)).alias("n"), F.sum("places").alias("places")).filter(
        (F.col("seeds") >= SUPPORT) & ((F.col("n") > F.col("seeds")) | (F.col("kind") == SECRET_KIND))
    )
    useful = materialize(
        useful.select("kind", "pattern", "places", F.explode(F.split(F.substr("pattern", F.lit(4)), " ")).alias("word")), "pii-useful"
    )
    if useful.isEmpty():
        return None
    links = materialize(links.join(specific(useful, docs), ["kind", "pattern"], "left_semi"), "pii-links")
    if links.isEmpty():
        return None
    scores = links.groupBy("kind", "m").agg(F.max("seed").alias("score"))
    held = None
    for k in range(rounds):
        now = links.join(scores, ["kind", "m"]).groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + PRIOR)).alias("conf"), F.sum("seed").alias("seeds")
        )
        held = materialize(now, f"pii-patterns-{k}")
        away = F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9))))
        scores = materialize(
            links.join(held, ["kind", "pattern"]).groupBy("kind", "m").agg(F.greatest(F.max(links["seed"]), 1 - F.exp(away)).alias("score")),
            f"pii-instances-{k}"
        )
    return held.filter(
        (F.col("conf") >= CONFIDENT) & (F.col("seeds") >= SUPPORT)
    ).select("kind", "pattern", "conf"), scores.filter(F.col("score") >= CONFIDENT)


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and found: arrays of (kind number, start, end), by kind, then start."""
    rows = base_spans(docs.select("doc_id", "text")).select("doc_id", "base", "near")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "pii-spans")
    some = rows.filter((F.size("base") > 0) | (F.size("near") > 0))
    short = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    if (passed := confident_patterns(some, docs, rounds)) is None:
        return rows.select("doc_id", short(F.col("base")).alias("base"), none.alias("found"))
    good, instances = passed
    near = some.select("_row", F.explode("near").alias("x")).select("_row", "x", F.col("x.kind").alias("kind"), F.col("x.m").alias("m"))
    near = near.withColumn("pattern", F.explode(patterns(F.col("x"))))
    hits = near.join(good, ["kind", "pattern"], "left_semi").join(instances, ["kind", "m"], "left_semi")
    hits = hits.groupBy("_row").agg(F.collect_set(F.struct("x.kind", "x.start", "x.end")).alias("found"))
    return rows.join(hits, "_row", "left").select(
        "doc_id", short(F.col("base")).alias("base"), F.coalesce(F.array_sort("found"), none).alias("found")
    )


def told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "secret")))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op7_pii(spark, sf_dir):
    out = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {k})")).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans")
    )


def pii_base(spark, sf_dir):
    """Counts of base spans alone."""
    return op7_pii(spark, sf_dir).select("doc_id", *(f"n_{kind}" for kind in KINDS))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({_DIGITS}), i, 1)::INT + 1] END for i in range(1, len({_DIGITS}) + 1)]) % 10 = 0"
_BASE_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "len([p for p in string_split(m, '.') if len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255]) = 0"
    ),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 8 AND 15"),
}
PII_BASE_SQL = "SELECT doc_id, " + ", ".join(
    f"coalesce(len([m for m in regexp_extract_all(text, '{pattern}') if {test}]), 0)::BIGINT AS n_{kind}" for kind,
    (pattern, test) in _BASE_SQL.items()
) + " FROM documents"
