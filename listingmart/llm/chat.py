"""Chat formatting in budgeted windows, DataFrame functions only.

Turns of a conversation, in order, get token prefix sums. They cut the conversation at turn borders into
spans: turns that lie wholly inside one cell of `step` tokens form a span, a turn that crosses a cell
border is a span of its own. So a span has at most `step` tokens or is a single longer turn; nothing is
cut off. A window is the opening system turn, the turns of at most `history` tokens just before the span,
and the span. Repeated turns (system, history) are outside the loss mask: each assistant turn is a target
in one window only.

Template: `<turn ROLE>\\n`, the text, `\\n</turn>\\n`. In roles and texts `\\` is written `\\b`, `<` `\\l`
and `>` `\\g`, so no text can contain a mark, and unescaping restores it exactly.

Defined results: null texts and roles are empty; null conv_ids form one conversation; null turn numbers
come first, ties go by role, then text; equal rows all count; an empty table gives an empty result; further
columns are not looked at. All turns of one conversation are ordered in one task, by a sort that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, table

END = "\n</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
#: Tokens that the marks of a turn count for.
MARKS = 4


def escaped(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_chat(conversations: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """conv_id, window, n_context (repeated turns, they lead), n_turns, n_tokens, text and loss: spans of text in code points."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    turns = turns.withColumn("tokens", n_words(F.col("body")) + MARKS)
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    turns = turns.withColumn("pos", F.row_number().over(w)).withColumn("sys", (F.col("pos") == 1) & (F.col("role") == "system"))
    paid = F.when(F.col("sys"), 0).otherwise(F.col("tokens"))
    turns = turns.withColumn(
        "at", F.when(F.col("sys"), -1).otherwise(F.coalesce(F.sum(paid).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long")
    )

    by_at = Window.partitionBy("conv_id").orderBy("at")
    whole = by_at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = F.coalesce(F.max(F.when(F.col("sys"), F.col("tokens"))).over(whole), F.lit(0))
    turns = turns.withColumn("step", F.greatest(F.lit(budget - history) - kept, F.lit(budget // 4)).cast("long"))
    turns = turns.withColumn(
        "cell", F.when(~F.col("sys"), F.struct(F.expr("at div step").alias("a"), F.expr("(at + tokens - 1) div step").alias("b")))
    )
    turns = turns.withColumn("first", ~F.col("sys") & ~F.lag("cell").over(by_at).eqNullSafe(F.col("cell")))
    started = F.sum(F.col("first").cast("int"))
    turns = turns.withColumn("span", F.greatest(started.over(by_at.rowsBetween(Window.unboundedPreceding, 0)) - 1, F.lit(0)).cast("int"))
    turns = turns.withColumn("spans", started.over(whole).cast("int"))
    turns = turns.withColumn("later", F.collect_list(F.when(F.col("first"), F.col("span"))).over(by_at.rangeBetween(1, history)))
    again = F.when(F.col("sys"), F.expr("if(spans > 1, sequence(1, spans - 1), cast(array() as array<int>))")).otherwise(F.col("later"))
    placed = turns.withColumn(
        "_to",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("again"))),
                F.transform(again, lambda s: F.struct(s.alias("window"), F.lit(True).alias("again")))
            )
        )
    )
    placed = placed.select(
        "conv_id", F.col("_to.window").alias("window"), F.col("_to.again").alias("again"), "pos", "role", "tokens",
        F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">\n")).alias("head"), escaped(F.col("body")).alias("body")
    )
    placed = placed.withColumn("size", F.length("head") + F.length("body") + len(END))
    in_window = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(in_window), F.lit(0)) + F.length("head")
    target = ~F.col("again") & (F.col("role") == "assistant")
    placed = placed.withColumn(
        "loss", F.when(target, F.struct(start.cast("int").alias("start"), (start + F.length("body")).cast("int").alias("end")))
    )
    one = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("text"), "loss")
    out = placed.groupBy("conv_id", "window").agg(
        F.sum(F.col("again").cast("int")).cast("int").alias("n_context"), F.count(F.lit(1)).cast("int").alias("n_turns"),
        F.sum("tokens").alias("n_tokens"), F.array_sort(F.collect_list(one)).alias("all"))
    return out.select(
        "conv_id", "window", "n_context", "n_turns", "n_tokens", F.array_join(F.col("all.text"), "").alias("text"),
        F.filter(F.col("all.loss"), lambda x: x.isNotNull()).alias("loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per window, parsed from its text alone: the turns that are new in it, and the unescaped text under the mask."""
    def turn(part: Column) -> Column:
        cut = F.instr(part, ">\n")
        return F.struct(unescaped(F.substr(part, F.lit(7), cut - 7)).alias("role"), unescaped(F.substr(part, cut + 2)).alias("text"))

    parts = F.split("text", END, -1)
    new = F.slice(parts, F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))
    masked = F.transform("loss", lambda x: unescaped(F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"])))
    return windows.select(
        "conv_id", "window", F.length("text").alias("chars"), F.transform(new, turn).alias("turns"), F.array_join(masked, "").alias("masked")
    )


def op2_chat(spark, sf_dir):
    odd = "\\### Assistant: </turn> ok"
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = told.unionByName(
        spark.range(2).select(
            F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
            F.lit(odd).alias("text")
        )
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(format_chat(told)).select(
        "conv_id", F.struct("window", lines.alias("lines"), "masked").alias("one"), F.size("turns").alias("n"), "chars"
    )
    out = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("one")).alias("all"),
        F.count(F.lit(1)).alias("n_windows")
    )
    masked = F.array_join(F.col("all.masked"), "")
    return out.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("all.lines"), ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


OP2_SQL = r"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
             UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
             UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, 4 + len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS tokens,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS pos FROM src),
s AS (SELECT *, pos = 1 AND role = 'system' AS sys FROM t),
p AS (SELECT *, CASE WHEN sys THEN -1 ELSE coalesce(sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS ofs,
             greatest(1536 - coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0), 512) AS step FROM s),
c AS (SELECT *, CASE WHEN sys THEN NULL ELSE ofs // step END AS a, CASE WHEN sys THEN NULL ELSE (ofs + tokens - 1) // step END AS b FROM p),
f AS (SELECT *, NOT sys AND (lag(a) OVER w IS DISTINCT FROM a OR lag(b) OVER w IS DISTINCT FROM b) AS first FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY ofs)),
n AS (SELECT x.*, (SELECT count(*) FROM f y WHERE y.conv_id = x.conv_id AND y.first AND (x.sys OR (y.ofs > x.ofs AND y.ofs <= x.ofs + 512))) AS later FROM f x),
z AS (SELECT *, CASE WHEN sys THEN greatest(later, 1) ELSE 1 + later END AS times,
             length(role) + length(body) + 17 + (2 * length(role || body) - length(replace(replace(replace(role || body, '\', ''), '<', ''), '>', '')) - length(role || body)) AS chars FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(times * chars)::BIGINT AS formatted_chars, greatest(count(*) FILTER (first), 1) AS n_windows
FROM z GROUP BY conv_id
"""
