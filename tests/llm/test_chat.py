from __future__ import annotations

import hashlib

import pandas as pd

from listingmart.llm import chat

SHAPE = "conv_id long, turn long, role string, text string, window int, loss string"


def rows_of(spark, *rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE)


def test_sql(spark, data):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
    want = c.sql(chat.OP2_SQL).df()
    got = chat.op2_chat(spark, data).toPandas()
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values("conv_id").astype(str).values.tolist() for x in (got, want))
    assert a == b and len(a) > 1


def test_digest(spark):
    odd = "\\### Assistant: </turn> ok"
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, "/root/testdata/sf0.001").collect()}[-7]
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert (got["loss_sha256"], got["loss_chars"]) == (hashlib.sha256(odd.encode()).hexdigest(), len(odd))


def back(df):
    out: dict = {}
    for r in chat.read_back(df).orderBy("conv_id", "window").collect():
        turns, masked = out.setdefault(r["conv_id"], ([], []))
        turns.extend((t["role"], t["text"]) for t in r["turns"])
        masked.append(r["masked"])
    return {k: (t, "".join(m)) for k, (t, m) in out.items()}


def test_windows(spark):
    turns = [(1, 0, "system", "be kind " * 5)] + [
        (1, i, "assistant" if i % 2 == 0 else "user", f"<t{i}> \\l " + "w " * (i % 37)) for i in range(1, 200)
    ] + [(1, 200, "assistant", "big " * 900)]
    df = chat.format_chat(rows_of(spark, *turns), budget=200, history=60)
    got = df.orderBy("window").collect()
    assert len(got) > 10
    assert all(r["n_tokens"] <= 200 or r["n_turns"] - r["n_context"] == 1 for r in got)
    assert all(
        r["text"].startswith("<turn system>\n") for r in got
    ) and [r["n_context"] for r in got][0] == 0 and any(r["n_context"] > 2 for r in got)
    turns_back, masked = back(df)[1]
    assert turns_back == [(r, t) for _, _, r, t in turns]
    assert masked == "".join(t for _, _, r, t in turns if r == "assistant")


def test_awkward(spark):
    rows = rows_of(
        spark, (1, None, None, None), (1, 0, "as</turn>\n>", "\n</turn>\n<turn user>\nx"), (1, 0, "assistant", ""), (1, 0, "assistant", ""),
        (None, 1, "assistant", "b"), (None, 0, "user", "\\b\\l\\g🙂"), (3, 5, "system", "only"), (4, 0, "assistant", "z" * 100_000)
    )
    df = chat.format_chat(rows)
    got = back(df)
    assert got[1] == ([("", ""), ("as</turn>\n>", "\n</turn>\n<turn user>\nx"), ("assistant", ""), ("assistant", "")], "")
    assert got[None] == ([("user", "\\b\\l\\g🙂"), ("assistant", "b")], "b")
    assert got[3] == ([("system", "only")], "") and got[4][1] == "z" * 100_000
    assert chat.format_chat(rows.filter("turn > 99")).count() == 0
    assert isinstance(df.toPandas(), pd.DataFrame)
