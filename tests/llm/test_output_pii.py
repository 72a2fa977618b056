from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listingmart.llm import pii, tokenfile

PATH = public_tokenizers.path(tokenfile.TOKENIZER)
HARD = [
    "a  b", "a \nb", "x\n  y", "x\n \ny", " a", "a ", " ", "", "a\n ", "\t b c", "\n\n c", "<|endoftext|> x <|endoftext|>", "a\u0085 b  c",
    "日本 語 12 3's don't a.' it's, x-y ...", "\x1c a \x1d", "é ñ, ß! Ÿ ǆ. ɏ ɐ", "word," * 2000, "🙂 🙂"
]


def test_encoder_like_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(0)
    texts = HARD + ["".join(rng.choice("ab é'.,\n\t 1<|日") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for limit in (1_000_000, 5):
        code = tokenfile.Encoder(tokenizer, np.dtype("<u2"), limit)
        assert code.by_word
        assert [np.frombuffer(b, "<u2").tolist() for b in code(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(
    "values", [[], [0], [5], [0, 0, 0], [0, 1, 2, 3], [7, 7, 900, 10**9], sorted(np.random.default_rng(0).integers(0, 10**6, 3000).tolist())]
)
def test_elias_fano(values):
    coded = tokenfile.EliasFano.load(tokenfile.EliasFano.of(np.array(values, np.int64)).dump())
    assert coded.all().tolist() == values and [coded.select(i) for i in range(len(values))] == values
    if len(values) == 3000:
        assert len(coded.dump()) < 3000 * 2


def expected(docs):
    tokenizer = Tokenizer.from_file(PATH)
    at, out = 0, []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = tokenfile.encode_and_read(docs.repartition(5)).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_special_names_and_far_ids(spark):
    far = 2**53 + 1
    docs = [(None, "a <|endoftext|> b"), (-far, "x<|endoftext|>"), (far, "<|endoftext|>y z"), (2**63 - 1, "end")]
    got = sorted(
        (tuple(r) for r in tokenfile.encode_and_read(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()),
        key=lambda r: r[1]
    )
    assert got == expected(docs)
    assert Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_select_reads_the_stored_directory(monkeypatch):
    """Neither loading nor select looks at all bits."""
    values = np.sort(np.random.default_rng(2).integers(0, 10**8, 5000))
    data = tokenfile.EliasFano.of(values).dump()
    monkeypatch.setattr(np, "unpackbits", None)
    coded = tokenfile.EliasFano.load(data)
    assert [coded.select(i) for i in range(0, 5000, 37)] == values[::37].tolist()


def test_awkward(spark, awkward, nothing, tmp_path):
    got = sorted((tuple(r) for r in tokenfile.encode_and_read(awkward).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == 11
    rows = {}
    for r in awkward.collect():
        rows.setdefault(r["doc_id"], []).append(r["text"])
    for i in set(ids):
        assert sorted(r[2:] for r in got if r[0] == i) == sorted(x[2:] for x in expected([(i, t) for t in rows[i]]))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert tokenfile.encode_and_read(nothing).count() == 0
    shards = tokenfile.write_shards(awkward, f"file://{tmp_path}", PATH).collect()
    shard = tokenfile.Shard(open(shards[0]["path"], "rb").read())
    assert all((shard.doc(i) == shard.ids[a:b]).all() for i, (a, b) in enumerate(zip(shard.bounds.all(), shard.bounds.all()[1:])))
    assert not list(tmp_path.glob(".attempt*"))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    digits = [int(c) for c in d][::-1]
    luhn = (sum(digits[0::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    return {
        "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15
    }[kind]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m.group()))


def spans(df):
    short = F.array_sort(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return df.select("doc_id", pii.told(short).alias("s"))


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [
        "a@b.c_d@e.f x@y.z.", "..a@b..c a@b.c.d@e.f", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.3.0004 1.2.3",
        "4111 1111 1111 1111 5 4111-1111-1111-1111 4111111111111111-", "+1 (555) 123-4567 ++12345678+9 +1-------2 +123",
        "é@x.com ñ a@é.com 🙂 q@w.e 🙂 10.0.0.1"
    ]
    texts += ["9" * 50_000, "a" * 100_000, "a@" * 3000, None, "", "1 " * 20_000, "+1 " + "(" * 5000, "a.b@c-d.e-f.g%h@i.j 4012888888881881x"]
    texts += ["".join(rng.choice("01459.-+ @a()") for _ in range(rng.randrange(5, 120))) for _ in range(1500)]
    got = {r["doc_id"]: r["s"] for r in spans(pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != base(t)] == []


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, data).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]


def test_bootstrapping(spark):
    names = "ana bob cy dee eva fay gus hal ivy jon kim lou".split()
    rows = [
        (i, f"{n} met us {x} please call mobile +1 555 123 {1000 + i} thanks {x}") for i,
        (n, x) in enumerate((n, x) for n in names for x in ("today", "soon"))
    ]
    rows += [(100 + i, f"so {n} please call mobile 555 987 {2000 + i} thanks") for i, n in enumerate(names)]
    rows += [(200 + i, f"order number 8888{i}77777 shipped") for i in range(5)] + [(300, "the the the " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in pii.find(df).collect()}
    assert {i for i, f in found.items() if f} == set(range(100, 112))
    text = dict(rows)[100]
    assert [text[f["start"] : f["end"]] for f in found[100]] == ["555 987 2000"]
    common = df.select(
        "doc_id", F.regexp_replace("text", "call mobile", "the").alias("text")
    ).union(spark.createDataFrame([(999, "x the y " * 900)], df.schema))
    assert all(not r["found"] for r in pii.find(common).filter("doc_id < 200").collect() if "the thanks" in r)


def planted(n=60, seed=4):
    """Documents with identifiers of base shape and of none in the same contexts, and numbers that are no identifiers."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    shapes = {
        "handy": (lambda: f"+49 {number(3)} {number(7)}", lambda: f"0{number(3)} {number(7)}"),
        "mailto": (
            lambda: f"{rng.choice(words)}{number(3)}@host.example",
            lambda: rng.choice([f"{rng.choice(words)}{number(3)}@localhost", f"{rng.choice(words)}{number(2)} (at) host (dot) example"])
        ),
        "gateway": (
            lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
            lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.{300 + rng.randrange(600)}"
        ),
        "apikey": (lambda: hexa(40), lambda: "sk-" + hexa(9) + "Zq" + hexa(9)),
    }
    rows, hidden, others = [], set(), 0
    for i in range(n * len(shapes) * 2):
        name = list(shapes)[i % len(shapes)]
        seen, unseen = shapes[name]
        shown = i // len(shapes) % 2
        value = (seen if shown else unseen)()
        before, after = (" ".join(rng.choice(words) for _ in range(12)) for _ in range(2))
        text = f"{before} {name}: {value} {after}"
        if not shown:
            hidden.add((i, len(before) + len(name) + 3, len(before) + len(name) + 3 + len(value)))
        if i % 3 == 0:
            text += f" order {number(9)} {rng.choice(words)} build {'b' + hexa(18)} {rng.choice(words)}"
            others += 2
        rows.append((i, text))
    return rows, hidden, others


def test_recall_of_hidden_identifiers(spark):
    rows, hidden, others = planted()
    got = {
        (r["doc_id"], f["start"], f["end"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for f in r["found"]
    }
    seeds = {(i, s, e) for i, s, e in got if (i, s, e) not in hidden and "apikey" in dict(rows)[i]}
    right = got & hidden
    assert others > 100 and len(right) >= 0.9 * len(hidden) and len(got - hidden - seeds) <= 0.02 * len(got)


def test_secrets_of_the_test_tables(spark):
    """The tables' only secrets follow one word; they are found, and nothing else is."""
    data = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    rows = pii.op7_pii(spark, data).collect()
    got = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in rows for s in r["spans"].split(",") if s.startswith("secret:")}
    assert want and got == want and sum(r["n_found"] for r in rows) >= len(want)


def test_pii_awkward(awkward, nothing):
    assert pii.find(awkward).count() == 11 and pii.find(nothing).count() == 0
