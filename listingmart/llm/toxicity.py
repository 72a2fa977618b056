"""Toxicity: a linear-chain conditional random field tags toxic words.

Labels are of documents, so words are labelled first: a word, or a prefix of it, that toxic training
documents hold far more often than clean ones (a likelihood-ratio test) is a seed, and its places in toxic
documents are labelled toxic. The field learns word, prefix and suffix weights and label transitions
from these words; forward-backward marginals tag every word of every text. A document's score is a
logistic function of its largest marginal, the expected number of toxic words and their share, fitted on
training documents that the field did not see.

The fit uses a sample of labelled rows, bounded by the parameters of sample() and fit(): at most FIT_TOXIC and
FIT_CLEAN documents, of those of up to FIT_CHARS characters the ones whose ids hash smallest; the field learns from
the first of them that hold FIT_WORDS words, the others tell seeds and calibrate. Everything else covers all rows and
whole texts. Of several labels of one id the toxic one counts; null labels don't.

Defined results: a null text is an empty one, whose score comes from its length of zero alone; null ids are
scored and count as the empty text for the fold; if the sample lacks a class, every score is 0; equal rows
get equal scores; an empty table gives an empty result; further columns pass through clean_documents(), and are
not looked at elsewhere.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, kept, slices, table

FIT_TOXIC, FIT_CLEAN, FIT_CHARS, FIT_WORDS = 1500, 3000, 60_000, 500_000
THRESHOLD = 0.7
#: Words of a batch that are tagged at once.
STEP = 100_000
_NOISE = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(word: str) -> str:
    return _NOISE.sub("", word.lower())


def features(word: str) -> list[str]:
    """Of a normal word: itself, its prefixes of 4 to 6 letters and its suffix of 4."""
    if not word:
        return []
    return ["w" + word] + [f"p{word[:k]}" for k in (4, 5, 6) if len(word) > k] + ([f"s{word[-4:]}"] if len(word) > 4 else [])


def scan(emit: np.ndarray, starts: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over documents laid end to end.

    emit: log weight of label 1 over label 0 of each word; starts: first word of each document; move, begin:
    weights. Returns the marginals of label 1, the expected moves (pairs) and the log partition sum (pairs).
    Each word is a 2x2 matrix, a document's first word one that forgets what came before. Runs of
    words are multiplied side by side, then joined.
    """
    n = len(emit)
    weight = np.exp(np.clip(emit, -30, 30))
    m = np.empty((n, 2, 2))
    m[:, :, 0] = move[:, 0]
    m[:, :, 1] = move[:, 1] * weight[:, None]
    m[starts, :, 0], m[starts, :, 1] = begin[0], (begin[1] * weight[starts])[:, None]
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    padded = np.broadcast_to(np.eye(2), (rows * length, 2, 2)).copy()
    padded[:n] = m
    grid = padded.reshape(rows, length, 2, 2)
    product = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for k in range(length):
        product = product @ grid[:, k]
        product /= product.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((rows, 2)), np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in range(rows):
        ahead[r] = v
        v = v @ product[r]
        v = v / v.sum()
    v = np.array([0.5, 0.5])
    for r in range(rows - 1, -1, -1):
        behind[r] = v
        v = product[r] @ v
        v = v / v.sum()
    a, b, scale = np.empty((rows, length, 2)), np.empty((rows, length, 2)), np.empty((rows, length))
    v = ahead
    for k in range(length):
        v = np.einsum("ri,rij->rj", v, grid[:, k])
        scale[:, k] = v.sum(axis=1)
        v = v / scale[:, k, None]
        a[:, k] = v
    v = behind
    for k in range(length - 1, -1, -1):
        b[:, k] = v
        v = np.einsum("rij,rj->ri", grid[:, k], v)
        v = v / v.sum(axis=1, keepdims=True)
    a, b = a.reshape(-1, 2)[:n], b.reshape(-1, 2)[:n]
    both = a * b
    marginal = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return marginal, np.zeros((2, 2)), 0.0
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    xi = a[at - 1][:, :, None] * m[at] * b[at][:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    return marginal, xi.sum(axis=0), float(np.log(scale.ravel()[:n]).sum())


class Tagger:
    """Feature weights, transitions, and the document score's logistic weights."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, begin: np.ndarray):
        self.weights, self.bias, self.move, self.begin = weights, bias, move, begin
        self.logit = np.array([-20.0, 0.0, 0.0, 0.0])

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(normal(word)))

    def tagged(self, texts: Sequence[str], memo: Memo) -> Iterator[tuple[int, np.ndarray]]:
        """(place, marginals of the words) of the texts that have words, STEP words at a time."""
        own, emits, total = [], [], 0
        for i, text in enumerate(texts):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if words:
                own.append(i)
                emits.append(np.fromiter(map(memo.__getitem__, words), np.float64, len(words)))
                total += len(words)
            del words
            if own and (total >= STEP or i + 1 == len(texts)):
                starts = np.cumsum([0, *map(len, emits)])[:-1]
                p = scan(np.concatenate(emits), starts, self.move, self.begin)[0]
                yield from zip(own, np.split(p, starts[1:]), strict=True)
                own, emits, total = [], [], 0

    def summary(self, texts: Sequence[str], memo: Memo | None = None, found: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
        """Per text: largest marginal, log of one plus the expected toxic words, their share. found gets the
        marginals of texts with a word that is likelier toxic than not."""
        out = np.zeros((len(texts), 3))
        for i, p in self.tagged(texts, Memo(self) if memo is None else memo):
            mass = p.sum()
            out[i] = p.max(), np.log1p(mass), mass / len(p)
            if found is not None and out[i, 0] >= 0.5:
                found(i, p)
        return out

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit[0] + summary @ self.logit[1:], -500, 500)))


class Memo(dict):
    """Lower-cased word bytes: emission; bounded."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = self.tagger.emission(word.decode("utf-8", "surrogatepass"))
        return out


def seeds(toxic: Sequence[Sequence[str]], clean: Sequence[Sequence[str]], least: float = 14.0) -> set[str]:
    """Features of far more toxic than clean documents: likelihood ratio of at least `least`, share of 0.9 at even classes.

    A toxic document counts for a feature only where the words before and after are new for it, so the words that
    copies of one text share are no evidence.
    """
    n1, n0 = len(toxic), len(clean)
    held = Counter(f for words in toxic for f in {f for w in set(words) for f in features(w) if f[0] != "s"})
    around: dict[str, set[int]] = {f: set() for f, k in held.items() if k >= 5}
    del held
    for words in toxic:
        seen: set[str] = set()
        for k, w in enumerate(words):
            if w not in seen:
                for f in features(w):
                    if f in around and f not in seen:
                        around[f].add(zlib.crc32(f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}".encode()))
                        seen.add(f)
                seen.add(w)
    in1 = {f: len(x) for f, x in around.items() if len(x) >= 5}
    in0: Counter[str] = Counter()
    for words in clean:
        in0.update({f for w in set(words) for f in features(w) if f in in1})
    base, out = n1 / (n1 + n0), set()
    for f, k in in1.items():
        m = k + in0[f]
        rate = k / m
        gain = k * np.log(rate / base) + (0 if k == m else (m - k) * np.log((1 - rate) / (1 - base)))
        if rate > base and gain >= least and k / n1 >= 9 * in0[f] / n0:
            out.add(f)
    return out


def fit(rows: Sequence[tuple[str, int]], steps: int = 40, ridge: float = 0.5, most_words: int = FIT_WORDS) -> Tagger | None:
    """Fit on (text, toxic) rows; None if a class is missing. Repeated texts count once. most_words: the field's."""
    rows = sorted(dict(rows).items())
    if len({y for _, y in rows}) < 2:
        return None
    plain = functools.cache(normal)
    told = lambda label: [[sys.intern(plain(w)) for w in t.split()] for t, y in rows if y == label]
    seed = seeds(told(1), told(0))
    del plain, told
    # two of three documents teach the field, as many clean as toxic; the third calibrates the score
    teach = [r for i, r in enumerate(rows) if i % 3]
    toxic = [r for r in teach if r[1]]
    clean = [r for r in teach if not r[1]][: len(toxic) + 20]
    names: dict[str, int] = {}
    flat, owner, label, starts, n = array("i"), array("i"), array("b"), [], 0
    known: dict[str, tuple[list[int], bool]] = {}
    for pair in itertools.zip_longest(toxic, clean):
        for text, y in filter(None, pair):
            words = _WORD.findall(text)
            if not words or n > most_words:
                continue
            starts.append(n)
            for w in words:
                if w not in known:
                    f = features(normal(w))
                    known[w] = [names.setdefault(x, len(names)) for x in f], not seed.isdisjoint(f)
                own, hit = known[w]
                flat.extend(own)
                owner.extend([n] * len(own))
                label.append(hit and bool(y))
                n += 1
    if not any(label):
        return None
    del known
    flat, owner, y, starts = np.array(flat), np.array(owner), np.array(label, np.float64), np.array(starts)
    # a feature of few places says nothing of its own; it shares what the others learn
    often = np.bincount(flat, minlength=len(names))[flat] >= 3
    flat, owner = flat[often], owner[often]
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    weights, bias, trans = np.zeros(len(names)), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros((2, 2))
    gains = [np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    begin = np.array([0.5, 0.5])
    for _ in range(steps):
        emit = bias + np.bincount(owner, weights=weights[flat], minlength=n)
        p, pairs, _ = scan(emit, starts, np.exp(trans), begin, pairs=True)
        gap = y - p
        for k, (grad, now) in enumerate(
            (
                (np.bincount(flat, weights=gap[owner], minlength=len(names)) - ridge * weights, None), (gap.sum(), None),
                (seen - pairs - ridge * trans, None)
            )
        ):
            gains[k] = gains[k] + grad**2
            step = 0.7 * grad / np.sqrt(gains[k])
            if k == 0:
                weights = weights + step
            elif k == 1:
                bias = bias + 0.1 * step
            else:
                trans = trans + 0.2 * step
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 0.02}
    tagger = Tagger(kept, float(bias), np.exp(trans), begin)
    held = [r for i, r in enumerate(rows) if i % 3 == 0]
    if len({y for _, y in held}) < 2:
        held = rows
    x = tagger.summary([t for t, _ in held])
    tagger.logit = logistic(x, np.array([y for _, y in held], float))
    return tagger


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps; the constant is not held back."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, hold = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, chars: int = FIT_CHARS
) -> list[tuple[str, int]]:
    """The bounded fit sample. Its ids are picked from the labels first, so few texts move."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(fold(F.col("doc_id"), folds) != held)
    one = lambda y, n: marks.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = [(r["doc_id"], int(r["toxic"])) for r in one(1, toxic).unionByName(one(0, clean)).collect()]
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, _y int")  # at most toxic + clean rows
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, chars)).join(F.broadcast(ids), "doc_id")
    # one text an id, so repeated ids cannot make it larger than the bound
    return [(r["text"], r["_y"]) for r in rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text")).collect()]


def spans(text: str, marginal: np.ndarray, least: float = 0.5) -> list[dict]:
    """Offsets, in code points, of the words at least so likely toxic."""
    hot = set(np.flatnonzero(marginal >= least).tolist())
    return [{"start": m.start(), "end": m.end(), "p": float(marginal[k])} for k, m in enumerate(_WORD.finditer(text)) if k in hot] if hot else []


def score_documents(docs: DataFrame, tagger: Tagger | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and spans: the toxic words' offsets."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)  # as large as the fit sample's vocabulary at most

    told = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        kept("toxicity", dict)  # drops what other operators left
        memo = Memo(tagger) if tagger else None
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            hot: list[list[dict]] = [[] for _ in texts]
            score = np.zeros(len(texts))
            if tagger:
                score = tagger.score(tagger.summary(texts, memo, lambda i, p, texts=texts, hot=hot: hot[i].extend(spans(texts[i], p))))
            predicted = pa.array((score >= threshold).astype("int32"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score), predicted, pa.array(hot, told)], names=["doc_id", "score", "predicted", "spans"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def clean_documents(docs: DataFrame, tagger: Tagger | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold."""
    if tagger is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        kept("toxicity", dict)  # drops what other operators left
        memo = Memo(tagger)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(tagger.score(tagger.summary(texts, memo)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(sample(docs, table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
