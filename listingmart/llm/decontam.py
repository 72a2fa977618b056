"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Texts are cut into words, lower-cased, without marks. Items fall into length classes by powers of two; a class has
its own index and cuts documents into passages of twice its greatest length, half of that apart, so any copy of an
item lies whole in some passage. Impacts are BM25 term weights, with counts and lengths of all items, divided by
the item's own total, so a whole copy scores 1. Block-max WAND retrieves all items at or above the threshold: best
impacts choose the pivot; maxima on two levels, of at most TOPS runs of blocks and of blocks of BLOCK neighbouring
items, skip. Best impacts and the runs' maxima are summed for many passages at once: by a running sum, then over
the distinct terms. Passages that no run can serve are left out, and WAND passes over the other runs. A candidate is
verified in the passage: at least OVERLAP of the item's five-word shingles, and of the distinct words of its
question (the first two thirds) and of its answer (the rest).

Items are dealt by hash into blocks of about ITEMS, each an index in a file of the shared folder. Documents are read
once: a task matches a run of them against one index after the other and holds KEPT indexes at most. Scores do not
depend on how items are dealt.

Defined results: null and empty texts match nothing; items without words are left out, items of fewer than
five words count as one shingle; equal item texts all match; a null id is reported as null; equal rows each
give their matches; empty tables give an empty result; further columns pass through clean_documents().
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialize, scratch_path, shared_files, slices, table

K1, B, SHINGLE = 1.2, 0.75, 5
THRESHOLD, OVERLAP = 0.5, 0.8
#: Items of one index file, about; neighbouring items that share block maxima; runs of blocks that share maxima of their own.
ITEMS, BLOCK, TOPS = 8000, 4, 64
#: Words matched at once; index files that a worker holds; words that it matches against each file in turn if there are more.
STEP, KEPT, RUN = 100_000, 2, 2_000_000
_NOISE = re.compile(r"[\W_]+")
END, NEXT = 1 << 62, itemgetter(0)


def words_of(text: str) -> list[str]:
    return [w for w in (_NOISE.sub("", x.decode("utf-8", "surrogatepass").lower()) for x in text.encode("utf-8", "surrogatepass").split()) if w]


def length_class(words: int) -> int:
    """Items of up to 2 ** this many words are one class, 4 the first."""
    return max(4, (words - 1).bit_length())


class Index:
    """BM25 postings of items of one length class, with block maxima. df, n and mean are of all items."""

    def __init__(self, items: list[tuple[int | None, list[int]]], threshold: float, df: Sequence[int], n: int, mean: float):
        self.threshold = threshold
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.longest = 1 << length_class(max(map(len, self.words)))
        self.items: dict[int, list[int]] = defaultdict(list)
        self.impact: dict[int, list[float]] = defaultdict(list)
        for k, w in enumerate(self.words):
            counts = Counter(w)
            raw = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in counts.items()
            }
            total = sum(raw.values())
            for t, x in raw.items():
                self.items[t].append(k)
                self.impact[t].append(x / total)
        self.blocks: dict[int, list[tuple[int, float]]] = {}
        for t, v in self.impact.items():
            top: dict[int, float] = {}
            for k, x in zip(self.items[t], v, strict=True):
                top[k // BLOCK] = max(x, top.get(k // BLOCK, 0.0))
            self.blocks[t] = [(b * BLOCK + BLOCK - 1, x) for b, x in sorted(top.items())]
        self.best = {t: max(v) for t, v in self.impact.items()}
        self.run = BLOCK * max(1, -(-len(items) // (BLOCK * TOPS)))
        for v in self.items.values():
            v.append(END)
        cut = [-(-2 * len(w) // 3) for w in self.words]
        self.question = [set(w[:c]) for w, c in zip(self.words, cut, strict=True)]
        self.answer = [set(w[c:]) for w, c in zip(self.words, cut, strict=True)]
        self.shingles = [shingles(w) for w in self.words]

    def tops(self, terms: int) -> np.ndarray:
        """Each term's maxima over the runs of blocks; the last row is of words that no item has."""
        out = np.zeros((terms + 1, -(-len(self.ids) // self.run)), np.float32)
        for t, v in self.impact.items():
            np.maximum.at(out[t], np.array(self.items[t][:-1]) // self.run, np.array(v, np.float32))
        return out

    def search(self, terms: Sequence[int], runs: Sequence[int] | None = None, seen: Counter | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every item scoring the threshold or more, with its score. runs: in ascending order, those whose
        maxima can serve; all, if not given. seen counts scored items and skips."""
        slack, seen, out = self.threshold - 1e-9, Counter() if seen is None else seen, []
        able = [(r * self.run, (r + 1) * self.run) for r in runs] if runs is not None else [(0, len(self.ids))]
        # a list: its next item, that item's place, items (END last), impacts, best impact, place among blocks, blocks
        lists = [[self.items[t][0], 0, self.items[t], self.impact[t], self.best[t], 0, self.blocks[t]] for t in terms]
        for c in lists if able and able[0][0] else ():
            c[1] = bisect_left(c[2], able[0][0])
            c[0] = c[2][c[1]]
        now = 0
        while True:
            lists.sort(key=NEXT)
            bound, pivot = 0.0, -1
            for c in lists:
                pivot += 1
                bound += c[4]
                if bound >= slack:
                    break
            if bound < slack or (item := lists[pivot][0]) == END:
                break
            while now < len(able) and able[now][1] <= item:
                now += 1
            if now == len(able):
                break
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            if item < able[now][0]:
                seen["skips"] += 1
                to = able[now][0]
            else:
                near, edge = 0.0, END
                for c in ahead:  # the blocks that would hold the pivot's item
                    at, blocks = c[5], c[6]
                    while at < len(blocks) and blocks[at][0] < item:
                        at += 1
                    c[5] = at
                    if at < len(blocks):
                        near += blocks[at][1]
                        edge = min(edge, blocks[at][0])
                if near >= slack and lists[0][0] == item:
                    score = 0.0
                    for c in ahead:
                        score += c[3][c[1]]
                        c[1] += 1
                        c[0] = c[2][c[1]]
                    seen["scored"] += 1
                    if score >= slack:
                        out.append((item, score))
                    continue
                to = item
                if near < slack:  # no item up to the nearest block end, or before the next list's, can score enough
                    seen["skips"] += 1
                    to = edge + 1
                    if pivot + 1 < len(lists):
                        to = min(to, lists[pivot + 1][0])
            for c in ahead:
                if c[0] < to:
                    c[1] = bisect_left(c[2], to, c[1])
                    c[0] = c[2][c[1]]
        return out

    def verify(self, item: int, passage: Sequence[int]) -> tuple[float, float, float]:
        """Shares of the item's shingles, question words and answer words that the passage holds."""
        own = set(passage)
        part = lambda want: len(want & own) / len(want) if want else 1.0
        want = self.shingles[item]
        size = min(SHINGLE, len(self.words[item]))
        have = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        return len(want & have) / len(want), part(self.question[item]), part(self.answer[item])


def shingles(words: Sequence[int]) -> set[tuple[int, ...]]:
    size = min(SHINGLE, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class Terms(dict):
    """Lower-cased word bytes: term number, -1 if no item has it, -2 if nothing is left of it; bounded."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        plain = _NOISE.sub("", word.decode("utf-8", "surrogatepass").lower())
        self[word] = out = self.known.get(plain, -1) if plain else -2
        return out


class Matcher:
    """The indexes of one block of items: (id, words), which the file holds; df is of these words, n and mean of all items."""

    def __init__(
        self, items: Sequence[tuple[int | None, list[str]]], df: dict[str, int], n: int, mean: float, threshold: float = THRESHOLD,
        overlap: float = OVERLAP
    ):
        self.known: dict[str, int] = {}
        self.overlap = overlap
        classes: dict[int, list[tuple[int | None, list[int]]]] = defaultdict(list)
        for i, words in items:
            if words:
                classes[length_class(len(words))].append((i, [self.known.setdefault(w, len(self.known)) for w in words]))
        counts = [df[w] for w in self.known]
        order = lambda x: (x[0] is None, x[0] or 0, x[1])
        self.indexes = [Index(sorted(c, key=order), threshold, counts, n, mean) for _, c in sorted(classes.items())]
        self.tops = [index.tops(len(self.known)) for index in self.indexes]
        self.terms = Terms(self.known)

    @classmethod
    def of_texts(cls, items: Sequence[tuple[int | None, str]], **how) -> Matcher:
        """All items at once."""
        split = [(i, words_of(t)) for i, t in items]
        sizes = [len(w) for _, w in split if w]
        return cls(split, Counter(w for _, words in split for w in set(words)), len(sizes), sum(sizes) / max(1, len(sizes)), **how)

    def matches(self, texts: Sequence[str]) -> list[list[dict]]:
        """Per text, its verified items, each with its best passage."""
        terms = self.terms
        out: list[list[dict]] = [[] for _ in texts]
        coded, owners, total = [], [], 0
        for n, text in enumerate(texts):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            ids = np.fromiter(map(terms.__getitem__, words), np.int32, len(words))
            ids = ids[ids != -2]
            if len(ids):
                coded.append(ids)
                owners.append(n)
                total += len(ids)
            if coded and (total >= STEP or n + 1 == len(texts)):
                self._match(coded, owners, out)
                coded, owners, total = [], [], 0
        if coded:
            self._match(coded, owners, out)
        return out

    def _match(self, coded: list[np.ndarray], owners: list[int], out: list[list[dict]]) -> None:
        ids, sizes = np.concatenate(coded), np.array([len(c) for c in coded])
        ends = np.cumsum(sizes)
        for index, tops in zip(self.indexes, self.tops, strict=True):
            size, stride, least = 2 * index.longest + 2 * SHINGLE, index.longest + SHINGLE, index.threshold - 1e-6
            count = np.maximum(1, -(-(sizes - size + stride) // stride))
            doc = np.repeat(np.arange(len(sizes)), count)
            starts = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride + (ends - sizes)[doc]
            stops = np.minimum(starts + size, ends[doc])
            running = np.concatenate([[0.0], np.cumsum(tops.max(axis=1)[ids], dtype=np.float64)])
            kept = np.flatnonzero(running[stops] - running[starts] >= least)
            if not len(kept):
                continue
            # the distinct terms of each passage, and the sums of their maxima
            wide = stops[kept] - starts[kept]
            passage = np.repeat(np.arange(len(kept)), wide)
            term = ids[np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(starts[kept], wide)]
            known = term >= 0
            pairs = np.unique(passage[known].astype(np.int64) * len(tops) + term[known])
            if not len(pairs):
                continue
            passage, term = pairs // len(tops), pairs % len(tops)
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            last = np.append(first[1:], len(pairs))
            found: dict[tuple[int, int], dict] = {}
            able = np.add.reduceat(tops[term], first, axis=0) >= least
            for k in np.flatnonzero(able.any(axis=1)).tolist():
                own = [t for t in term[first[k] : last[k]].tolist() if t in index.items]
                here = kept[passage[first[k]]]
                text = None
                for item, score in index.search(own, np.flatnonzero(able[k]).tolist()):
                    text = text or ids[starts[here] : stops[here]].tolist()
                    share, question, answer = index.verify(item, text)
                    key = (int(doc[here]), item)
                    if min(share, question, answer) >= self.overlap and (key not in found or share > found[key]["overlap"]):
                        found[key] = {"item_id": index.ids[item], "score": score, "overlap": share, "question": question, "answer": answer}
            for d, item in sorted(found):
                out[owners[d]].append(found[d, item])


def split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [words_of(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(words, pa.list_(pa.string()))], names=["item_id", "words"])


class Files:
    """The matchers of all blocks, as files of the shared folder."""

    def __init__(self, uri: str, names: Sequence[str]):
        self.uri, self.names = uri, names

    def put(self, name: str, matcher: Matcher) -> None:
        fs, top = shared_files(self.uri)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(pickle.dumps(matcher, protocol=5))

    def get(self, name: str) -> Matcher:
        held = kept(f"decontamination {self.uri}", dict)
        if name not in held:
            while len(held) >= KEPT:
                held.pop(next(iter(held)))
            fs, top = shared_files(self.uri)
            with fs.open_input_stream(f"{top}/{name}") as f:
                held[name] = pickle.loads(f.read())  # noqa: S301 (this job's own file)
        return held[name]

    def matches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[dict]]]]:
        """The batches with each text's matches of all files. With more files than are held, runs of batches go through
        them together, so that each file is read once a run."""
        waiting, size = [], 0
        for b in slices(batches):
            waiting.append(b)
            size += b.column("text").nbytes // 6
            if len(self.names) <= KEPT or size >= RUN:
                yield from self._through(waiting)
                waiting, size = [], 0
        yield from self._through(waiting)

    def _through(self, batches: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[dict]]]]:
        found: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in batches]
        for name in self.names:
            matcher = self.get(name)
            for b, rows in zip(batches, found, strict=True):
                for mine, more in zip(rows, matcher.matches([t or "" for t in b.column("text").to_pylist()]), strict=True):
                    mine.extend(more)
        yield from zip(batches, found, strict=True)


def index_files(benchmark: DataFrame, items: int = ITEMS, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Files:
    """Builds the indexes one after the other; the driver holds one block's items and words."""
    spark = benchmark.sparkSession
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = materialize(rows.mapInArrow(split_items, "item_id long, words array<string>").filter("size(words) > 0"), "items")
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    blocks = -(-n // items)
    files = Files(scratch_path(spark, "item-indexes"), [f"block-{k}" for k in range(blocks)])
    if not n:
        return files
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
    words = rows.select("block", F.explode(F.array_distinct("words")).alias("word"))
    df = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "item-words")
    for k, name in enumerate(files.names):
        some = [(r["item_id"], r["words"]) for r in rows.filter(F.col("block") == k).collect()]
        counts = df.join(words.filter(F.col("block") == k).select("word").distinct(), "word", "left_semi").collect()
        files.put(name, Matcher(some, {r["word"]: r["n"] for r in counts}, n, total / n, threshold, overlap))
    return files


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, score, overlap, question and answer shares of every verified match."""
    files = index_files(benchmark, **how)
    names, kinds = ["doc_id", "item_id", "score", "overlap", "question", "answer"], [pa.int64(), pa.int64(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in files.matches(batches):
            rows = [(i, *(m[c] for c in names[1:])) for i, ms in zip(b.column("doc_id").to_pylist(), found, strict=True) for m in ms]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, item_id long, score double, overlap double, question double, answer double")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns as they are, that match no item."""
    files = index_files(benchmark, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in files.matches(batches):
            yield b.filter(pa.array([not m for m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
