"""Token-id output: shard files of ids with Elias-Fano coded document boundaries.

A shard file is MAGIC, then sections, each 8-byte aligned, then a footer of their places:

    ids        one 2-byte or 4-byte number per token, documents one after another, little-endian
    bounds     Elias-Fano sequence of the document starts and the end
    doc ids    Elias-Fano sequence of the ids' distances to the least one (after `nulls` documents without id)

An Elias-Fano sequence of m numbers up to u keeps the low floor(log2(u / m)) bits packed and the high bits
in unary, about 2 + log2(u / m) bits a number. A directory of every SAMPLE-th one bit (4-byte places), stored with
it, makes select(i) read a few words; there is no table of 64-bit offsets. Documents are read back by select.

Documents are range-partitioned and sorted by id; each partition streams its ids to a file under a name
of its own attempt and renames it, so a repeated or lost task does no harm. Files go through the file system
of the folder's URI, the one that driver and executors share.

Defined results: a null text is empty and has the end id alone; null ids come first, ties go by text; equal
rows all count; an empty table gives an empty result; further columns are not looked at; long texts are
coded whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialize, scratch_path, shared_files, table

MAGIC, SAMPLE, END_ID = b"EFTOKEN1", 256, 0
TOKENIZER = "byte_bpe_50k.json"


class EliasFano:
    """Non-decreasing non-negative numbers in near-minimal space, with select."""

    HEAD = "<QBQQQ"

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        x = np.asarray(values, dtype=np.int64)
        n, top = len(x), int(x[-1]) if len(x) else 0
        k = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((x[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel() if k else np.empty(0, np.uint8)
        high = np.zeros(n + (top >> k) + 1, np.uint8)
        ones = (x >> k) + np.arange(n)
        high[ones] = 1
        directory = ones[::SAMPLE]
        if n and directory[-1] >> 32:
            raise ValueError("too many numbers for 4-byte places")
        return cls(n, k, np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little"), directory.astype("<u4"))

    def _low(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        if self.low_bits:
            first, last = at >> 3, (at + self.low_bits + 7) >> 3
            out = (int.from_bytes(self.low[first:last].tobytes(), "little") >> (at & 7)) & ((1 << self.low_bits) - 1)
        return out

    def select(self, i: int) -> int:
        """The i-th number: from the sampled place on, whole bytes by their bit counts."""
        at, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (c := word.bit_count()) <= left:
            left, byte = left - c, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high.astype(np.int64) << self.low_bits) + bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def dump(self) -> bytes:
        sections = [x.tobytes() for x in (self.low, self.high, self.directory)]
        return struct.pack(self.HEAD, self.n, self.low_bits, *map(len, sections)) + b"".join(sections)

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, k, a, b, c = struct.unpack_from(cls.HEAD, data)
        at = struct.calcsize(cls.HEAD)
        return cls(
            n, k, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b)
        )


class ShardWriter:
    """Streams documents' ids in, in ascending doc_id order; keeps two numbers a document."""

    def __init__(self, out, wide: bool):
        self.out, self.kind = out, np.dtype("<u4" if wide else "<u2")
        self.starts, self.docs, self.nulls, self.at = array("q", [0]), array("q"), 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: of the file's width."""
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(int(doc_id))
        self.out.write(ids)
        self.at += len(ids) // self.kind.itemsize
        self.starts.append(self.at)

    def close(self) -> None:
        least = self.docs[0] if self.docs else 0
        docs = np.array(self.docs, np.int64)
        far = bool(len(docs)) and int(docs[-1]) - least >= 1 << 62  # ids of both signs' ends: one by one is no shorter
        parts = [EliasFano.of(np.array(self.starts, np.int64)).dump(), docs.tobytes() if far else EliasFano.of(docs - least).dump()]
        for p in parts:
            self.out.write(p)
        self.out.write(struct.pack("<QQQQqBB", self.at, len(parts[0]), len(parts[1]), self.nulls, least, self.kind.itemsize, far) + MAGIC)


class Shard:
    """A shard file's bytes, read."""

    def __init__(self, data: bytes):
        tail = struct.calcsize("<QQQQqBB")
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a whole shard file")
        n, a, b, self.nulls, self.least, width, far = struct.unpack("<QQQQqBB", data[-8 - tail : -8])
        self.ids = np.frombuffer(data, f"<u{width}", n, 8)
        at = 8 + n * width
        self.bounds, docs = EliasFano.load(data[at : at + a]), data[at + a : at + a + b]
        self._docs = np.frombuffer(docs, "<i8") if far else EliasFano.load(docs)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc(self, i: int) -> np.ndarray:
        """The ids of the i-th document, through select alone."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_id(self, i: int) -> int | None:
        if i < self.nulls:
            return None
        i -= self.nulls
        return int(self._docs[i]) if isinstance(self._docs, np.ndarray) else self._docs.select(i) + self.least


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def vocabulary(path: str) -> int:
    return load_tokenizer(path).get_vocab_size()


#: ASCII marks that end words; the tokenizer cuts a run of them from the letters before it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Odd(Exception):
    """A space that another space or the end follows."""


class Words(dict):
    """A word (with or without a space before it): its ids' bytes. Bounded.

    Latin letters are one piece for the tokenizer's model; marks behind them are another, and so is a line end between
    two words. All other words go through the whole tokenizer.
    """

    LETTERS = byte_letters()

    def __init__(self, tokenizer, kind: np.dtype, limit: int, space: str = " "):
        super().__init__()
        self.tokenizer, self.model, self.limit, self.space = tokenizer, tokenizer.model, limit, space
        self.kind = "H" if kind.itemsize == 2 else "I"
        self.tails: dict[str, bytes] = {}
        self.marked: dict[str, bytes] = {}
        self.bare = Words(tokenizer, kind, limit // 8, "") if space else None

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if (out := self.marked.get(word)) is not None:
            return out
        if self.space and (not word or word[0].isspace()):
            raise Odd
        core = word.rstrip(MARKS)
        if not core.isalpha() or not core.isascii() and max(core) >= "\u0250":
            if self.space and "\n" in word:
                return self.lines(word)
            out = self.whole(self.space + word)
        elif len(core) < len(word):
            tail = word[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self.whole(tail)
            if len(self.marked) > self.limit // 4:
                self.marked.clear()
            self.marked[word] = out = self[core] + self.tails[tail]
            return out
        else:
            piece = (self.space + word).encode().decode("latin-1").translate(self.LETTERS)
            out = self.packed([t.id for t in self.model.tokenize(piece)])
        if len(self) > self.limit:
            self.clear()
        self[word] = out
        return out

    def lines(self, word: str) -> bytes:
        """Words that single line ends part. Such words are seldom met again, so only their parts are kept."""
        first, *rest = word.split("\n")
        if not first or any(not w or w[0].isspace() or w[-1].isspace() for w in (first, *rest)):
            return self.whole(self.space + word)
        if "\n" not in self.tails:
            self.tails["\n"] = self.whole("\n")
        end = self.tails["\n"]
        return self[first] + b"".join(end + self.bare[w] for w in rest)


class Encoder:
    """Texts to ids' bytes with the tokenizer, a word coded once while it is remembered.

    A byte-level tokenizer cuts texts before it merges, and always before a space that a non-space follows,
    so such texts may be coded word by word. Texts with other spaces after a space are coded whole.
    """

    def __init__(self, tokenizer, kind: np.dtype, limit: int = 800_000):
        self.words, told = Words(tokenizer, kind, limit), json.loads(tokenizer.to_str())
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [told["pre_tokenizer"]])
        self.added = [t["content"] for t in told["added_tokens"]]  # the tokenizer looks for these names in texts first
        self.by_word = told["normalizer"] is None and not told["model"].get("ignore_merges") and all(
            x and x["type"] == "ByteLevel" and not x["add_prefix_space"] and x.get("use_regex", True) for x in steps
        )

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, whole, out = self.words.__getitem__, self.words.whole, []
        for t in texts:
            if not self.by_word or any(name in t for name in self.added):
                out.append(whole(t))
                continue
            first, *rest = t.split(" ")
            try:
                out.append(whole(first) + b"".join(map(get, rest)))
            except Odd:
                out.append(whole(t))
        return out


def encoder(path: str, kind: np.dtype) -> Encoder:
    """This worker's encoder; what it remembers serves later tasks too."""
    return kept(f"encoder {path} {kind.str}", lambda: Encoder(load_tokenizer(path), kind))


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) as shard files; returns their list: shard, path, docs, tokens."""
    spark = docs.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("text").rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        wide = max(vocabulary(tokenizer_path), end_id) > 0xFFFF
        kind = np.dtype("<u4" if wide else "<u2")
        code, end = encoder(tokenizer_path, kind), np.array([end_id], kind).tobytes()
        fs, top = shared_files(folder)
        fs.create_dir(top, recursive=True)
        name, attempt = f"{top}/shard-{context.partitionId():06d}.eft", f"{top}/.attempt-{context.taskAttemptId()}"
        out = writer = None
        for b in batches:
            if b.num_rows and writer is None:
                out = fs.open_output_stream(attempt)
                writer = ShardWriter(out, wide)
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc_id, coded in zip(some.column("doc_id").to_pylist(), code(texts), strict=True):
                    writer.add(doc_id, coded + end)
        if writer is not None:
            writer.close()
            out.close()
            if fs.get_file_info(name).type.name != "NotFound":
                fs.delete_file(name)  # a task that ran before; its bytes are the same
            fs.move(attempt, name)
            row = {"shard": pa.array([context.partitionId()], pa.int32()), "path": [name], "docs": [len(writer.starts) - 1], "tokens": [writer.at]}
            yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        parts, F.asc_nulls_first("doc_id"), F.xxhash64("text")
    ).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return materialize(rows.mapInArrow(write, "shard int, path string, docs long, tokens long"), "shards")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files and by select: doc_id, start, n_tokens, ids_crc32. The list has one row a shard."""
    spark = shards.sparkSession
    listed = sorted((r["shard"], r["path"], r["tokens"]) for r in shards.select("shard", "path", "tokens").collect())
    rows, at = [], 0
    for shard, path, tokens in listed:
        rows.append((shard, path, at))
        at += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = shared_files(folder)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    s = Shard(f.read())
                for lo in range(0, len(s), 10_000):
                    some = range(lo, min(lo + 10_000, len(s)))
                    bounds = np.array([s.bounds.select(i) for i in (*some, some.stop)])
                    crc = [zlib.crc32(s.ids[a:z].astype("<u4").tobytes()) for a, z in itertools.pairwise(bounds)]
                    ids = pa.array([s.doc_id(i) for i in some], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    listed_df = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)))
    return listed_df.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer_path), folder)


def op6_tokens(spark, sf_dir):
    return encode_and_read(table(spark, sf_dir, "documents"))
