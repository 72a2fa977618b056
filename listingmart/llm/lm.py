"""LM scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and an end symbol. The tree's states are contexts: up to DEPTH words that
precede a symbol within its document. Every context of two training places or more is judged (one of a single
place gains nothing, so it cannot pass). It is kept if its divergence from the next shorter context, measured
as the leave-one-out log-likelihood gain of its next-symbol counts at the best of WEIGHTS, reaches GAIN. A
symbol is scored in the longest kept suffix of its history; distributions are smoothed along the kept suffixes:

    P(w | s) = (c(s, w) + a * P(w | shorter s)) / (c(s) + a),   P(w) = (c(w) + d) / (N + d * (V + 1))

so each is a distribution over the V known symbols and one for all unknown ones.

Contexts and counts stay distributed and grow with the corpus. c(s, w) is the count of the gram s w, and c(s),
as something always follows s, that of the gram s: all are gram counts, and a place reads its context's from
the place before. Documents are coded in parts of at least PART words (a document is never cut), each a file in
the shared folder. In three rounds each part sends what it asks about to buckets by hash, and a bucket answers
each part:

1. the counts of single words, and of each two and three words whether another part has them too. For this their
   hashes are cut to a few bits more than the corpus has symbols; grams taken for others only cost a question later.
2. the counts of longer grams, but only of those whose twos and threes are all met elsewhere: any other gram is of
   this part alone and counted here. Of the parts that ask about a gram one is told that it speaks for it.
3. the verdict on each context, from its symbols' gains, each sent by the part that speaks for it. Contexts of one
   part are judged there, and one that has a single symbol but for one place at most where that symbol stands.

Grams of two words and more go by hashes of as many bits as give one in a million of them another one's counts, at
any size of the corpus; single words by 64 bits. Gains are summed as whole numbers of 1 / UNIT, so the model is the same however documents fall into parts. A
gram's load is one entry a part, whatever its frequency. What a part has learnt is a further file beside its first;
rows name the files that their attempt wrote, so repeated and lost tasks do no harm. The driver holds totals only.

Defined results: null texts are empty and have the end symbol alone; null ids count as the empty text for the
fold (held out); equal rows score equally and each counts; without training text all counts are zero; an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kept, materialize, scratch_path, shared_files, table

DEPTH, GAIN, DELTA = 3, 20.0, 0.1
#: What the shorter context's distribution weighs in a state's, against its own counts; the best is chosen by state.
WEIGHTS = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
#: Gains are whole numbers of 1 / UNIT.
UNIT = 1 << 16
#: Words of a part; training symbols for each bucket; tasks that parts are dealt to at most.
PART, BUCKET, TASKS = 600_000, 1_500_000, 20_000
FOLDS = 10
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = b" "  # no word holds a space
_pack, _unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def packed(a: np.ndarray) -> bytes:
    """All first bytes of the values, all second ones, and so on, compressed."""
    a = np.ascontiguousarray(a)
    return _pack(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    columns = np.frombuffer(_unpack(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.array(columns.T, order="C").reshape(-1).view(kind)


def packed_sorted(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, "<u8"), dtype=np.uint64)


class Numbers(dict):
    """Word bytes: number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def symbols(text: str | None) -> list[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def parts(batches: Iterator[pa.RecordBatch], size: int = PART) -> Iterator[tuple[list, np.ndarray, np.ndarray, Numbers]]:
    """(ids, symbols of each document, word numbers end to end, numbering) of runs of documents."""
    ids, sizes, coded, total, numbers = [], [], [], 0, Numbers()
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = symbols(text)
            ids.append(doc_id)
            sizes.append(len(found))
            coded.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            total += len(found)
            if total >= size:
                yield ids, np.array(sizes), np.concatenate(coded), numbers
                ids, sizes, coded, total, numbers = [], [], [], 0, Numbers()
    if ids:
        yield ids, np.array(sizes), np.concatenate(coded), numbers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Folder:
    """Files of the shared folder. Each write has a name of its own, which the rows of its attempt carry."""

    def __init__(self, uri: str):
        self.uri = uri

    def put(self, *fields: bytes) -> str:
        fs, top = shared_files(self.uri)
        fs.create_dir(top, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(struct.pack(f"<{1 + len(fields)}Q", len(fields), *map(len, fields)))
            for x in fields:
                f.write(x)
        return name

    def get(self, name: str) -> list[bytes]:
        fs, top = shared_files(self.uri)
        with fs.open_input_stream(f"{top}/{name}") as f:
            (n,) = struct.unpack("<Q", f.read(8))
            sizes = struct.unpack(f"<{n}Q", f.read(8 * n))
            return [f.read(k) for k in sizes]


Asked = list[tuple[int, np.ndarray]]


def flags(x: np.ndarray) -> bytes:
    return struct.pack("<Q", len(x)) + packed(np.packbits(x))


def unflagged(b: bytes) -> np.ndarray:
    return np.unpackbits(unpacked(b[8:], "u1"), count=struct.unpack_from("<Q", b)[0]).astype(bool)


class Part:
    """The symbols of a part, the hashes of the grams that end at each place, their training counts as far as they
    are known, and the grams it asks about.

    Whatever is asked about is a list of (words of the gram, places where it ends). `state` names the part's files.
    Hashes of grams of two words and more, and of contexts, have `width` bits. whole[k]: places where a gram of k
    words ends that other parts may have; lead[k]: one place of each gram that this part speaks for.
    """

    def __init__(self, folder: Folder, state: str, depth: int, least: float, width: int = 64):
        self.folder, self.state, self.depth, self.least, self.width = folder, state, depth, least, width
        files = [folder.get(name) for name in state.split()]
        a, b, c, d, e = files[0]
        self.coded, self.sizes, hashes = unpacked(a, "<i4"), unpacked(b, "<i4").astype(np.int64), unpacked(c, "<u8")
        self.ids = [None if x else int(i) for i, x in zip(unpacked(d, "<i8"), unpacked(e, "?"), strict=True)]
        n, self.hashes, self.longest = len(self.coded), hashes, depth + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.fresh = np.arange(n) - np.repeat(self.starts, self.sizes)
        self.train = np.repeat([not is_held_out(i) for i in self.ids], self.sizes)
        self.gram = [None, hashes[self.coded]]
        for k in range(2, self.longest + 1):
            longer = np.zeros(n, np.uint64)
            longer[k - 1 :] = mixed(self.gram[k - 1][k - 1 :] * np.uint64(0x9E3779B97F4A7C15) + self.gram[1][: 1 - k] + np.uint64(k))
            self.gram.append(longer)
        cut = [None, *(g >> np.uint64(64 - width) for g in self.gram[1:])]
        self.gram, self.context = [None, self.gram[1], *cut[2:]], cut
        kinds = range(self.longest + 1)
        self.n = [np.zeros(n, np.int64) for _ in kinds]
        self.whole, self.lead = [np.zeros(n, bool) for _ in kinds], [np.zeros(n, bool) for _ in kinds]
        if len(files) > 1:
            self.n[1] = unpacked(files[1][0], "<i8")[self.coded]
            self.whole[2:4] = [unflagged(x) for x in files[1][1:3]]
            self._spread()
            counts = files[1][3:] if len(files) == 2 else files[2]
            self.n[2:] = [unpacked(x, "<i8") for x in counts[:depth]]
            self.lead[2:] = [unflagged(x) for x in counts[depth:]]
        self.known = [(unpacked(a, "<i1"), unflagged(b)) for a, b in zip(files[3][:depth], files[3][depth:], strict=True)] if len(files) > 3 else []

    def _spread(self) -> None:
        """Longer grams may be elsewhere if all their threes may."""
        self.whole[3][1:] &= self.whole[2][1:] & self.whole[2][:-1]
        for k in range(4, self.longest + 1):
            self.whole[k][1:] = self.whole[k - 1][1:] & self.whole[k - 1][:-1]
            self.whole[k] &= self.fresh >= k - 1

    def keep(self, *fields: bytes) -> None:
        self.state += " " + self.folder.put(*fields)

    def keep_counts(self, *first: bytes) -> None:
        ks = range(2, self.longest + 1)
        self.keep(*first, *(packed(self.n[k]) for k in ks), *(flags(self.lead[k]) for k in ks))

    def all_of(self, k: int) -> Asked:
        return [(k, np.flatnonzero(self.fresh >= k - 1))]

    def grams(self) -> Asked:
        """What other parts are asked about: grams that they may have and whose context can have the least count."""
        out = [(2, np.flatnonzero(self.whole[2]))]
        for k in range(3, self.longest + 1):
            out.append((k, np.flatnonzero(self.whole[k])))
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes in order, and each word number's position among them."""
        order = np.argsort(self.hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return self.hashes[order], place

    def distinct(self, asked: Asked, contexts: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """The hashes, each once and in order, and of each list's places the positions among them."""
        hashes = self.context if contexts else self.gram
        kinds, inverse = np.unique(np.concatenate([hashes[k][at] for k, at in asked] or [np.zeros(0, np.uint64)]), return_inverse=True)
        return kinds, np.split(inverse, np.cumsum([len(at) for _, at in asked])[:-1])

    def counted(self, asked: Asked) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The distinct hashes, their training counts here, and the places' positions among them."""
        kinds, places = self.distinct(asked)
        counts = np.zeros(len(kinds), np.int64)
        for (_, at), own in zip(asked, places, strict=True):
            counts += np.bincount(own[self.train[at]], minlength=len(kinds))
        return kinds, counts, places

    def first_places(self, k: int, at: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
        """lead[k] at the last listed place of each chosen kind."""
        place = np.full(len(chosen), -1)
        place[own] = at
        self.lead[k][place[chosen & (place >= 0)]] = True

    def learn_words(self, answers: pd.DataFrame) -> None:
        """What round 1 told; grams that no other part has are counted here."""
        of_word = joined(answers["a"], "<i8")[self.words()[1]]
        self.n[1] = of_word[self.coded]
        found = {}
        for k, told in ((2, answers["b"]), (3, answers["c"])):
            if k <= self.longest:
                _, counts, (own,) = self.counted(self.all_of(k))
                found[k] = self.all_of(k)[0][1], own, counts
                self.whole[k][found[k][0]] = np.concatenate([unflagged(x) for x in told])[own]
        self._spread()
        able = np.ones(len(self.coded), bool)
        for k in range(2, self.longest + 1):
            fits = (self.fresh >= k - 1) & ~self.whole[k]
            fits[1:] &= able[:-1]  # alike for all places of a gram
            if k in found:
                at, own, counts = found[k]
                at, own = at[fits[at]], own[fits[at]]
            else:
                at = np.flatnonzero(fits)
                _, counts, (own,) = self.counted([(k, at)])
            self.n[k][at] = counts[own]
            self.first_places(k, at, own, np.ones(len(counts), bool))
            able = self.whole[k] | (self.n[k] >= self.least)
        self.keep_counts(packed(of_word), flags(self.whole[2]), flags(self.whole[3]))

    def learn_grams(self, answers: pd.DataFrame) -> None:
        """What round 2 told, beside the counts of this part's own grams."""
        asked = self.grams()
        sums, speaks = joined(answers["a"], "<i8"), np.concatenate([unflagged(x) for x in answers["b"]])
        for (k, at), own in zip(asked, self.distinct(asked)[1], strict=True):
            self.n[k][at] = sums[own]
            self.first_places(k, at, own, speaks)
        self.keep_counts()

    def contexts(self) -> Asked:
        """Contexts that are judged; the symbol in question is at the next place."""
        return [(d, np.flatnonzero((self.fresh[1:] >= d) & (self.n[d][:-1] >= self.least))) for d in range(1, self.depth + 1)]

    def weighed(self, total: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: words, where contexts end, their counts, those of the symbols after them and these symbols' chances after the shorter context."""
        chance = np.maximum(self.n[1], 1) / max(total, 1)
        for d, at in self.contexts():
            about, c, above = self.n[d][at], self.n[d + 1][at + 1], chance[at + 1]
            yield d, at, about, c, above
            chance[at + 1] = (c + about * above) / (2 * about)

    def here_only(self, d: int, at: np.ndarray) -> np.ndarray:
        """Whether no other part has the context."""
        return np.zeros(len(at), bool) if d == 1 else ~self.whole[d][at]

    def verdicts(self, total: int, gain: float) -> Iterator[
        tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    ]:
        """By depth: words, places, verdicts (-1: not known here), whether no other part has the context, their counts, and of
        the places that speak for a symbol that follows twice or more: positions, the symbols' counts and gains."""
        for d, at, about, c, above in self.weighed(total):
            verdict, closed = np.full(len(at), -1, np.int8), self.here_only(d, at)
            clear = (c > 0) & (about - c <= 1)
            verdict[clear] = 0
            again = np.flatnonzero(clear & (c > 1))
            verdict[again] = verdict_of(about[again], c[again], terms_of(about[again], c[again], above[again]) * c[again, None], gain)
            again = np.flatnonzero((c > 1) & self.lead[d + 1][at + 1] & (closed | ~clear))
            size, terms = c[again], terms_of(about[again], c[again], above[again]) * c[again, None]
            left = np.flatnonzero(closed)
            if len(left):
                kinds, of = np.unique(self.context[d][at[left]], return_inverse=True)
                of_place, whole_size = np.full(len(at), -1), np.zeros(len(kinds), np.int64)
                of_place[left], whole_size[of] = of, about[left]
                mine = closed[again]
                verdict[left] = verdict_of(whole_size, *summed(of_place[again[mine]], size[mine], terms[mine], len(kinds)), gain)[of]
                again, size, terms = again[~mine], size[~mine], terms[~mine]
            yield d, at, verdict, closed, about, again, size, terms

    def gains(self, total: int, gain: float) -> tuple[np.ndarray, ...]:
        """The distinct contexts asked about or told of, told verdicts or 0, counts, and of the symbols spoken for here: their
        places' number, and their gains by weight; then the number of kept contexts that no other part has.

        A verdict of 0 is not told, as no news means the same."""
        judged, asked, chosen, states = list(self.verdicts(total, gain)), [], [], 0
        for d, at, verdict, closed, *_ in judged:
            x = np.flatnonzero(~closed & ((verdict < 0) | (verdict > 0) & self.lead[d + 1][at + 1]))
            asked.append((d, at[x]))
            chosen.append(x)
            states += len(np.unique(self.context[d][at[closed & (verdict > 0)]]))
        masks = [np.zeros(len(j[1]), bool) for j in judged]
        for mask, x in zip(masks, chosen, strict=True):
            mask[x] = True
        self.keep(*(packed(j[2]) for j in judged), *map(flags, masks))
        kinds, places = self.distinct(asked, contexts=True)
        n = len(kinds)
        told, size, repeats, sums = np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(WEIGHTS)), np.int64)
        for (_, at, verdict, _, about, again, c, terms), x, own in zip(judged, chosen, places, strict=True):
            np.maximum.at(told, own, verdict[x])
            size[own] = about[x]
            position = np.full(len(at), -1)
            position[x] = own
            more, of = summed(position[again], c, terms, n)
            repeats, sums = repeats + more, sums + of
        return kinds, told, size, repeats, sums, states

    def scores(self, verdicts: pd.DataFrame, total: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Each place's chance by its word alone, and in its longest kept context."""
        base = (self.n[1] + DELTA) / (total + DELTA * (known + 1))
        p, contexts = base.copy(), self.contexts()
        asked = [(d, at[chosen]) for (d, at), (_, chosen) in zip(contexts, self.known, strict=True)]
        told = joined(verdicts["a"], "<i1")
        for (d, at), (verdict, chosen), own in zip(contexts, self.known, self.distinct(asked, contexts=True)[1], strict=True):
            verdict[chosen] = told[own]
            stays = verdict > 0
            at, size = at[stays], self.n[d][at[stays]]
            mass = size * np.array(WEIGHTS)[verdict[stays] - 1]
            p[at + 1] = (self.n[d + 1][at + 1] + mass * p[at + 1]) / (size + mass)
        return base, p


def terms_of(size: np.ndarray, c: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What a place adds to its context's gain at each weight, where the symbol follows c times, in whole UNITs."""
    rare = np.log(above)
    return np.stack([np.rint((np.log(c - 1 + w * size * above) - rare) * UNIT) for w in WEIGHTS], axis=1).astype(np.int64)


def summed(at: np.ndarray, repeats: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeats and terms by position, as exact whole numbers."""
    count, sums = np.zeros(n, np.int64), np.zeros((n, terms.shape[1]), np.int64)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        to = at[order][first]
        count[to], sums[to] = np.add.reduceat(repeats[order], first), np.add.reduceat(terms[order], first, axis=0)
    return count, sums


def verdict_of(size: np.ndarray, repeats: np.ndarray, sums: np.ndarray, gain: float) -> np.ndarray:
    """The number of the best weight, from 1, or 0. A symbol that follows only once adds log(weight * size), whatever its chance."""
    w, size = np.array(WEIGHTS), size[:, None]
    worth = sums / UNIT + (size - repeats[:, None]) * np.log(w * size) - size * np.log(size - 1 + w * size)
    return np.where(worth.max(axis=1, initial=-np.inf) >= gain, worth.argmax(axis=1) + 1, 0).astype(np.int8)


def joined(packs: pd.Series, kind: str) -> np.ndarray:
    return np.concatenate([unpacked(x, kind) for x in packs] or [np.zeros(0, kind)])


def ranges(kinds: np.ndarray, buckets: int, width: int = 64) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes of so many bits: a bucket is a range of hashes. The first bucket is always there."""
    bucket = (((kinds >> np.uint64(width - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    out = [(int(bucket[lo]), lo, hi) for lo, hi in zip(cuts, [*cuts, len(kinds)][1:], strict=True)]
    return out if out and out[0][0] == 0 else [(0, 0, 0), *out]


SENT = "part string, state string, bucket int, a binary, b binary, c binary, d binary, e binary, n long"
ANSWER = "part string, state string, bucket int, a binary, b binary, c binary, n long"


def sent(part: str, state: str, rows: list[tuple], n: int = 0) -> pd.DataFrame:
    """n stands in the first row."""
    full = [(part, state, *r, *[None] * (6 - len(r)), 0 if k else n) for k, r in enumerate(rows)]
    return pd.DataFrame(full, columns=["part", "state", "bucket", "a", "b", "c", "d", "e", "n"])


def send_words(part: str, me: Part, buckets: int, bits: int) -> pd.DataFrame:
    """Words with their counts, and the cut hashes of grams of two and three words."""
    kinds, place = me.words()
    counts = np.bincount(place[me.coded[me.train]], minlength=len(kinds)).astype(np.int64)
    longer = [me.distinct(me.all_of(k))[0] for k in (2, 3)] if me.longest > 2 else [me.distinct(me.all_of(2))[0], np.zeros(0, np.uint64)]
    cut = [x >> np.uint64(me.width - bits) for x in longer]
    found = [{b: (lo, hi) for b, lo, hi in ranges(x, buckets, w)} for x, w in ((kinds, 64), (longer[0], me.width), (longer[1], me.width))]
    rows = []
    for b in sorted(set().union(*found)):
        (lo, hi), *more = (f.get(b, (0, 0)) for f in found)
        rows.append((b, packed_sorted(kinds[lo:hi]), packed(counts[lo:hi]), *(packed_sorted(x[i:j]) for x, (i, j) in zip(cut, more, strict=True))))
    return sent(part, me.state, rows)


def send_counts(part: str, me: Part, buckets: int) -> pd.DataFrame:
    kinds, counts, _ = me.counted(me.grams())
    return sent(part, me.state, [(b, packed_sorted(kinds[lo:hi]), packed(counts[lo:hi])) for b, lo, hi in ranges(kinds, buckets, me.width)])


def send_gains(part: str, me: Part, total: int, gain: float, buckets: int) -> pd.DataFrame:
    kinds, told, size, repeats, sums, states = me.gains(total, gain)
    rows = []
    for b, lo, hi in ranges(kinds, buckets, me.width):
        at = np.flatnonzero(repeats[lo:hi])
        own = lo + at
        rows.append(
            (
                b, packed_sorted(kinds[lo:hi]), packed(told[lo:hi]), packed(at.astype(np.int32)), packed(np.stack([size[own], repeats[own]])),
                packed(sums[own].T)
            )
        )
    return sent(part, me.state, rows, states)


def asked_here(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, each sent hash's position among them, and where each row's begin."""
    kinds, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return kinds, place, np.cumsum([0, *map(len, hashes)])


def answered(g: pd.DataFrame, n: int, *fields: list[bytes]) -> pd.DataFrame:
    """A row for each of the parts' rows; n stands in the first."""
    full = [*fields, *([b""] * len(g) for _ in range(3 - len(fields)))]
    out = pd.DataFrame({"part": g["part"], "state": g["state"], "bucket": g["bucket"], **dict(zip("abc", full, strict=True)), "n": 0})
    out.iloc[0, -1] = n
    return out


def total_of(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Exact sums: counts of one part are far below 2 ** 53, and so are their sums' halves."""
    low, high = counts & 0xFFFFFF, counts >> 24
    add = lambda x: np.bincount(place, weights=x, minlength=n).astype(np.int64)
    return add(low) + (add(high) << 24) if high.any() else add(low)


def add_words(g: pd.DataFrame) -> pd.DataFrame:
    """Words with their counts over all parts, n: those with a count; and which longer grams are sent twice or more, by their cut hashes."""
    kinds, place, starts = asked_here([unpacked_sorted(a) for a in g["a"]])
    sums = total_of(place, joined(g["b"], "<i8"), len(kinds))
    met = []
    for column in "cd":
        cut, at, begins = asked_here([unpacked_sorted(x) for x in g[column]])
        met.append([flags(x) for x in np.split((np.bincount(at, minlength=len(cut)) > 1)[at], begins[1:-1])])
    return answered(g, int((sums > 0).sum()), [packed(x) for x in np.split(sums[place], starts[1:-1])], *met)


def add_up(g: pd.DataFrame) -> pd.DataFrame:
    """Each part's grams with their counts over all parts, and which of them it speaks for."""
    kinds, place, starts = asked_here([unpacked_sorted(a) for a in g["a"]])
    sums = total_of(place, joined(g["b"], "<i8"), len(kinds))
    speaks = np.zeros(len(place), bool)
    last = np.empty(len(kinds), np.int64)
    last[place] = np.arange(len(place))
    speaks[last] = True
    return answered(g, 0, [packed(x) for x in np.split(sums[place], starts[1:-1])], [flags(x) for x in np.split(speaks, starts[1:-1])])


def judge(g: pd.DataFrame, gain: float) -> pd.DataFrame:
    """Each part's contexts with the number of the weight they are kept with, from 1, or 0; n: kept contexts."""
    kinds, place, starts = asked_here([unpacked_sorted(a) for a in g["a"]])
    verdict = np.zeros(len(kinds), np.int8)
    np.maximum.at(verdict, place, joined(g["b"], "<i1"))
    at = place[np.concatenate([lo + unpacked(c, "<i4") for lo, c in zip(starts, g["c"], strict=False)])]
    counts = np.concatenate([unpacked(d, "<i8").reshape(2, -1) for d in g["d"]], axis=1)
    terms = np.concatenate([unpacked(e, "<i8").reshape(len(WEIGHTS), -1) for e in g["e"]], axis=1)
    open_, at = np.unique(at, return_inverse=True)
    size = np.zeros(len(open_), np.int64)
    size[at] = counts[0]
    verdict[open_] = verdict_of(size, *summed(at, counts[1], terms.T, len(open_)), gain)
    return answered(g, int((verdict > 0).sum() + g["n"].sum()), [packed(x) for x in np.split(verdict[place], starts[1:-1])])


def score_documents(docs: DataFrame, depth: int = DEPTH, share: float = 0.0, gain: float = GAIN, part: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_states: kept contexts.

    share: a caller may ask for contexts that make this share of the training symbols only; none is left out otherwise.
    """
    spark, part = docs.sparkSession, part or PART
    folder = Folder(scratch_path(spark, "lm-files"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        kept("lm", dict)  # drops what other operators left
        for k, (ids, sizes, coded, numbers) in enumerate(parts(batches, part)):
            names = list(numbers)
            order = np.argsort(-np.bincount(coded, minlength=len(names)), kind="stable")
            to = np.empty(len(order), np.int32)
            to[order] = np.arange(len(order), dtype=np.int32)
            hashes = np.fromiter((xxhash.xxh64_intdigest(names[i]) for i in order), np.uint64, len(names))
            n = int(sizes[[not is_held_out(i) for i in ids]].sum())
            null = np.array([i is None for i in ids])
            state = folder.put(
                packed(to[coded]), packed(sizes.astype(np.int32)), packed(hashes), packed(np.array([i or 0 for i in ids], np.int64)), packed(null)
            )
            yield pa.RecordBatch.from_pydict({"part": [f"{task}-{k}"], "state": [state], "n": pa.array([n], pa.int64())})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, "part string, state string, n long")
    coded = materialize(found, "lm-parts")
    sums = coded.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, tasks = int(sums[0] or 0), min(max(1, sums[1]), TASKS)
    buckets, least = max(12, -(-total // BUCKET)), max(2, share * total)
    bits, width = min(48, max(32, total.bit_length() + 5)), min(64, max(48, total.bit_length() + 20))

    def opened(g: pd.DataFrame) -> tuple[pd.DataFrame, Part]:
        """The answers by bucket, and the part. If a task ran twice, the files of either attempt say the same."""
        g = g.sort_values("bucket")
        return g, Part(folder, g["state"].min(), depth, least, width)

    def send_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, state in zip(b["part"], b["state"], strict=True):
                yield send_words(name, Part(folder, state, depth, least, width), buckets, bits)

    def send_second(g: pd.DataFrame) -> pd.DataFrame:
        g, me = opened(g)
        me.learn_words(g)
        return send_counts(g["part"].iloc[0], me, buckets)

    def send_third(g: pd.DataFrame) -> pd.DataFrame:
        g, me = opened(g)
        me.learn_grams(g)
        return send_gains(g["part"].iloc[0], me, total, gain, buckets)

    def by_part(answers: DataFrame, run, shape: str) -> DataFrame:
        return answers.repartition(tasks, "part").groupBy("part").applyInPandas(run, shape)

    def by_bucket(rows: DataFrame, run, path: str) -> DataFrame:
        """The answers as a table; a round's shuffle files go when it is done."""
        before = spark.conf.get(CLEAN, "false")
        spark.conf.set(CLEAN, "true")
        try:
            rows.groupBy("bucket").applyInPandas(run, ANSWER).write.parquet(path)
        finally:
            spark.conf.set(CLEAN, before)
        return spark.read.schema(ANSWER).parquet(path)

    paths = [scratch_path(spark, label) for label in ("lm-words", "lm-grams", "lm-verdicts")]
    words = by_bucket(coded.select("part", "state").repartition(tasks).mapInPandas(send_first, SENT), add_words, paths[0])
    known = int(words.agg(F.sum("n")).first()[0] or 0)
    grams = by_bucket(by_part(words, send_second, SENT), add_up, paths[1])
    discard(spark, paths[0])  # the parts' files hold what it told
    verdicts = by_bucket(by_part(grams, send_third, SENT), lambda g: judge(g, gain), paths[2])
    discard(spark, paths[1])

    states = int(verdicts.agg(F.sum("n")).first()[0] or 0)

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        g, me = opened(g)
        base, p = me.scores(g, total, known)
        return pd.DataFrame({
            "doc_id": pd.array(me.ids, dtype="Int64"), "held_out": [is_held_out(i) for i in me.ids], "n_tokens": me.sizes,
            "n_known": np.add.reduceat((me.n[1] > 0).astype(np.int64), me.starts), "train_tokens": total,
            "base_score": np.add.reduceat(np.log10(base), me.starts), "score": np.add.reduceat(np.log10(p), me.starts), "n_states": states})

    return by_part(
        verdicts, finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_states long"
    )


def op3_lm_score(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
