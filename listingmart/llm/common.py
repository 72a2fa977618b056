"""Helpers shared by the operators: shared tables and files, word rules, folds, keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch_path, scratch_root

__all__ = [
    "LOWER", "SPACE", "UPPER", "WORD", "discard", "fold", "fresh", "kept", "materialize", "n_words", "row_key", "scratch_path", "scratch_root",
    "shared_files", "slices", "table", "tidy"
]

#: A word is a run of anything but these six ASCII space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """What a Python worker remembers from task to task. It holds one operator's memory at a time: another owner's goes."""
    if owner not in _kept:
        _kept.clear()
        tidy()
        _kept[owner] = make()
    return _kept[owner]


def tidy() -> None:
    """Give memory that nothing uses back to the system, which the worker's allocators would keep for themselves."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """The batches in smaller steps, so that few texts are held as Python's."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """The names, each with as many underscores before it as it needs not to clash with a taken one; case does not tell apart."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """A 128-bit key of a row's values as a text; equal rows share it."""
    half = lambda seed: F.xxhash64(F.lit(seed), *(df[c] for c in columns), *(df[c].isNull() for c in columns))
    return F.concat_ws(":", F.hex(half(1)), F.hex(half(2)))


def shared_files(uri: str):
    """pyarrow's file system of a shared folder's URI, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
