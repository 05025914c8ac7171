"""Helpers shared by the operators: reading tables, written intermediate
tables, size-checked broadcasts, label splits and word hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salespanel.session import shared_dir

#: Code points that separate words in the plain-word contracts (ASCII space and \t..\r).
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The most bytes (rows times row width) that a join side may have to be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Only the named columns, in their types; other columns of the input
    (whatever their names) never meet an operator's own columns."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def shielded(*used: str):
    """For an operator on a table that returns the table's columns and some of
    its own: inside it, all columns but those ``used`` go by numbers, so that no
    name of the input meets one of the operator's. Afterwards they have their
    names again; a column named as a result (in any case) gives way to it."""
    def around(op):
        @functools.wraps(op)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            names = df.columns
            inner = [c if c in used else f"__column_{i}" for i, c in enumerate(names)]
            out = op(df.toDF(*inner), *args, **kwargs)
            added = [c for c in out.columns if c not in inner]
            taken = {c.lower() for c in added}
            return out.select(*[F.col(i).alias(c) for i, c in zip(inner, names, strict=True) if c.lower() not in taken], *added)
        return run
    return around


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, reread: lineage ends here and a
    lost executor costs no more than the tasks that read it."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows fit the
    limit; beyond it the join stays a shuffled one."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once per row however often
    ``use`` refers to it, inside inner functions too (the optimizer would else
    put the expression in every place of use)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has the remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def give_back() -> None:
    """Hands freed memory of this process back to the machine, where its C
    library can: a Python worker lives on after its task, beside the executor."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim(0)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; ``lower`` maps A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` consecutive items; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mix(out)


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words the whole sequence is one."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words, len(words)), min(size, len(words))))
