"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
HELD_OUT = 2  # the remainder of crc32(doc_id) mod 4 that no model learns from
CACHE_WORDS = 200_000  # entries of a task's word hash cache before it starts anew


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that models must not learn from; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values of ``columns`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(2**53))


def shielded(*own: str) -> Callable:
    """Lets an operator use the column names ``own`` although its input has columns of such names.

    These are renamed while the operator works. Afterwards they have their names again, except where the
    operator's result has a column of that name: then its own column takes their place.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            taken = {c.lower() for c in (*docs.columns, *own)}
            aside = {}
            for c in docs.columns:
                if c.lower() in {o.lower() for o in own}:
                    name = f"{c}_input"
                    while name.lower() in taken:
                        name += "_"
                    aside[c] = name
                    taken.add(name.lower())
            out = operator(docs.withColumnsRenamed(aside), *args, **options)
            made = {c.lower() for c in out.columns}
            out = out.drop(*[n for c, n in aside.items() if c.lower() in made])
            return out.withColumnsRenamed({n: c for c, n in aside.items() if c.lower() not in made})

        return run

    return wrap


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as an empty text."""
    return [t or "" for t in column.to_pylist()]


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Short pieces of the batches, so that a task holds the Python objects of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def narrowed(df: DataFrame) -> DataFrame:
    """``df`` in at most two partitions a core, so that steps over small aggregates do not cost the driver a task for each shuffle partition."""
    return df.coalesce(max(2, 2 * df.sparkSession.sparkContext.defaultParallelism))


class WordHashes:
    """64-bit hashes of words, kept for the words a task has met lately."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += values[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches that arrive sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != current:
                    yield pa.Table.from_batches(held)
                    held = []
                current = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)
