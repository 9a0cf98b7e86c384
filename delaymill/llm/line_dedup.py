"""Operator 4: lines repeated across documents, suspected by two Bloom filters and confirmed exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import portions, shielded, texts
from delaymill.session import spool

MIN_CHARS = 40
MIN_DOCUMENTS = 5
BLANKS = " \t\n\v\f\r"
LINES_PER_DOCUMENT = 16  # for sizing the filters; a wrong guess costs only suspicion
BITS_PER_LINE = 8
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28  # at the most a filter is 32 MB; more lines mean more suspects, not other results
CHUNK = 1 << 18  # bytes of a filter in one row
HASHES = 3


def line_keys(batch: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the key of every line of some texts: blanks stripped, A-Z in lower case."""
    lists = pc.split_pattern(pc.fill_null(batch, ""), "\n")
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=BLANKS))
    return pc.list_parent_indices(lists).to_numpy(), keys


def long_keys(batch: pa.Array, min_chars: int) -> tuple[np.ndarray, list[str]]:
    parents, keys = line_keys(batch)
    long = pc.greater_equal(pc.utf8_length(keys), min_chars)
    return parents[long.to_numpy(zero_copy_only=False)], keys.filter(long).to_pylist()


def slots(keys: list[str], bits: int) -> np.ndarray:
    """The filter positions of each key, one row of ``HASHES`` per key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    at = low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]
    return (at & np.uint64(bits - 1)).astype(np.int64)


def _holds(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all positions of each row are set."""
    return ((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(field: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(field, at.ravel() >> 3, np.left_shift(np.uint8(1), (at.ravel() & 7).astype(np.uint8)))


def _merge(once: np.ndarray, twice: np.ndarray, more_once: np.ndarray, more_twice: np.ndarray) -> None:
    """A key that both sides have seen once has all its bits in both, hence in the intersection."""
    twice |= more_twice | (once & more_once)
    once |= more_once


def _parallelism(df: DataFrame) -> int:
    return max(2, 2 * df.sparkSession.sparkContext.defaultParallelism)


def repeat_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The twice-seen filter over the long line keys of all documents, a key counted once per document.

    Tasks fill both filters; the filters are merged chunk by chunk, each chunk position by its own task, which
    holds two chunks at a time however many filters there are.
    """
    size = bits // 8
    step = min(CHUNK, size)

    def fill(batches):
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in portions(batches):
            parents, keys = long_keys(batch.column(0), min_chars)
            pairs = list(dict.fromkeys(zip(parents.tolist(), keys, strict=True)))
            at = slots([k for _, k in pairs], bits)
            for start in range(0, len(pairs), 256):
                part = at[start : start + 256]
                unique, back, count = np.unique(part, axis=0, return_inverse=True, return_counts=True)
                _set(twice, unique[_holds(once, unique) | (count > 1)])
                _set(once, unique)
        for start in range(0, size, step):
            a, b = once[start : start + step].tobytes(), twice[start : start + step].tobytes()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([start // step], pa.int32()), "once": [a], "twice": [b]})

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if chunk not in held:
                    held[chunk] = a.copy(), b.copy()
                else:
                    _merge(*held[chunk], a, b)
        for chunk, (a, b) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk], pa.int32()), "once": [a.tobytes()], "twice": [b.tobytes()]}
            )

    schema = "chunk int, once binary, twice binary"
    filled = docs.select("text").coalesce(_parallelism(docs)).mapInArrow(fill, schema)
    merged = filled.repartition(max(1, size // step), "chunk").mapInArrow(merge, schema)
    field = np.zeros(size, np.uint8)
    for row in merged.select("chunk", "twice").toLocalIterator():
        field[row.chunk * step : row.chunk * step + step] = np.frombuffer(row.twice, np.uint8)
    return field


def repeated_keys(docs: DataFrame, min_chars: int, min_documents: int, bits: int) -> DataFrame:
    """doc_id and the keys that its document loses (``drops``), for documents that lose any.

    Only lines that the filter suspects are shuffled. Documents are counted exactly in two steps (per key
    and document, then per key), so a line of a third of all documents is spread before it is counted.
    """
    field = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, min_chars, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def suspect(batches):
        seen = field.value
        for batch in portions(batches):
            parents, keys = long_keys(batch.column(1), min_chars)
            pairs = list(dict.fromkeys(zip(parents.tolist(), keys, strict=True)))
            if not pairs:
                continue
            hit = np.flatnonzero(_holds(seen, slots([k for _, k in pairs], bits)))
            ids = batch.column(0).take(pa.array([pairs[i][0] for i in hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([pairs[i][1] for i in hit], pa.string())], ["doc_id", "key"])

    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    suspects = spool(known.mapInArrow(suspect, f"doc_id {kind}, key string"), "suspects")
    confirmed = (
        suspects.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("documents"), F.max("doc_id").alias("keeper"))
        .filter(F.col("documents") >= min_documents)
        .select("key", "keeper")
    )
    confirmed = spool(confirmed, "repeated")
    lost = suspects.join(confirmed, "key").filter(F.col("doc_id") != F.col("keeper"))
    return spool(lost.groupBy("doc_id").agg(F.collect_set("key").alias("drops")), "drops")


def filter_bits(documents: int) -> int:
    wanted = max(1, documents) * LINES_PER_DOCUMENT * BITS_PER_LINE
    return min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))


@shielded("_drop_id", "_drops", "_kept", "_n_lines", "_n_dropped")
def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, bits: int | None = None
) -> DataFrame:
    """All columns of ``docs`` with ``_kept`` (the text without its repeated lines), ``_n_lines`` and ``_n_dropped``.

    A line's key is the line without blanks at its ends and with A-Z in lower case. A key of at least
    ``min_chars`` code points that at least ``min_documents`` different doc_ids hold loses all its lines but those of
    the largest doc_id. Null texts are one empty line; rows with a null id neither count nor change; rows that
    share an id are one document. Columns of ``docs`` with the name of one of these three are replaced by it.
    """
    bits = bits or filter_bits(docs.count())
    drops = repeated_keys(docs, min_chars, min_documents, bits)
    names = docs.columns
    drops = drops.select(F.col("doc_id").alias("_drop_id"), F.col("drops").alias("_drops"))
    joined = docs.join(drops, F.col("doc_id") == F.col("_drop_id"), "left").drop("_drop_id")
    at = names.index("text")

    def cut(batches):
        for batch in portions(batches):
            kept, lines, dropped = [], [], []
            for text, drop in zip(texts(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                n = text.count("\n") + 1
                if drop:
                    parts, gone = text.split("\n"), set(drop)
                    _, keys = line_keys(pa.array([text], pa.string()))
                    text = "\n".join(p for p, k in zip(parts, keys.to_pylist(), strict=True) if k not in gone)
                    dropped.append(sum(k in gone for k in keys.to_pylist()))
                else:
                    dropped.append(0)
                kept.append(text)
                lines.append(n)
            added = [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], [*names, "_kept", "_n_lines", "_n_dropped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*[f"`{c}`" for c in names], "_drops").mapInArrow(
        cut, f"{fields}, `_kept` string, `_n_lines` long, `_n_dropped` long"
    )



@shielded("_kept", "_n_lines", "_n_dropped")
def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their own columns alone: ``text`` without its repeated lines, ``n_chars`` after it.

    Texts that lose no line stay as they are, null ones too.
    """
    cut = drop_repeated_lines(docs)
    changed = F.col("_n_dropped") > 0
    new = {"text": F.when(changed, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line,
         translate(trim(list_extract(parts, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, r.keeper IS NOT NULL AND l.doc_id <> r.keeper AS dropped
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
