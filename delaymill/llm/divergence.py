"""Operator 13: divergence between the sources of each language, from count-level bitmaps."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaymill.operators.ranking import rank_rows
from delaymill.session import spool

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # of UTF-8: runs of ASCII letters and of everything beyond ASCII
MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
HELD_TERMS = 300_000  # counters of a task before it hands them on
CHUNK = 8192  # term ids of a bitmap; a multiple of 64, at most 2 ** 16
BLOCK = 48  # sources compared with as many others in one task


def term_counts(docs: DataFrame, held_terms: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n (occurrences) and documents (rows that hold it), stored.

    Tasks count whole texts first, so a word of every document costs one row per task and source.
    """

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = TERM.findall(text.lower())  # of bytes: A-Z alone
                if found:
                    occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
                    occurrences.update(found)
                    documents.update(set(found))
            if sum(len(n) for n, _ in held.values()) > held_terms:
                yield from _rows(held)
                held.clear()
        yield from _rows(held)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, documents long")
    return spool(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "terms")


def _rows(held):
    for (lang, source), (occurrences, documents) in held.items():
        terms = list(occurrences)
        columns = {
            "lang": pa.array([lang] * len(terms), pa.string()),
            "source": pa.array([source] * len(terms), pa.string()),
            "term": pa.array([t.decode() for t in terms], pa.string()),
            "n": pa.array(list(occurrences.values()), pa.int64()),
            "documents": pa.array([documents[t] for t in terms], pa.int64()),
        }
        yield pa.RecordBatch.from_pydict(columns)


def level_bitmaps(entries: DataFrame, size: int = CHUNK) -> DataFrame:
    """lang, source, chunk, n and ``ids``: which term ids of the chunk occur n times in the source, stored.

    ``ids`` is a bitset of ``size`` bits, or where that is shorter the sorted 16-bit offsets; the length tells which.
    """

    def pack(batches):
        for batch in batches:
            ids = [packed(np.sort(np.array(o, np.uint16)), size) for o in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["lang", "source", "chunk", "n", "ids"])

    chunk, offset = F.expr(f"term_id div {size}").alias("chunk"), F.expr(f"CAST(term_id % {size} AS INT)").alias("offset")
    levels = entries.select("lang", "source", chunk, "n", offset).groupBy("lang", "source", "chunk", "n").agg(F.collect_list("offset").alias("offsets"))
    return spool(levels.mapInArrow(pack, "lang string, source string, chunk long, n long, ids binary"), "levels")


def packed(offsets: np.ndarray, size: int = CHUNK) -> bytes:
    if 2 * len(offsets) < size // 8:
        return offsets.tobytes()
    bits = np.zeros(size, np.uint8)
    bits[offsets] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Levels:
    """The levels of one source in one chunk of terms: its counts, ascending, and the terms of each."""

    def __init__(self, total: int, terms: int, levels: list[tuple[int, bytes]], size: int = CHUNK) -> None:
        levels = sorted(levels)
        self.rates = np.array([rate(n, total, terms) for n, _ in levels], np.int64)
        self.absent = rate(0, total, terms)
        dense = [i for i, (_, ids) in enumerate(levels) if len(ids) == size // 8]
        self.dense = np.array(dense, np.int64)
        self.bits = np.array([np.frombuffer(levels[i][1], np.uint64) for i in dense], np.uint64).reshape(len(dense), size // 64)
        sparse = [(i, np.frombuffer(ids, np.uint16)) for i, (_, ids) in enumerate(levels) if len(ids) != size // 8]
        found = np.concatenate([ids for _, ids in sparse]) if sparse else np.empty(0, np.uint16)
        owner = np.repeat(np.array([i for i, _ in sparse], np.int64), [len(ids) for _, ids in sparse])
        order = np.argsort(found, kind="stable")
        self.found, self.owner = found[order].astype(np.int64), owner[order]
        self.sizes = np.bincount(self.owner, minlength=len(levels))
        self.sizes[self.dense] = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)


def rate(n: int, total: int, terms: int) -> int:
    """The smoothed share of a term that occurs ``n`` times, in whole parts of ``SCALE``."""
    return 1 + SCALE * (n + 1) // (total + terms)


def joint_cells(a: Levels, b: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level of ``a``, level of ``b`` and the number of terms on both, of all cells that hold a term of both.

    Bitsets are intersected by AND and counted by popcount; offsets are looked up in bitsets, or met with offsets.
    """
    both = np.bitwise_count(a.bits[:, None, :] & b.bits[None, :, :]).sum(axis=2, dtype=np.int64)
    i, j = np.nonzero(both)
    found = [(a.dense[i], b.dense[j], both[i, j])]
    for x, y, swap in ((a, b, False), (b, a, True)):
        held = (y.bits[:, x.found >> 6] >> (x.found & 63).astype(np.uint64)) & np.uint64(1)
        level, at = np.nonzero(held)
        pair = x.owner[at], y.dense[level]
        found.append((*(pair[::-1] if swap else pair), np.ones(len(at), np.int64)))
    _, at, to = np.intersect1d(a.found, b.found, assume_unique=True, return_indices=True)
    found.append((a.owner[at], b.owner[to], np.ones(len(at), np.int64)))
    left, right, n = (np.concatenate(c) for c in zip(*found, strict=True))
    width = max(1, len(b.sizes))
    cells, back = np.unique(left * width + right, return_inverse=True)
    return cells // width, cells % width, np.bincount(back, weights=n, minlength=len(cells)).astype(np.int64)


def divergence(p, q):
    return (p - q) * (p - q) // q


def pair_value(a: Levels, b: Levels, cells, terms: int) -> int:
    """The sum over ``terms`` terms of the divergence of ``a`` from ``b``; terms absent on a side by complement."""
    i, j, n = cells
    total = int((n * divergence(a.rates[i], b.rates[j])).sum())
    only_a = a.sizes - np.bincount(i, weights=n, minlength=len(a.sizes)).astype(np.int64)
    only_b = b.sizes - np.bincount(j, weights=n, minlength=len(b.sizes)).astype(np.int64)
    total += int((only_a * divergence(a.rates, b.absent)).sum()) + int((only_b * divergence(a.absent, b.rates)).sum())
    neither = terms - int(a.sizes.sum()) - int(only_b.sum())
    return total + neither * divergence(a.absent, b.absent)


def _compare(table: pa.Table, size: int) -> pa.Table:
    """All pairs of one unit: the sources of two blocks over one chunk of terms of a language."""
    names = table.column_names
    columns = dict(zip(names, (c.to_pylist() for c in table.columns), strict=True))
    levels, facts = defaultdict(list), {}
    for r in zip(*(columns[n] for n in names), strict=True):
        row = dict(zip(names, r, strict=True))
        if row["n"] == 0:
            facts[row["source"]] = row["block"], row["total"], row["terms"]
        else:
            levels[row["source"]].append((row["n"], row["ids"]))
    lang, chunk, left, right = (columns[n][0] for n in ("lang", "chunk", "a", "b"))
    sources = {s: Levels(total, terms, levels[s], size) for s, (_, total, terms) in facts.items()}
    present = min(size, next(iter(facts.values()))[2] - chunk * size)
    rows = []
    for s, x in sources.items():
        for t, y in sources.items():
            if facts[s][0] == left and facts[t][0] == right and (left != right or s < t):
                cells = joint_cells(x, y)
                rows.append((lang, s, t, pair_value(x, y, cells, present)))
                rows.append((lang, t, s, pair_value(y, x, (cells[1], cells[0], cells[2]), present)))
    names = ["lang", "source", "item", "value"]
    values = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in zip(names, values, strict=True)})


def pair_values(levels: DataFrame, groups: DataFrame, size: int = CHUNK) -> DataFrame:
    """lang, source, item (each other source) and value, from stored bitmaps.

    A unit is a chunk of terms and two blocks of sources, so tasks stay small however large the vocabulary or the number of sources.
    Every source is in every chunk, by a level 0 that carries its totals.
    """
    header = groups.filter("terms > 0").select(
        "lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(terms - 1) div {size}"))).alias("chunk"), F.lit(0).cast("long").alias("n")
    )
    rows = levels.unionByName(header, allowMissingColumns=True).join(groups, ["lang", "source"])
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select(
        "lang", "source", "chunk", "n", "ids", "block", "total", "terms", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )
    parts = dealt.groupBy("lang", "chunk", "a", "b").applyInArrow(
        lambda table: _compare(table, size), "lang string, source string, item string, value long"
    )
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item")  # every pair is a row of the result
    return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def term_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of the terms that a source has more often than its language."""

    def share(n: str, total: str):
        return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(20, 0)) * CAST({n} + 1 AS DECIMAL(18, 0))) div CAST({total} + terms AS DECIMAL(20, 0)) AS BIGINT)")

    rows = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(
    docs: DataFrame, top_terms: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK, held_terms: int = HELD_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie apart, and by which terms from the language.

    Part ``pair`` has every other source of the language, part ``term`` the first ``top_terms`` terms of each source. Null texts,
    languages and sources are ''; every row counts as a document, repeated ones too; other columns are not looked at.
    A source without terms is compared as one with none of the kept terms; in a language without kept terms all values
    are 0; an empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(docs, held_terms)
    kept = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n")).filter(F.col("documents") >= MIN_DOCUMENTS)
    numbered = rank_rows(kept.select("lang", "term", "lang_n"), ["lang"], [F.col("term").asc()], "number")
    vocabulary = spool(numbered.select("lang", "term", "lang_n", (F.col("number") - 1).alias("term_id")), "vocabulary")
    entries = spool(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "term_id"), "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    placed = rank_rows(found, ["lang"], [F.col("source").asc()], "place")
    blocks = placed.groupBy("lang").agg(F.expr(f"(max(place) - 1) div {block} + 1").alias("blocks"))
    groups = spool(placed.withColumn("block", F.expr(f"(place - 1) div {block}")).drop("place").join(blocks, "lang"), "groups")
    pairs = pair_values(level_bitmaps(entries, chunk), groups, chunk).withColumn("part", F.lit("pair"))
    terms = term_values(entries, groups).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    )
    return ranked.select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), tokens AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL
), kept AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 3
), langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), totals AS (SELECT lang, source, sum(n) AS total FROM counts JOIN kept USING (lang, term) GROUP BY ALL
), sources AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang) LEFT JOIN totals USING (lang, source)
), rates AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (s.total + s.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.lang_n + 1)) // (s.lang_total + s.v) AS q
  FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN found f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM rates WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
