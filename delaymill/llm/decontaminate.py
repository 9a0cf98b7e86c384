"""Operator 5: benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import WORD, rolling, shielded, texts
from delaymill.session import spool

SEED = 5  # words of a seed, and of the shortest tile
COVERAGE = 0.5  # share of a test's words under tiles from which a document counts as contaminated
BLOCK_BYTES = 8_000_000  # benchmark text that one pass over the documents holds


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tiles(pattern: list[int], text: list[int], least: int = SEED, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in pattern, place in text, length) of every tile.

    Words below zero match nothing. For falling search lengths all runs of unmarked words are matched
    by their hash and extended as far as they go; the longest that still are free become tiles first. When a
    match is over twice the search length, the search starts again from its length, so that long tiles come before short ones.
    """
    used_p, used_t = [False] * len(pattern), [False] * len(text)
    found: list[tuple[int, int, int]] = []
    length = max(least, start)
    while True:
        matches = _matches(pattern, text, used_p, used_t, length)
        longest = max(matches, default=0)
        if longest > 2 * length:
            length = longest
            continue
        for size in sorted(matches, reverse=True):
            for p, t in matches[size]:
                if not (any(used_p[p : p + size]) or any(used_t[t : t + size])):
                    used_p[p : p + size] = used_t[t : t + size] = [True] * size
                    found.append((p, t, size))
        if _matches(pattern, text, used_p, used_t, length):
            continue  # a tile took part of another match; what is left of that is searched for again
        if length == least:
            return found
        length = max(least, length // 2)


def _matches(pattern, text, used_p, used_t, length) -> dict[int, list[tuple[int, int]]]:
    """Maximal matches of at least ``length`` free words, by size."""
    index = defaultdict(list)
    for at in _free_runs(pattern, used_p, length):
        index[hash(tuple(pattern[at : at + length]))].append(at)
    out = defaultdict(list)
    ends: dict[int, int] = {}  # of each diagonal, where the last match ended
    for t in _free_runs(text, used_t, length):
        for p in index.get(hash(tuple(text[t : t + length])), ()):
            if ends.get(p - t, -1) >= t + length or pattern[p : p + length] != text[t : t + length]:
                continue
            size = length
            while (
                p + size < len(pattern)
                and t + size < len(text)
                and pattern[p + size] == text[t + size] >= 0
                and not used_p[p + size]
                and not used_t[t + size]
            ):
                size += 1
            ends[p - t] = t + size
            out[size].append((p, t))
    return out


def _free_runs(values, used, length):
    """Places from which ``length`` words are free and known."""
    run = 0
    for i, (v, u) in enumerate(zip(values, used, strict=True)):
        run = 0 if u or v < 0 else run + 1
        if run >= length:
            yield i - length + 1


class Seeds:
    """The tests of a block: word numbers, word lists, and which tests hold each seed."""

    def __init__(self, tests: list[tuple[object, str]], seed: int) -> None:
        self.seed = seed
        self.numbers: dict[str, int] = {}
        self.tests: list[tuple[object, list[int]]] = []
        hashes, owners = [], []
        for item, text in tests:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]
            if not ids:
                continue
            length = min(seed, len(ids))  # a test shorter than a seed is one seed of its own length
            for h in np.unique(rolling(np.array(ids, np.uint64), length)).tolist():
                hashes.append(h)
                owners.append(len(self.tests))
            self.tests.append((item, ids))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.owners = np.array(owners, np.int64)[order]
        self.lengths = sorted({min(seed, len(ids)) for _, ids in self.tests})

    def candidates(self, ids: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Tests that share a seed with a document, and the document's words that any seed covers."""
        covered = np.zeros(len(ids) + 1, np.int64)
        found: set[int] = set()
        for length in self.lengths:
            runs = rolling(ids.astype(np.uint64), length)
            left, right = np.searchsorted(self.hashes, runs, "left"), np.searchsorted(self.hashes, runs, "right")
            hit = np.flatnonzero(left < right)
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + length, -1)
            for a, b in set(zip(left[hit].tolist(), right[hit].tolist(), strict=True)):
                found.update(self.owners[a:b].tolist())
        return sorted(found), np.cumsum(covered[:-1]) > 0


def overlaps(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, covered, test_words, coverage, tiles for every document and test that share a seed of ``seed`` words.

    The benchmark's distinct rows are cut into blocks of about ``block_bytes`` of text by their hash, and each block is
    compared with all documents in one pass: every task holds the block's seeds, joins the seeds of each
    whole text to them, and tiles the documents that share any. Nothing is shuffled, so hot passages cost no
    more than their documents. Words are lower-cased runs of letters, digits and underscores. Null texts and ids,
    repeated rows: a null text shares nothing, repeated tests are compared once and give a row per copy, documents
    are compared each for itself, null ids are passed on.
    """
    found = _distinct_overlaps(docs, benchmark, seed, block_bytes)
    return found.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def _distinct_overlaps(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The overlaps with every distinct test once, and ``_copies``, the rows that the benchmark has of it."""
    rows = benchmark.filter("text IS NOT NULL").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("_copies"))
    benchmark = spool(rows, "tests")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [_pass(docs, benchmark.filter(place == b) if blocks > 1 else benchmark, seed) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pass(docs: DataFrame, block: DataFrame, seed: int) -> DataFrame:
    tests = block.select("item_id", "text", "_copies").toArrow()
    item_arrow = tests.schema.field("item_id").type
    names = zip(tests.column("item_id").to_pylist(), tests.column("_copies").to_pylist(), strict=True)
    pairs = list(zip(names, tests.column("text").to_pylist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(pairs, seed))
    doc_kind, item_kind = (t.dataType.simpleString() for t in (docs.schema["doc_id"], block.schema["item_id"]))

    def compare(batches):
        seeds = shared.value
        number = seeds.numbers.get
        for batch in batches:
            rows = []
            for at, text in enumerate(texts(batch.column(1))):
                ids = np.array([number(w, -1) for w in words(text)], np.int64)
                if not len(ids) or not len(seeds.hashes):
                    continue
                found, near = seeds.candidates(ids)
                if not found:
                    continue
                near_ids = _regions(ids, near)
                for test in found:
                    (item, copies), pattern = seeds.tests[test]
                    marked = tiles(pattern, near_ids, min(seed, len(pattern)))
                    covered = sum(n for _, _, n in marked)
                    rows.append((at, item, covered, len(pattern), len(marked), copies))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [
                batch.column(0).take(at),
                pa.array([r[1] for r in rows], item_arrow),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[2] / r[3] for r in rows], pa.float64()),
                pa.array([r[4] for r in rows], pa.int64()),
                pa.array([r[5] for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "covered", "test_words", "coverage", "tiles", "_copies"])

    return docs.select("doc_id", "text").mapInArrow(
        compare,
        f"doc_id {doc_kind}, item_id {item_kind}, covered long, test_words long, coverage double, tiles long, _copies long",
    )


def _regions(ids: np.ndarray, near: np.ndarray) -> list[int]:
    """The words under seeds, a gap between regions; tiles are made of seeds, so nothing else can be in one."""
    out: list[int] = []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], near.astype(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.extend(ids[a:b].tolist())
        out.append(-1)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The overlaps whose tiles cover at least ``coverage`` of the test."""
    return overlaps(docs, benchmark).filter(F.col("coverage") >= coverage)


@shielded("_bad")
def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` whose text covers less than ``coverage`` of every test; all columns, null ids and repeated rows too.

    Rows are told apart by their text: equal texts share their fate.
    """
    keyed = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("doc_id"), "text")
    found = _distinct_overlaps(keyed, benchmark).filter(F.col("coverage") >= coverage)
    bad = spool(found.select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, F.sha2(F.col("text").cast("binary"), 256) == F.col("_bad"), "left_anti")
