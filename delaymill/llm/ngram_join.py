"""Operator 8: n-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import WORD, WordHashes, groups, narrowed, rolling, shielded, texts
from delaymill.session import spool

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 128
SKETCH_MARGIN = 0.18  # a pair is verified if its sketch similarity is at most this far below the threshold (5 deviations)
BLOCK = 400  # texts of one side of a comparison; larger groups are cut into pairs of blocks
FILTER_BITS = 1 << 26  # 8 MB
SLICE = 512  # n-grams hashed at a time
CHUNK = 1 << 14  # columns of a presence matrix multiplied at a time


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most selective ones that find a pair at the threshold with probability ``recall``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = bands, rows
    return best


def shingles(text: str, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` lower-cased words, sorted; a shorter text is one run."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes(words), min(n, len(words))))


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


class MinHashes:
    """Minima of multiplicative 32-bit hashes of the n-grams, worked out in slices that stay in the cache."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.factors = (rng.integers(1, 2**31, (bands * rows, 1)) * 2 + 1).astype(np.uint32)
        self.room = np.empty((2, bands * rows, SLICE), np.uint32)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint32).max, np.uint32)
        short = (found >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(short), SLICE):
            part = short[start : start + SLICE]
            mixed, moved = self.room[0, :, : len(part)], self.room[1, :, : len(part)]
            np.multiply(part[None, :], self.factors, out=mixed)
            np.right_shift(mixed, np.uint32(15), out=moved)
            np.bitwise_xor(mixed, moved, out=mixed)
            np.multiply(mixed, np.uint32(0x2C1B3C6D), out=mixed)
            np.minimum(least, mixed.min(axis=1), out=least)
        return least

    def band_hashes(self, least: np.ndarray) -> np.ndarray:
        table = least.astype(np.uint64).reshape(self.bands, self.rows)
        out = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            out = (out ^ table[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, text_hash, key of the n-gram set (null without words), band hashes and one byte of every MinHash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        hashes, minima = WordHashes(), MinHashes(bands, rows)
        for batch in batches:
            keys, band_rows, sketches = [], [], []
            for text in texts(batch.column(2)):
                found = shingles(text, hashes, n)
                if len(found):
                    least = minima(found)
                    keys.append(set_key(found))
                    band_rows.append(minima.band_hashes(least))
                    sketches.append((least >> np.uint32(8)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    band_rows.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(keys, pa.binary()),
                    pa.array(band_rows, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "text_hash", "key", "bands", "sketch"],
            )

    picked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = f"doc_id {kind}, text_hash long, key binary, bands array<long>, sketch binary"
    return spool(picked.mapInArrow(sign, schema), "signatures")


def _in_units(members: DataFrame, group: list[str], size: str, block: int) -> DataFrame:
    """Members dealt to units of comparison, sorted: a group, or each pair of blocks of a large group.

    ``unit`` names the unit, ``side`` is 0 or 1, and ``same`` says whether the unit compares a block with itself.
    """
    count = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    dealt = members.withColumn("_blocks", count).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    dealt = dealt.withColumn("unit", F.concat_ws(":", *[F.hex(c) for c in group], low, high))
    dealt = dealt.withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    dealt = dealt.withColumn("same", F.col("_own") == F.col("_other")).drop("_blocks", "_own", "_other", *group, size)
    return dealt.repartition("unit").sortWithinPartitions("unit")


def _linked(near: np.ndarray) -> np.ndarray:
    """The smallest index of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _allowed(side: list[int], same: bool) -> np.ndarray:
    sides = np.array(side)
    pairs = np.ones((len(sides), len(sides)), bool) if same else sides[:, None] != sides[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def candidate_edges(classes: DataFrame, similarity: float) -> DataFrame:
    """Spanning edges (a, b) of sets that share a band and look alike by their sketches.

    Band hashes are shuffled with the keys alone; buckets with the same members are compared once, and no pair
    of a bucket is written, only the edges that connect it.
    """
    entries = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = entries.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("mix"), F.min("key").alias("first")
    )
    buckets = buckets.filter("size > 1").groupBy("size", "mix", "first").agg(F.min(F.struct("band", "hash")).alias("at"))
    chosen = spool(buckets.select("at.band", "at.hash", "size"), "buckets")
    members = spool(entries.join(chosen, ["band", "hash"]), "bucket_members").join(classes.select("key", "sketch"), "key")
    least = similarity - SKETCH_MARGIN

    def compare(batches):
        for unit in groups(batches, "unit"):
            keys = unit.column("key").to_pylist()
            sketches = np.stack([np.frombuffer(s, np.uint8) for s in unit.column("sketch").to_pylist()])
            pairs = _allowed(unit.column("side").to_pylist(), unit.column("same")[0].as_py())
            near = np.zeros(pairs.shape, bool)
            for i in range(len(keys)):
                near[i] = (sketches == sketches[i]).mean(axis=1) >= least
            label = _linked(near & pairs)
            moved = [i for i in range(len(keys)) if label[i] != i]
            if moved:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in moved], pa.binary()), pa.array([keys[label[i]] for i in moved], pa.binary())],
                    ["a", "b"],
                )

    return _in_units(members, ["band", "hash"], "size", 2 * BLOCK).mapInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of an edge list (a, b).

    Alternating large and small stars: each step hangs neighbours on the smallest node in sight, so that the
    edges become stars after a few steps. Steps are stored in the shared folder; joins meet stored sides, so
    that a node with very many neighbours is split.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    def hang(df: DataFrame) -> DataFrame:
        least = spool(narrowed(df.groupBy("a").agg(F.min("b").alias("least"))), "least")
        return df.join(least, "a").select("a", "b", F.least("a", "least").alias("m"))

    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = spool(narrowed(ordered.distinct()), "edges")
    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        both = spool(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        large = hang(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = hang(spool(narrowed(large), "large"))
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = spool(narrowed(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct()), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of presence matrices over slices of the n-grams."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    unique, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # n-grams of one text alone are in no intersection
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = max(64, min(CHUNK, (1 << 22) // len(sets)))
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def member_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """key and n-gram set of the texts that members of candidate groups stand for.

    A Bloom filter over the members' ids keeps the other texts from being cut into n-grams and shuffled. It has
    16 bits an id, at most ``FILTER_BITS``; a fuller one only lets more texts through to the exact join on the key.
    """
    spark = docs.sparkSession
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * max(1, members.count()) - 1).bit_length()))
    h = F.xxhash64("rep")
    places = F.explode(F.array(*[F.shiftright(h, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 18, 36)])).alias("p")
    one = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    filled = members.select(places).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("set")).toPandas()
    field = np.zeros(bits // 64, np.int64)
    field[filled["word"].to_numpy(np.int64)] = filled["set"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(field)

    def cut(batches):
        hashes, field = WordHashes(), shared.value
        for batch in batches:
            h = batch.column(0).to_numpy()
            held = np.ones(len(h), bool)
            for s in (0, 18, 36):
                p = (h >> s) & (bits - 1)
                held &= (field[p >> 6] >> (p & 63)) & 1 == 1
            some = batch.column(1).take(pa.array(np.flatnonzero(held)))
            found = [g for g in (shingles(t, hashes, n) for t in texts(some)) if len(g)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(g) for g in found], pa.binary()), pa.array([g.tobytes() for g in found], pa.binary())],
                ["key", "grams"],
            )

    named = docs.filter(F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id").alias("h"), "text")
    return named.mapInArrow(cut, "key binary, grams binary").join(members.select("key"), "key", "left_semi")


def verify(docs: DataFrame, classes: DataFrame, labels: DataFrame, similarity: float, n: int) -> DataFrame:
    """key, texts, documents, root per unit: links found on full sets, and a spanning edge of them."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = labels.join(sizes, "label").join(classes.select(F.col("key").alias("node"), "rep", "copies"), "node")
    members = spool(members.select(F.col("node").alias("key"), "label", "size", "rep", "copies"), "members")
    sets = member_sets(docs, members, n)

    def compare(batches):
        for unit in groups(batches, "unit"):
            columns = [unit.column(c).to_pylist() for c in ("key", "side", "copies", "grams")]
            found = {k: (np.frombuffer(g, np.uint64), side, c) for k, side, c, g in zip(*columns, strict=True)}
            if len(found) < 2:
                continue
            keys = sorted(found)
            sets = [found[k][0] for k in keys]
            size = np.array([len(s) for s in sets])
            common = intersections(sets)
            linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
            linked &= _allowed([found[k][1] for k in keys], unit.column("same")[0].as_py())
            label = _linked(linked)
            weight = linked @ np.array([found[k][2] for k in keys])
            some = np.flatnonzero(linked.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in some], pa.binary()),
                    pa.array(linked.sum(axis=1)[some], pa.int64()),
                    pa.array(weight[some], pa.int64()),
                    pa.array([keys[label[i]] for i in some], pa.binary()),
                ],
                ["key", "texts", "documents", "root"],
            )

    units = _in_units(members.drop("rep").join(sets, "key"), ["label"], "size", BLOCK)
    return spool(units.mapInArrow(compare, "key binary, texts long, documents long, root binary"), "links")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = WORDS
) -> DataFrame:
    """doc_id, text_hash, class_id, n_links and n_copies of every row of ``docs`` (doc_id, text; others ignored).

    Two documents are linked if the Jaccard similarity of their sets of ``n``-word runs is at least
    ``similarity``. ``n_links`` counts the other rows linked to a row, ``n_copies`` those with the same set;
    ``class_id`` is the smallest doc_id of the connected group. Texts with equal sets are compared once. Bands and rows are chosen so that
    a pair at the threshold is a candidate with probability ``recall``; every candidate group is then compared in
    full, large ones by pairs of blocks, and only counts and spanning edges leave a comparison.
    Texts without words are linked to nothing and form a class of their own; rows with a null id have a null
    class and no links, and count for nobody; rows that repeat an id are counted as rows of one document id.
    """
    bands, rows = choose_bands(similarity, recall)
    signed = signatures(docs, bands, rows, n)
    known = signed.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("key").agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    classes = spool(classes, "classes")
    labels = spool(components(candidate_edges(classes, similarity)), "labels")
    links = verify(docs, classes, labels, similarity, n)
    degrees = links.groupBy("key").agg(F.sum("documents").alias("documents"))
    linked = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    grouped = linked.join(classes.select(F.col("key").alias("node"), "rep"), "node")
    least = grouped.groupBy("label").agg(F.min("rep").alias("least"))
    group = grouped.join(least, "label").select(F.col("node").alias("key"), "least")
    per_class = classes.select("key", "rep", "copies").join(degrees, "key", "left").join(group, "key", "left")
    per_class = spool(
        per_class.select(
            "key",
            F.coalesce("least", "rep").alias("class_id"),
            (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            (F.col("copies") - 1).alias("n_copies"),
        ),
        "per_class",
    )
    named = signed.select("doc_id", "text_hash", "key").filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    found = named.join(per_class, "key").drop("key")
    zero = F.lit(0).cast("long")
    alone = signed.filter(F.col("key").isNull() | F.col("doc_id").isNull())
    return found.unionByName(
        alone.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    )


def same_text(hash_column: Column) -> Column:
    return F.xxhash64("text") == hash_column


@shielded("_loser", "_hash")
def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose document is the first (smallest id) of its group; null ids and wordless texts stay.

    Rows that repeat an id and its text are the same document and stay or go together.
    """
    found = near_duplicates(docs).filter(F.col("doc_id") != F.col("class_id"))
    losers = spool(found.select(F.col("doc_id").alias("_loser"), F.col("text_hash").alias("_hash")).distinct(), "losers")
    return docs.join(losers, (F.col("doc_id") == F.col("_loser")) & same_text(F.col("_hash")), "left_anti")


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, c = x.n AND c = y.n AS copy FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), class AS (SELECT a, min(b) AS least FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n_links, count(*) FILTER (WHERE copy) AS n_copies FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id,
       coalesce(g.n_links, 0) AS n_links, coalesce(g.n_copies, 0) AS n_copies
FROM documents d LEFT JOIN class c ON c.a = d.doc_id LEFT JOIN degree g ON g.a = d.doc_id
"""
