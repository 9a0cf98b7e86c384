"""Operator 9: document fingerprints as invertible Bloom lookup sketches. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaymill.operators.ranking import running_totals
from delaymill.session import spool

PIECE = r"[^\n]{200}[^\n.!?]*+[.!?]*+|[^\n]+"  # a paragraph; longer ones end with a sentence after 200 code points
TABLES, SLOTS = 3, 8  # each digest falls into one slot of each table
ROUNDS = 12  # of peeling all pure cells at once
RETRIES = (16, 64, 256, 1024)  # slots of each table in the tries after the first; each hashes the digests anew
SHARE = 8  # mean digests of a shard in a retry; digests are dealt to shards by their hash
SLICES = 4  # of texts, for each shuffle partition
ROWS_OF_A_REPEAT = 32  # at least, of equal rows that fill several slices

_NOTHING = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def digests(text: str) -> str:
    """SQL of the distinct 64-bit digests of a text's paragraphs."""
    return f"array_distinct(transform(regexp_extract_all({text}, '{_escaped(PIECE)}', 0), p -> xxhash64(p)))"


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def placed(digest: str, slots: int = SLOTS) -> str:
    """SQL of a digest with its own hash, its cell in each table, and the bits that deal it to a shard."""
    used = digest if slots == SLOTS else f"xxhash64({digest}, {slots})"
    bits = slots.bit_length() - 1
    at = ", ".join(f"'p{t}', {t * slots} + CAST(shiftright({used}, {t * bits}) & {slots - 1}L AS INT)" for t in range(TABLES))
    return f"named_struct('k', {digest}, 'c', xxhash64({digest}), {at}, 's', CAST(shiftright({used}, 32) & 2147483647L AS INT))"


def _falls(entry: str) -> str:
    return " OR ".join(f"q = {entry}.p{t}" for t in range(TABLES))


def _filled(entries: str, slots: int) -> str:
    """SQL of the cells of some placed digests: how many fell in, their xor, and the xor of their own hashes."""
    return (
        f"transform(sequence(0, {TABLES * slots - 1}), q -> aggregate(filter({entries}, e -> {_falls('e')}), {_NOTHING}, "
        "(a, e) -> named_struct('n', a.n + 1, 'k', a.k ^ e.k, 'c', a.c ^ e.c)))"
    )


def cells(found: str) -> str:
    """SQL of the smallest sketch of some digests."""
    return f"transform(array(transform({found}, d -> {placed('d')})), f -> {_filled('f', SLOTS)})[0]"


def subtract(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def peel(difference: str, slots: int = SLOTS) -> str:
    """SQL of the digests that a subtracted sketch holds, null if some cells stay full.

    Each round takes the digest of every pure cell (one digest more on one side) out of all its cells.
    """
    pure = (
        "array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 AND x.c = xxhash64(x.k)), "
        f"x -> named_struct('n', x.n, 'e', {placed('x.k', slots)})))"
    )
    left = (
        f"zip_with(s.cells, sequence(0, {TABLES * slots - 1}), (x, q) -> aggregate(filter(pure, p -> {_falls('p.e')}), x, "
        "(a, p) -> named_struct('n', a.n - p.n, 'k', a.k ^ p.e.k, 'c', a.c ^ p.e.c)))"
    )
    # a transform over one element names a value that is used several times
    taken = f"named_struct('cells', {left}, 'found', concat(s.found, transform(pure, p -> p.e.k)), 'go', size(pure) > 0)"
    step = f"(s, r) -> CASE WHEN s.go THEN transform(array({pure}), pure -> {taken})[0] ELSE s END"
    start = f"named_struct('cells', {difference}, 'found', CAST(array() AS ARRAY<BIGINT>), 'go', true)"
    done = "forall(s.cells, x -> x.n = 0 AND x.k = 0L AND x.c = 0L)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, {step}, s -> CASE WHEN {done} THEN s.found END)"


def _retried(left: str, right: str, slots: int) -> str:
    """The differing digests by sketches in as many shards as both sides together need, null on failure."""
    shards = f"CAST(pow(2, greatest(0, ceil(log2((size({left}) + size({right})) / {SHARE})))) AS INT)"
    own = [f"filter({side}, e -> (e.s & (m - 1)) = i)" for side in "lr"]
    each = peel(subtract(_filled("z.l", slots), _filled("z.r", slots)), slots)
    pairs = f"transform(sequence(0, m - 1), i -> named_struct('l', {own[0]}, 'r', {own[1]}))"
    opened = f"transform({pairs}, z -> {each})"
    for name, value in (("r", right), ("l", left)):
        opened = f"transform(array(transform({value}, d -> {placed('d', slots)})), {name} -> {opened})[0]"
    opened = f"transform(array({shards}), m -> {opened})[0]"
    return f"transform(array({opened}), o -> CASE WHEN forall(o, x -> x IS NOT NULL) THEN flatten(o) END)[0]"


def sketched(left: str, right: str) -> str:
    """SQL of the digests that only one of two digest arrays has, by sketches alone; null if even the largest fails."""
    first = peel(subtract(cells(left), cells(right)))
    return f"coalesce({', '.join([first, *(_retried(left, right, n) for n in RETRIES)])})"


def difference(left: str, right: str) -> Column:
    """The digests that only one of two digest arrays (column names) has.

    Sketches of both are subtracted and peeled; on failure others with more and larger tables and new hashes are tried. Should all
    fail, which needs digests that share their cells in every one, the digests are compared as they are.
    """
    exact = f"concat(array_except({left}, {right}), array_except({right}, {left}))"
    return F.expr(f"coalesce({sketched(left, right)}, {exact})")


def likeness(left: str, right: str, differing: str) -> Column:
    """Jaccard similarity of two digest arrays, from their sizes and the number of differing digests; 1 if both are empty."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.col(differing)) / (total + F.col(differing)))


def fingerprint(found: str) -> Column:
    """The smallest sketch of a digest array as text: count, xor and check of each cell in hexadecimal."""
    shown = f"transform({cells(found)}, x -> concat_ws('.', hex(x.n), hex(x.k), hex(x.c)))"
    return F.expr(f"concat_ws('-', {shown})")


def _borders(rows: DataFrame, slices: int) -> list[tuple[int, int, int, int]]:
    """Where slices of near equal bytes begin: doc_id, hash of the text, number of the slice, and how many slices begin with that key.

    Only ids, hashes and sizes are sorted. A key of many equal rows that fill several slices begins as many.
    """
    keys = rows.groupBy("doc_id", "_digest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + 1).alias("bytes"))
    placed = spool(running_totals(keys, [], [F.col("doc_id").asc(), F.col("_digest").asc()], {"bytes": "end"}), "keys")
    target = -(-(placed.agg(F.max("end")).first()[0] or 0) // slices) or 1
    repeats = F.greatest(F.lit(1), F.least(F.expr(f"(bytes + {target - 1}) div {target}"), F.expr(f"n div {ROWS_OF_A_REPEAT}"))).alias("repeats")
    keyed = placed.select(F.struct("doc_id", "_digest", repeats).alias("key"), F.expr(f"(end - bytes) div {target}").alias("at"))
    # at most one key for each slice, and one more after a key that ends inside the next slice
    found = keyed.groupBy("at").agg(F.min("key").alias("key")).orderBy("at").collect()
    borders, number = [], 0
    for row in found:
        borders.append((row.key.doc_id, row.key._digest, number, row.key.repeats))
        number += row.key.repeats
    return borders


def _border_of(borders: list[tuple[int, int, int, int]]) -> Column:
    """The last border up to the row's key (doc_id, _digest), by bisection over a constant."""
    constant = F.from_json(F.lit(json.dumps([dict(zip("dhsm", b)) for b in borders])), "array<struct<d:bigint,h:bigint,s:bigint,m:bigint>>")
    whole = F.struct(F.lit(0).alias("low"), F.lit(len(borders) - 1).alias("high"))

    def halve(span, _):
        middle = F.floor((span["low"] + span["high"] + 1) / 2).cast("int")
        there = F.get(constant, middle)
        behind = (there["d"] > F.col("doc_id")) | ((there["d"] == F.col("doc_id")) & (there["h"] > F.col("_digest")))
        return F.when(behind, F.struct(span["low"].alias("low"), (middle - 1).alias("high"))).otherwise(
            F.struct(middle.alias("low"), span["high"].alias("high"))
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, len(borders).bit_length())))
    return F.get(constant, F.aggregate(steps, whole, halve, lambda span: span["low"]))


def sliced(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with an id (doc_id, text, _digest, _slice), and for each slice but the last the first text of the one after it; the last has that of the first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull()).withColumn("_digest", F.xxhash64("text"))
    borders = _borders(rows, SLICES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not borders:
        return rows.withColumn("_slice", F.lit(0).cast("long")), rows.select("text", F.lit(0).cast("long").alias("_slice"))
    dealt = rows.withColumn("_border", _border_of(borders))
    begins = (F.col("_border.d") == F.col("doc_id")) & (F.col("_border.h") == F.col("_digest"))
    number = F.when(begins, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_border.m"))).otherwise(F.col("_border.m") - 1)
    firsts = dealt.filter(begins).groupBy(F.col("_border.s").alias("_slice"), F.col("_border.m").alias("m")).agg(F.min("text").alias("text"))
    firsts = spool(firsts, "firsts")  # at most one text a slice
    total = borders[-1][2] + borders[-1][3]
    each = firsts.select("text", F.explode(F.sequence("_slice", F.col("_slice") + F.col("m") - 1)).alias("_slice"))
    return dealt.withColumn("_slice", F.col("_border.s") + number).drop("_border"), each.withColumn("_slice", F.pmod(F.col("_slice") - 1, F.lit(total)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and ``following``, the text of the next document by ascending id, after the last the first.

    Slices of near equal bytes are fixed on ids and hashes of texts alone; then every text is dealt to its slice in one shuffle and ordered
    there, next to the first text of the slice after it. Neither near ids nor a repeated one make a slice large: rows of one id follow each other
    by the hash of their text, and equal rows, which need no order, are dealt to several slices if they fill them. Rows with a null id
    are followed by an empty text.
    """
    rows, guards = sliced(docs)
    guards = guards.select("text", "_slice", F.lit(1).alias("_copy"))
    order = Window.partitionBy("_slice").orderBy("_copy", "doc_id", "_digest")
    all_rows = rows.withColumn("_copy", F.lit(0)).unionByName(guards, allowMissingColumns=True)
    linked = all_rows.withColumn("following", F.lead("text").over(order)).filter("_copy = 0").select("doc_id", "text", "following")
    alone = docs.filter(F.col("doc_id").isNull())
    return linked.unionByName(alone.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("following")))


def edit(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row (doc_id, text; others ignored).

    A fingerprint is an invertible sketch of the distinct digests of a text's paragraphs; likeness is their
    Jaccard similarity, found by subtracting sketches. A text below 200 code points, or of one line without . ! or ?, may be a
    single piece, so that an edit anywhere makes its likeness 0. Null texts are empty; repeated rows give one row each.
    """
    rows = with_next(docs).select(
        "doc_id", "text", "following", edit(F.col("text"), F.col("following")).alias("edited"), F.expr(digests("text")).alias("own")
    )
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own",
        F.expr(digests("edited")).alias("changed"),
        F.expr(digests("following")).alias("next"),
    )
    # columns of their own, as an expression inside a condition is computed at every use
    rows = rows.select(
        "*", F.size(difference("own", "changed")).alias("from_changed"), F.size(difference("own", "next")).alias("from_next")
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint("own").alias("fingerprint"),
        fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed", "from_changed").alias("near_edited"),
        likeness("own", "next", "from_next").alias("near_next"),
    )
