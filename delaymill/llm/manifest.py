"""Operator 11: Merkle manifest of a dataset by time-forward processing.

Every node of the trees has a label (tree, level, place), and labels ascend from the leaves to the roots. The forward sweep
delivers digests to the labels of their parents through an external priority queue: messages are range-partitioned and sorted by label
in shared storage, and one sweep takes all messages of the lowest level. The reversed sweep delivers the part of the proof that
lies above a node to its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.operators.ranking import rank_rows
from delaymill.session import spool

FAN = 8
ABSENT = "-"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def coded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit(ABSENT))


def leaf(**changed: Column) -> Column:
    """The digest of a row's ``FIELDS``; ``changed`` puts another value in the place of a field."""
    return digest(F.concat(*[coded(changed.get(f, F.col(f))) for f in FIELDS]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda held, step: digest(F.concat(step["left"], held, step["right"])))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")


def forward(nodes: DataFrame, tree: str, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The runs of each level, lowest first: tree, label, nodes (of the run, in order), width (of their level) and digest.

    ``nodes`` has the column ``tree``, place (from 0 in each tree), width (nodes of the tree), digest and what its rows carry. A tree of
    one node goes through the remaining levels unchanged.
    """
    widest = nodes.agg(F.max("width")).first()[0] or 0
    levels = []
    while True:
        node = F.struct("place", "digest", *carried)
        messages = nodes.select(tree, F.expr(f"place div {FAN}").alias("label"), "width", node.alias("node"))
        queue = messages.repartitionByRange(F.col(tree).asc_nulls_first(), F.col("label"))
        runs = queue.groupBy(tree, "label").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.max("width").alias("width"))
        above = F.when(F.col("width") == 1, F.col("nodes")[0]["digest"]).otherwise(digest(_joined(F.col("nodes"))))
        runs = spool(runs.withColumn("digest", above), "runs")
        levels.append(runs)
        if widest <= FAN:
            return levels
        widest, carried = -(-widest // FAN), ()
        nodes = runs.select(tree, F.col("label").alias("place"), F.expr(f"(width + {FAN - 1}) div {FAN}").alias("width"), "digest")


def reversed_sweep(levels: list[DataFrame], tree: str, tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level as rows: tree, node, the columns of ``tops`` and ``path``, the siblings on the way up.

    ``tops`` has one row per tree with the path above its top.
    """
    facts = [c for c in tops.columns if c not in (tree, "path")]
    reached = tops.withColumn("label", F.lit(0).cast("long"))
    for i, runs in enumerate(reversed(levels)):
        above = reached.select(F.col(tree).alias("_tree"), F.col("label").alias("_label"), *facts, "path")
        met = runs.join(above, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("label") == F.col("_label")))
        each = met.select(tree, "nodes", "width", *facts, "path", F.posexplode("nodes").alias("at", "node"))
        left, right = _joined(F.slice("nodes", F.lit(1), F.col("at"))), _joined(F.slice("nodes", F.col("at") + 2, F.lit(FAN)))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        path = F.when(F.col("width") == 1, F.col("path")).otherwise(F.concat(step, F.col("path")))
        each = each.select(tree, "node", *facts, path.alias("path"))
        if i == len(levels) - 1:
            return each
        reached = spool(each.select(tree, F.col("node.place").alias("label"), *facts, "path"), "paths")


def proofs(leaves: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, leaf, the ``carried`` columns, subroot, root and path of every row of ``leaves`` (doc_id, lang, leaf, carried).

    ``path`` has for each level from the leaf's run up to the root the joined digests of the siblings to the left and right; a
    level at which the leaf's tree has one node is left out, a run of one node has two empty strings. Leaves of a language
    ascend by doc_id, null first, equal ids by leaf; a null language comes first among the subroots. Only digests are shuffled; a
    language of any size spreads over tasks. An empty table has no rows and no root.
    """
    placed = rank_rows(leaves, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "place")
    placed = spool(placed.withColumn("place", F.col("place") - 1), "leaves")
    widths = placed.groupBy("lang").agg((F.max("place") + 1).alias("width")).withColumnRenamed("lang", "_lang")
    nodes = placed.join(widths, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("digest", F.col("leaf"))
    levels = forward(nodes, "lang", ("doc_id", *carried))
    subroots = rank_rows(levels[-1].select("lang", "digest"), [], [F.col("lang").asc_nulls_first()], "place")
    tops = subroots.withColumns({"place": F.col("place") - 1, "whole": F.lit(0), "width": F.lit(levels[-1].count()).cast("long")})
    upper = forward(tops, "whole", ("lang",))
    root = upper[-1].select("whole", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    langs = reversed_sweep(upper, "whole", root).select(F.col("node.lang").alias("lang"), F.col("node.digest").alias("subroot"), "root", "path")
    found = reversed_sweep(levels, "lang", langs)
    return found.select("node.doc_id", F.col("node.digest").alias("leaf"), *[F.col(f"node.{c}") for c in carried], "subroot", "root", "path")


def _leaf_sql(text: str) -> str:
    coded = [f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(coded)})"


ORACLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents
), rows AS MATERIALIZED (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), up AS (
  SELECT lang, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS width FROM rows
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), max((width + 7) // 8) FROM up WHERE width > 1
  GROUP BY lang, level, place // 8
), subroots AS MATERIALIZED (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS width FROM up WHERE width = 1
), top AS (
  SELECT 0 AS level, place, digest, width FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), max((width + 7) // 8) FROM top WHERE width > 1
  GROUP BY level, place // 8
), steps AS (
  SELECT r.lang, r.place, s.level, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < r.place // pow(8, s.level)::BIGINT), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > r.place // pow(8, s.level)::BIGINT), '') AS r
  FROM rows r JOIN (SELECT DISTINCT lang, level FROM up WHERE width > 1) v ON v.lang IS NOT DISTINCT FROM r.lang
  JOIN up s ON s.lang IS NOT DISTINCT FROM r.lang AND s.level = v.level AND s.place // 8 = r.place // pow(8, v.level + 1)::BIGINT
  GROUP BY r.lang, r.place, s.level
  UNION ALL
  SELECT r.lang, r.place, 1000 + s.level, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < b.place // pow(8, s.level)::BIGINT), ''),
         coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > b.place // pow(8, s.level)::BIGINT), '')
  FROM rows r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang
  JOIN top s ON s.width > 1 AND s.place // 8 = b.place // pow(8, s.level + 1)::BIGINT
  GROUP BY r.lang, r.place, s.level
), paths AS (
  SELECT lang, place, string_agg(l || r, '' ORDER BY level) AS siblings, list({{'l': l, 'r': r, 'd': ''}} ORDER BY level) AS path FROM steps GROUP BY lang, place
), found AS (
  SELECT r.doc_id, r.leaf, b.digest AS subroot, (SELECT digest FROM top WHERE width = 1) AS root, coalesce(p.siblings, '') AS siblings,
         list_reduce(list_concat([{{'l': '', 'r': '', 'd': r.tampered}}], coalesce(p.path, [])),
                     lambda a, x: {{'l': '', 'r': '', 'd': sha256(x.l || a.d || x.r)}}).d AS folded_root
  FROM rows r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM r.lang AND p.place = r.place
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM found
"""
