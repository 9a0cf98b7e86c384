"""Manifest, sharding and divergence audit on small frames, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from delaymill.llm import divergence, manifest, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long = "Word and more words. " * 3000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "One two three four", None, "a", 3), (3, "One two three four", None, "a", 3),
        (None, "some text without id", "en", None, 1), (4, long, "en", "b", 9), (5, "12 34 !!", "de", "b", None), (6, long, "en", "b", 9),
        (5, "Ünits [one] two", "de", "c", 4),
    ]
    clash = {"place": F.lit(1), "size": F.lit("x"), "term": F.lit(2), "shard": F.lit(3), "digest": F.lit(4)}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def many(spark, n, hot=0.4):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        lang = "en" if rng.random() < hot else rng.choice(["de", "fr", None, "Ünknown"])
        words = [rng.choice(["Alpha", "beta", "Gamma", "delta", "é", "Zeta"]) for _ in range(rng.randint(0, 40))]
        rows.append((i * 3 - n, " ".join(words), lang, rng.choice("abc"), len(words)))
    return spark.createDataFrame(rows, SCHEMA), rows


# the manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """The root and for each leaf the (left, right) siblings of its levels."""
    at, paths = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for i, p in enumerate(at):
            run = digests[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        digests = [sha("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
        at = [p // 8 for p in at]
    return digests[0], paths


def plain_manifest(rows):
    """A row per leaf as the query has it."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: plain_tree([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    root, above = plain_tree([built[x][0] for x in langs])
    out = []
    for x, upper in zip(langs, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(trees[x], key=lambda t: t[:3]), built[x][1], strict=True):
            path = path + upper
            held = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                lowered = r[1].translate({c: c + 32 for c in range(65, 91)})
                held = plain_leaf((r[0], lowered, *r[2:]))
            for left, right in path:
                held = sha(left + held + right)
            out.append((r[0], leaf, built[x][0], root, sha("".join(a + b for a, b in path)), held, held == root))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 9, 700])
def test_manifest_equals_plain_trees(spark, monkeypatch, n):
    docs, rows = many(spark, n)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert Counter(map(tuple, queries.op11_manifest(spark, "").collect())) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(map(tuple, queries.op11_manifest(spark, "").collect())) == plain_manifest(rows)
    monkeypatch.setattr(queries, "table", lambda *_: odd.limit(0))
    assert queries.op11_manifest(spark, "").count() == 0


def test_a_proof_fails_for_any_other_leaf(spark):
    docs, _ = many(spark, 100)
    proved = manifest.proofs(docs.select("doc_id", "lang", manifest.leaf().alias("leaf")))
    assert proved.filter(manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 100
    assert proved.filter(manifest.fold(F.reverse("leaf"), F.col("path")) == F.col("root")).count() == 0


# sharding


def plain_shards(points, first, k):
    """Shards of (weight, coordinates, name) points by plain recursion."""
    if k == 1 or not points:
        return {p[2]: first for p in points}
    spreads = [max(p[1][d] >> 31 for p in points) - min(p[1][d] >> 31 for p in points) for d in range(len(points[0][1]))]
    d = spreads.index(max(spreads))
    ordered = sorted(points, key=lambda p: p[1][d])
    whole = sum(p[0] for p in points)
    goal, before, left = max(1, int(whole * ((k // 2) / k))), 0, 0
    for left, p in enumerate(ordered):  # noqa: B007
        if before + p[0] >= goal:
            break
        before += p[0]
    if before == 0 or (2 * before + ordered[left][0] <= 2 * goal and before + ordered[left][0] < whole):
        left += 1
    return plain_shards(ordered[:left], first, k // 2) | plain_shards(ordered[left:], first + k // 2, k - k // 2)


@pytest.mark.parametrize("shards", [1, 7])
def test_shards_equal_plain_recursion(spark, shards, monkeypatch):
    docs, _ = many(spark, 900)
    held = {}

    def watched(*args, run=sharding.points):
        rows, found, k = run(*args)
        held["points"] = [(r.weight, [r[f"c{i}"] for i in range(4)], (r.key, r.part)) for r in found.collect()]
        held["rows"] = {r.doc_id: (r.key, r.part) for r in rows.collect()}
        return rows, found, k

    monkeypatch.setattr(sharding, "points", watched)
    got = {r.doc_id: r.shard for r in sharding.assign(docs, shards).collect()}
    want = plain_shards(held["points"], 0, shards)
    assert got == {d: want[p] for d, p in held["rows"].items()}


def test_shards_are_near_equal_whole_and_gapless(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(10, 400) for _ in range(4000)] + ["copy " * 10] * 3000 + [f"few {i // 4}" for i in range(400)]
    rows = [(i, t, rng.choice(["en", "de"]), f"s{rng.randrange(9)}", 0) for i, t in enumerate(texts)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), 8).collect()
    sizes = Counter()
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id].encode()))
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    places = defaultdict(list)
    for r in sorted(got, key=lambda r: r.doc_id):
        places[r.shard].append(r.slot)
    assert all(slots == list(range(len(slots))) for slots in places.values())
    of = {r.doc_id: r.shard for r in got}
    copies = [of[i] for i in range(4000, 7000)]
    assert sum(a != b for a, b in zip(copies, copies[1:])) == len(set(copies)) - 1  # runs of ascending ids
    assert all(len({of[7000 + 4 * i + j] for j in range(4)}) == 1 for i in range(100))
    assert len({of[i] for i in range(4000, 7000)}) > 1  # a third of all bytes


def test_shards_of_odd_rows(spark, odd):
    got = sharding.assign(odd, 3)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in odd.collect())
    assert {(r.size, r.text_crc32) for r in got.filter("doc_id IN (1, 2)").collect()} == {(8, 0)}
    assert sharding.assign(odd.limit(0)).count() == 0
    assert {r.shard for r in sharding.assign(odd, None, 70_000).collect()} == {0, 1}
    assert {r.shard for r in sharding.assign(odd.filter("doc_id = 3"), 4).collect()} <= set(range(4))


# the divergence audit


def plain_audit(rows, top=200):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in documents[lang].items() if n >= 3)
        own = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        share = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in own.items()}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        base = {t: 1 + 10**9 * (n + 1) // (sum(whole.values()) + len(kept)) for t, n in whole.items()}
        for s in own:
            pairs = [(-sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((share[s][t] - base[t]) ** 2 // base[t]), t.encode()) for t in kept if own[s][t] and share[s][t] > base[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("chunk, block", [(8192, 48), (64, 2)])
def test_audit_equals_plain_counts(spark, odd, chunk, block):
    rng = random.Random(6)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[: rng.choice([30, 300])], k=60)), rng.choice(["en", "de"]), f"s{rng.randrange(5)}", 0) for i in range(200)]
    rows += [(900, "Ünits und ÜNITS [x]", "fr", "a", 0)] * 3 + [(901, None, "fr", "b", 0), (902, "12", "xx", "a", 0), (903, "", "xx", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit(1)).withColumn("value", F.lit("x"))
    assert Counter(map(tuple, divergence.audit(docs, chunk=chunk, block=block).collect())) == plain_audit(rows)
    plain = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(map(tuple, divergence.audit(odd).collect())) == plain_audit(plain)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_joint_cells_of_all_containers():
    rng = np.random.default_rng(3)
    for shares in ((0.5, 0.3, 0.1), (0.001, 0.02), (0.2, 0.001, 0.05, 0.01)):
        counts = [rng.choice(len(shares) + 1, divergence.CHUNK, p=[1 - sum(shares), *shares]) for _ in range(2)]
        sides = []
        for c in counts:
            levels = [(n, divergence.packed(np.flatnonzero(c == n).astype(np.uint16))) for n in sorted(set(c.tolist()) - {0})]
            sides.append(divergence.Levels(int(c.sum()), divergence.CHUNK, levels))
        i, j, n = divergence.joint_cells(*sides)
        want = Counter(zip(*(c.tolist() for c in counts), strict=True))
        named = [sorted(set(c.tolist()) - {0}) for c in counts]
        assert {(named[0][a], named[1][b]): k for a, b, k in zip(i, j, n, strict=True)} == {k: v for k, v in want.items() if 0 not in k}
        p, q = ([divergence.rate(x, int(c.sum()), divergence.CHUNK) for x in c.tolist()] for c in counts)
        assert divergence.pair_value(*sides, (i, j, n), divergence.CHUNK) == sum((a - b) ** 2 // b for a, b in zip(p, q, strict=True))


def test_a_task_hands_its_counters_on(spark):
    docs, rows = many(spark, 60)
    assert Counter(map(tuple, divergence.audit(docs, held_terms=5).collect())) == plain_audit(rows)
    assert pa.array([divergence.packed(np.arange(3, dtype=np.uint16))])[0].as_py() == b"\0\0\1\0\2\0"
