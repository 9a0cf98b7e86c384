"""The corpus pipeline: its stages on odd rows, and the whole of it against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from delaymill.llm import decontaminate, line_dedup, mixing, quality
from delaymill.llm.support import shielded
from tests.llm.test_operators import SCHEMA, _slow_tiles, empty, odd  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
CLASHING = (
    "_kept", "_n_lines", "_n_dropped", "_drops", "_drop_id", "_loser", "_hash", "_bad", "_score", "_statistics", "_tokens",
    "_source", "_lang", "_topic", "_share", "_probability", "topic", "n_tokens", "probability", "key", "class_id", "unit",
)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, tmp_path, name, stage):  # noqa: F811
    docs = odd.drop("key").withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, FOLDER)
        out.write.parquet(str(tmp_path / f"out-{rows is docs}"))
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        if name != "mixing":
            assert out.columns == docs.columns
            for r in out.collect():
                assert all(r[c] == f"own {c}" for c in CLASHING)
    kept = Counter(r.doc_id for r in stage(spark, docs, FOLDER).collect())
    if name in ("lines", "decontamination"):
        assert kept == {1: 1, 2: 1, 3: 2, None: 1, 4: 1, 5: 1, 6: 1}
    if name == "near_duplicates":
        assert kept == {1: 1, 2: 1, 3: 2, None: 1, 4: 1, 5: 1}
    if name == "mixing":
        assert not {1, 2} & set(kept) and kept[3] in (0, 2)


def test_own_columns_replace_clashing_ones(spark):
    @shielded("_a")
    def adds(docs):
        return docs.withColumn("_a", F.lit(2))

    @shielded("_a")
    def passes(docs):
        return docs.withColumn("_a", F.lit(2)).drop("_a")

    docs = spark.createDataFrame([(1, 3, 4)], "_A int, b int, _A_input int")
    assert adds(docs).first().asDict() == {"b": 3, "_A_input": 4, "_a": 2}
    assert passes(docs).first().asDict() == {"_A": 1, "b": 3, "_A_input": 4}
    assert line_dedup.drop_repeated_lines(empty(spark).withColumn("_kept", F.lit(1))).columns[-3:] == ["_kept", "_n_lines", "_n_dropped"]


def test_tests_of_any_id_type(spark):
    words = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([("a", words), (None, words)], "item_id string, text string")
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    assert {r.item_id for r in decontaminate.contaminated(docs, bench).collect()} == {"a", None}


def _cut_lines(texts):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    common = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return {i: "\n".join(x for x in t.split("\n") if common.get(key(x), i) == i) for i, t in texts.items()}


def _first_of_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return {i: t for i, t in texts.items() if group[i] == i}


def _holds(text, test):
    t, p = (re.findall(r"\w+", x.lower()) for x in (text, test))
    least = min(5, len(p))
    runs = {tuple(p[k : k + least]) for k in range(len(p) - least + 1)}
    near = [any(tuple(t[k : k + least]) in runs for k in range(max(0, j - least + 1), j + 1)) for j in range(len(t))]
    if not p or not any(near):
        return False
    return _slow_tiles(p, [w if n else None for w, n in zip(t, near, strict=True)], least) >= 0.5 * len(p)


def _mixed(rows):
    """Raking and sampling of (doc_id, text, lang, source) in plain loops: doc_id -> probability of those kept."""

    def kind(t, n):
        for name, found in (("licensed", "Licensed under"), ("tabular", " | "), ("contact", "@")):
            if found in t:
                return name
        return "note" if n < 120 else "article" if n < 600 else "long read"

    cell, tokens = {}, {}
    for i, t, lang, source in rows:
        tokens[i] = len(re.findall(r"[^ \t\n\r]+", t))
        cell[i] = (source or "unknown", lang or "unknown", kind(t, tokens[i]) if tokens[i] else "empty")
    size = Counter()
    for i, c in cell.items():
        size[c] += tokens[i]
    size = {c: n for c, n in size.items() if n}
    weight = {c: float(n) for c, n in size.items()}
    goals = []
    for d in range(3):
        sums = Counter()
        for c, n in size.items():
            sums[c[d]] += n
        whole = sum(n**0.8 for n in sums.values())
        goals.append({v: n**0.8 / whole for v, n in sums.items()})
    for _ in range(300):
        for d in range(3):
            sums = Counter()
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * goals[d][c[d]] / sums[c[d]] for c, w in weight.items()}
    whole = sum(size.values())
    chance = {i: min(1.0, 0.5 * weight[c] / size[c] * whole) for i, c in cell.items() if tokens[i]}
    drawn = {i: int(hashlib.md5(f"{i} {mixing.SEED}".encode()).hexdigest()[:12], 16) / 16**12 for i in chance}
    return {i: p for i, p in chance.items() if drawn[i] < p}


def test_pipeline_equals_brute_force(spark):
    tables = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    good = {r.doc_id for r in quality.classify(tables["documents"], tables["labels"]).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in tables["documents"].collect()}
    texts = _first_of_groups(_cut_lines({i: rows[i].text or "" for i in good}))
    tests = [r.text for r in tables["benchmark"].collect() if r.text]
    texts = {i: t for i, t in texts.items() if not any(_holds(t, b) for b in tests)}
    want = _mixed([(i, t, rows[i].lang, rows[i].source) for i, t in texts.items()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert want and {i: r.probability for i, r in got.items()} == pytest.approx(want, rel=1e-6)
    assert all(r.text == texts[i] and r.n_chars == len(r.text) for i, r in got.items())
