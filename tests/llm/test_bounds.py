"""What the corpus operators promise on unusual tables: budgets, samples, tasks, models against plain walks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from delaymill.llm import chat, decontaminate, language_id, mixing, quality, warc

TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed, n=25):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        small, large = rng.choice([(1, 5), (1, 60), (30, 90), (1, 300)])
        if rng.random() < 0.6:
            rows.append((c, -1, "system", "s " * rng.choice([2, 40, 90, 130])))
        for t in range(rng.randint(1, 30)):
            rows.append((c, t, ("user", "assistant")[t % 2], "w " * rng.randint(small, large)))
    return rows


@pytest.mark.parametrize("budget, history", [(120, 30), (200, 190)])
def test_windows_keep_the_budget(spark, budget, history):
    rows = conversations(budget + history)
    made = chat.windows(spark.createDataFrame(rows, TURNS), budget, history).collect()
    size = lambda text: len(re.findall(r"\w+|[^\w\s]", text)) + chat.TURN_TOKENS
    system = {c: size(x) for c, _, role, x in rows if role == "system"}
    longest = {c: max(size(x) for d, _, role, x in rows if d == c and role != "system") for c in {r[0] for r in rows}}
    several = Counter(r.conv_id for r in made)
    for r in made:
        parts = r.formatted.split(chat.END)[:-1]
        assert r.n_tokens == sum(size(p.split("\n", 1)[1]) for p in parts)
        assert r.n_tokens <= max(budget, system.get(r.conv_id, 0) + longest[r.conv_id])
    assert sum(n > 1 for n in several.values()) > len(several) / 2
    digests = {r.conv_id: r.n_turns for r in chat.conversation_digests(spark.createDataFrame(made)).collect()}
    assert digests == Counter(r[0] for r in rows)


def test_windows_of_long_system_and_single_turns(spark):
    rows = [(1, -1, "system", "s " * 1100), *((1, t, "user", "w " * 12) for t in range(200))]
    rows += [(2, t, "user", "w " * n) for t, n in enumerate([300, 300, 1500, 300])]
    made = chat.windows(spark.createDataFrame(rows, TURNS)).collect()
    assert max(r.n_tokens for r in made) <= chat.BUDGET and len([r for r in made if r.conv_id == 1]) > 3


def test_windows_of_odd_turns(spark):
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "assistant", "y"), (4, 0, "user", "w " * 400)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("tokens", F.lit("clash"))
    got = {r.conv_id: r.n_turns for r in chat.conversation_digests(chat.windows(frame, 100, 20)).collect()}
    assert got == {None: 2, 3: 3, 4: 1}


# models


def labelled(spark, texts, labels=(0, 1)):
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, labels[i % len(labels)]) for i, _ in rows], "doc_id long, quality int")


@pytest.mark.parametrize("text", ["the same words", "", None])
def test_quality_of_texts_that_are_all_alike(spark, text):
    docs, labels = labelled(spark, [text] * 40)
    scores = {r.score for r in quality.classify(docs, labels).collect()}
    assert len(scores) == 1 and 0.3 < scores.pop() < 0.7
    assert quality.keep_good(docs, labels).count() in (0, 40)


def test_one_id_on_a_third_of_the_rows_is_learnt_from_once(spark, monkeypatch):
    held = {}

    def watched(df, name, run=quality.spool):
        held[name] = run(df, name)
        return held[name]

    monkeypatch.setattr(quality, "spool", watched)
    monkeypatch.setattr(language_id, "spool", watched)
    hot = [(7, f"hot text number {i}", "en") for i in range(900)] + [(7, "same hot text", "en")] * 100
    rows = hot + [(i, f"word{i} and others " * (i % 9 + 1), ("en", "de")[i % 2]) for i in range(1000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = docs.select("doc_id").distinct()
    quality.train(docs, ids.withColumn("quality", (F.col("doc_id") % 2).cast("int")), sample=200)
    assert 100 < held["quality"].count() < 300 and held["quality"].filter("doc_id = 7").count() <= 1
    language_id.train(docs, per_language=100, landmarks=20)
    assert 100 < held["spectra"].count() < 320 and held["spectra"].filter("doc_id = 7").count() <= 1


def test_rules_equal_a_walk_of_the_trees(spark, monkeypatch):
    forests = []

    def watched(forest, run=quality.tree_rules):
        forests.append(forest)
        return run(forest)

    monkeypatch.setattr(quality, "tree_rules", watched)
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rules = quality.tree_rules(forests[0])
    rows = docs.collect()
    statistics = {r.doc_id: quality.statistics_of(r.text or "") for r in rows}

    def reached(node, values):
        """The conditions on the way of a row through a tree, one path for every node it passes."""
        paths, path = [], []
        while node.getClass().getSimpleName() == "InternalNode":
            at, value = node.split().featureIndex(), node.split().threshold()
            left = values[at] <= value
            path = [*path, (at, not left, value)]
            paths.append(path)
            node = node.leftChild() if left else node.rightChild()
        return paths

    trees = [t.rootNode() for t in forests[0]._java_obj.trees()]
    holds = lambda rule, values: all((values[c.statistic] > c.value) == c.above for c in rule)
    for r in rows[:40]:
        values = statistics[r.doc_id]
        passed = {quality._tightest(tuple(quality.Condition(*c) for c in path)) for t in trees for path in reached(t, values)}
        assert passed == {rule for rule in rules if holds(rule, values)}
    for r in quality.score(docs.select("doc_id", "text"), model).collect():
        total = model.intercept + sum(w for rule, w in model.weights if holds(rule, statistics[r.doc_id]))
        assert r._score == pytest.approx(1 / (1 + math.exp(-total)))


def test_scores_equal_an_unbatched_kernel(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    model = language_id.train(docs, per_language=20, landmarks=12)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = model.landmarks
    sets = [set(marks.vocabulary[marks.presence[:, j] > 0].tolist()) for j in range(len(marks.norms))]
    for r in language_id.predict(docs, model).collect():
        own = set(language_id.grams(texts[r.doc_id]).tolist())
        kernel = [len(own & s) / math.sqrt(max(1, len(own)) * len(s)) for s in sets]
        margins = np.array(kernel) @ model.weights
        best = int(np.argmax(margins))
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(float(np.clip((margins[best] + 1) / 2, 0, 1)), abs=1e-5)
    named = docs.withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    assert language_id.identify(named, per_language=20, landmarks=12).count() == 60


# the others


def test_archives_are_read_by_tasks_in_proportion_to_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 1 << 16)
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 17)
    rng = random.Random(1)
    rows = [(i, "u", rng.randbytes(9000).hex()) for i in range(300)]
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    total = index.agg(F.sum("length")).first()[0]
    read = warc.read_records(index, folder)
    assert read.rdd.getNumPartitions() == -(-total // (1 << 17)) > 15
    assert {r.page_id for r in read.select("page_id").collect()} == set(range(300))
    few = warc.read_records(index.filter("page_id < 3"), folder)
    assert few.rdd.getNumPartitions() < 3 and few.count() == 3


def test_archives_of_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (3, None, None), (None, "u", "only here")]
    pages = spark.createDataFrame(rows, schema).withColumn("digest", F.lit(5)).withColumn("file", F.lit("x"))
    folder = f"file://{tmp_path}/odd"
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(pages, folder), folder).collect())
    assert got == {(1, "response", None): 2, (2, "revisit", 1): 1, (3, "response", None): 1, (None, "response", None): 1}
    none = f"file://{tmp_path}/none"
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], schema), none), none).count() == 0


def test_an_empty_benchmark_takes_nothing(spark):
    docs = spark.createDataFrame([(1, "some words of a text " * 9), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).filter("doc_id IS NULL").count() == 0
    assert decontaminate.remove_contaminated(docs, none).count() == 2


def test_the_sample_of_the_given_table_has_the_raked_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = mixing.mix(docs).cache()
    cells = mixing.described(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_cell_tokens"))
    whole = cells.agg(F.sum("_cell_tokens")).first()[0]
    for d in mixing.DIMENSIONS:
        goal = {r.value: r.share for r in mixing.tempered(cells, d, mixing.TEMPER).collect()}
        got = {r[0]: (r.n, r.v) for r in sample.groupBy(f"_{d}").agg(
            F.sum(F.col("_tokens") * F.col("_copies")).alias("n"), F.sum(F.col("_tokens") * F.col("_tokens")).alias("v")
        ).collect()}
        for value, share in goal.items():
            want = mixing.FRACTION * whole * share / sum(goal.values())
            n, squares = got.get(value, (0, 0))
            assert abs(n - want) < 4 * math.sqrt(squares + 1) + 0.01 * want
