"""Steps that must stay small for the driver and for a task: tasks of small aggregates, texts held at a time."""

import pytest

from delaymill.llm import mixing, ngram_join, token_counts
from delaymill.llm.support import texts

public_tokenizers = pytest.importorskip("public_tokenizers")

WIDE = 200  # shuffle partitions, none of them merged


@pytest.fixture
def tasks_of(spark):
    """The number of tasks of every stage that some work starts."""
    settings = {"spark.sql.shuffle.partitions": str(WIDE), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext

    def run(work):
        context.setJobGroup(work.__name__, "counted")
        work()
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(work.__name__)]
        return [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s)]

    for k, v in settings.items():
        spark.conf.set(k, v)
    yield run
    for k, v in old.items():
        spark.conf.set(k, v)
    context._jsc.clearJobGroup()


def test_sweeps_do_not_run_a_task_for_each_shuffle_partition(spark, tasks_of):
    rows = [(s, x, 10 * s + x + 1) for s in range(5) for x in range(4)]
    cells = spark.createDataFrame([(f"s{s}", f"l{x}", n) for s, x, n in rows], "_source string, _lang string, _cell_tokens long")
    goals = {
        "source": spark.createDataFrame([(f"s{s}", 1.0 + s) for s in range(5)], "value string, share double"),
        "lang": spark.createDataFrame([("l0", 3.0), ("l1", 1.0), ("l9", 5.0), ("l3", 1.0)], "value string, share double"),
    }
    got = []

    def rake_cells():
        got.extend(mixing.rake(cells, goals).collect())

    sizes = tasks_of(rake_cells)
    assert sum(n >= WIDE for n in sizes) <= 2 * len(goals)  # the goals alone; a sweep has as many steps, and there are several
    total = sum(r._weight for r in got)
    by = lambda c, v: sum(r._weight for r in got if r[c] == v) / total
    assert [round(by("_lang", x), 6) for x in ("l0", "l1", "l2", "l3")] == [0.6, 0.2, 0.0, 0.2]
    assert [round(by("_source", f"s{s}"), 6) for s in range(5)] == [round((1 + s) / 15, 6) for s in range(5)]
    assert got[0].__fields__ == ["_source", "_lang", "_cell_tokens", "_weight"]


def test_components_do_not_run_a_task_for_each_shuffle_partition(spark, tasks_of):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55)], "a long, b long")
    found = {}

    def find():
        found.update((r.node, r.label) for r in ngram_join.components(edges).collect())

    sizes = tasks_of(find)
    assert sum(n >= WIDE for n in sizes) <= 1  # the last distinct, which the caller goes on with
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 55: 50, 60: 50}


def test_token_counts_hold_few_texts_at_a_time(spark, monkeypatch):
    def few(column):
        if len(column) > 1024:
            raise ValueError(f"{len(column)} texts at a time")
        return texts(column)

    monkeypatch.setattr(token_counts, "texts", few)
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = [(i, f"document {i % 7} of a  batch") for i in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table, path).collect()}
    model = token_counts.load_model(path)
    assert counted == {i: (len(t.encode()), len(model.encode(t))) for i, t in docs}
