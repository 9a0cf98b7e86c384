"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import TESTDATA, compare, duck

FOLDER = TESTDATA / "sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, connection, name):
    ok, note = compare(spark, connection, FOLDER, QUERIES[name], SQL[name])
    assert ok, note


def test_export_rules_hold(spark):
    broken = QUERIES["export_quality"](spark, str(FOLDER)).filter("violations > 0").collect()
    assert broken == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_the_corpus_part_may_lack_a_package():
    """The other queries register although a package of the corpus operators is missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), 'op2_token_counts' in e.queries())"
    root = Path(entry.__file__).parent
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=root, check=True)
    n, corpus = done.stdout.split()
    assert int(n) >= 90 and corpus == "False"
