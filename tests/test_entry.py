"""The driver contract: names agree, columns agree, and the package stands without its optional part."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from pagemill.plans import catalogue

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["health_verdicts", "languages_detected", "method_counts", "font_survey", "lexicon_file", "confidence_quantiles", "boxes_mutual_best"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    own = entry.queries()[name](spark, DATA)
    other = con.execute(entry.oracle_sql()[name])
    columns = sorted(own.columns)
    assert columns == sorted(c[0] for c in other.description)
    order = [[c[0] for c in other.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in own.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in other.fetchall()), key=str)


def test_without_optional_part():
    code = "import sys; sys.modules['pagemill.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not [n for n in e.queries() if n[0] == 'p' and n[1].isdigit()]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
