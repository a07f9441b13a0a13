"""Every registered core query against its SQL; plans; and the entry module without its optional part."""

import glob
import io
import math
import os
import shutil
import subprocess
import sys
from contextlib import redirect_stdout

import duckdb
import pytest

from cellweave.operators.select import Bounds, Read, select
from cellweave.plans import registry
from cellweave.plans.tables import Database
from cellweave.schema import Family
from cellweave.sources import encode

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def views(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int | float):
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.5f}".replace("-0.00000", "0.00000")
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, views, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(x[n]) for n in names) for x in df.collect())
    found = views.sql(registry.SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    assert got == sorted(tuple(plain(x[i]) for i in at) for x in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows_only(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def plan_of(df):
    with redirect_stdout(io.StringIO()) as said:
        df.explain("formatted")
    return said.getvalue()


def test_bounds_reach_the_scan(spark, sf, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("t", [Family("ev"), Family("other")])
    db.append("t", encode.events(spark, sf))
    own = select(db.log("t"), [Family("ev")], Read(rows=Bounds.prefix(b"u:0000001"), versions=2))
    said = plan_of(own)
    assert "PartitionFilters: [isnotnull(family" in said
    assert "GreaterThanOrEqual(row," in said and "LessThan(row," in said
    assert said.count("Exchange hashpartitioning") <= 4
    assert own.count() == select(encode.events(spark, sf), [Family("ev")], Read(rows=Bounds.prefix(b"u:0000001"), versions=2)).count()


def test_version_limits_prune_in_the_window(spark, sf):
    assert "WindowGroupLimit" in plan_of(select(encode.events(spark, sf), encode.EVENTS, Read(versions=2)))


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(f"{HERE}/cellweave", tmp_path / "cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_part():
    for path in glob.glob(f"{HERE}/cellweave/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "llm" not in f.read(), path


def test_workers_in_another_folder(sf, tmp_path):
    """A driver started elsewhere, with the repository on its own path alone."""
    code = f"""
import sys
sys.path.insert(0, {HERE!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert e.queries()["agg_hll"](spark, {sf!r}).count() > 0
assert e.entry(spark).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_counters_sum_before_the_shuffle(spark, sf):
    """Operands of a column are summed where they are read; no window sorts them."""
    said = plan_of(select(encode.hits(spark, sf), encode.HITS, Read(versions=0)))
    assert "Window" not in said and "partial_sum" in said
