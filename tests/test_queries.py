"""Each registered query against its SQL on the smallest tables, and the shape of the driver's entry points."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from recollect.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, pd.Timestamp):
            return (v.tz_convert("UTC").tz_localize(None) if v.tzinfo else v).isoformat()
        if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "dtype"):
            return str(v)
        return str(round(float(v), 6))

    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.QUERIES) <= set(entry_points.queries())


def test_library_stands_without_the_corpus_subpackage(tmp_path):
    """A copy without recollect/llm and tests/llm, with and without the pipeline's file, imports, gives its queries and runs one."""
    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'retrieve' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    code += f"; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert q['keyword_search'](s, '{SF}').count() > 0"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, check=True)
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.SQL)))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = normal(registry.QUERIES[name](spark, SF).toPandas()), normal(duck.sql(registry.SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


def test_concurrency_caps_with_equal_starts(spark, duck, tmp_path):
    """Users of one agent whose sessions start and end at the same times: a time over the cap counts once in both."""
    copies = " union all ".join(f"select event_id + {k} * 1000000 as event_id, ts, user_id + {k} * 10000 as user_id, event_type, value, props from events" for k in range(8))
    duck.sql(f"copy ({copies}) to '{tmp_path}/events.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    ours, theirs = normal(registry.QUERIES["concurrency_caps"](spark, str(tmp_path)).toPandas()), normal(con.sql(registry.SQL["concurrency_caps"]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
    assert (theirs["over"].astype(float) > 0).any()


def test_concurrency_caps_counts_each_start(spark, duck, tmp_path):
    """Eight users of one agent at the same times: each start over the cap counts, as a row for each start tells."""
    copies = " union all ".join(f"select event_id + {k} * 1000000 as event_id, ts, user_id + {k} * 10000 as user_id, event_type, value, props from events" for k in range(8))
    duck.sql(f"copy ({copies}) to '{tmp_path}/events.parquet' (format parquet)")
    steps = []
    for (agent, _), e in pd.read_parquet(tmp_path / "events.parquet").assign(agent=lambda x: x.user_id % 10, day=lambda x: x.ts.dt.strftime("%Y%m%d")).groupby(["user_id", "day"]):
        if e.ts.min() < e.ts.max():
            steps += [(e.agent.iloc[0], e.day.iloc[0], e.ts.min(), 1), (e.agent.iloc[0], e.day.iloc[0], e.ts.max(), -1)]
    live, over = {}, {}
    for agent, day, _, d in sorted(steps, key=lambda x: x[2:]):
        key = str(agent), day
        live[key] = live.get(key, 0) + d
        over[key] = over.get(key, 0) + (d > 0 and live[key] > 5)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    for rows in (registry.QUERIES["concurrency_caps"](spark, str(tmp_path)).toPandas(), con.sql(registry.SQL["concurrency_caps"]).df()):
        assert {(r.agent_id, r.day): int(r.over) for r in rows.itertuples()} == over
