"""Registered queries against their DuckDB oracles at sf0.001 (the driver does this at sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from martlens.registry import load_all

from .conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
FAST = ["q1_headline", "q1_monthly", "q2_store_ranking", "q3_channel_mix", "q4_product_ranking",
        "q6_day_type", "q7_festive_uplift", "q5_city_trend", "q8_store_diagnosis", "mart_store_month",
        "metric_line_by_category", "group_shares", "quality_report", "entity_resolution_exact_tiers",
        "claim_unsupported_figures", "t01_admission", "t02_breaker_intervals", "verify_top5_question"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    assert not any(name.startswith("op") or "pipeline" in name for name in load_all())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "declined_every_month" in df.columns
