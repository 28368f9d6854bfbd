"""Registered queries against their SQL on the smallest tables (all of them: verify.py)."""

import os

import pytest

import verify

SF = "/root/testdata/sf0.001"
NAMES = ("f1_f4_rolling_form", "f7_f12_starter_form", "f20_split_offense", "f32_market_prior", "j6_asof_probable", "j7_asof_set", "j14_nearest_match", "w7_v7_gaps", "m4_m11_analyse", "v2_a18_monthly_performance", "u8_append_set_on_change", "r4_boxscore_pitching", "r5_boxscore_batting", "r6_boxscore_lineup", "m13_m15_no_bet", "f16_bullpen_depletion", "f25_star_out", "u9_u10_identity", "u9_u10_identity_all", "j15_assignment")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    from tidemark import plans

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    cur = con.execute(plans.ORACLE[name])
    assert verify.rows(df.columns, [tuple(r) for r in df.collect()]) == verify.rows([c[0] for c in cur.description], cur.fetchall())


def test_no_range_or_cross_joins(spark):
    """As-of plans hold no nested loops: one shuffle on the key each."""
    from tidemark import plans

    for name in ("f1_f4_rolling_form", "f17_f19_offense", "j6_asof_probable", "j13_siblings", "j14_nearest_match", "w7_v7_gaps"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
