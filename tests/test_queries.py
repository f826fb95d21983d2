"""Every transit query against DuckDB at sf0.001, and properties of the results."""

import math
import os

import pytest

from headway.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


def test_every_query_has_sql_but_the_model():
    assert set(QUERIES) - set(ORACLE_SQL) == {"q_ae_score", "q_ae_reject", "q_sketch_baseline"}


def test_the_model_rejects_what_numpy_would(spark):
    """q_ae_score and q_ae_reject from the windows as SQL makes them, the model's own numpy and numpy's quantile."""
    import numpy as np

    from headway.operators import anomaly
    from headway.plans import queries

    rows = queries.windows(spark, SF).select("vehicle_id", "fix_id", "history", "xs").collect()
    model = anomaly.fit_autoencoder(queries.windows(spark, SF).filter("history"))
    errors = dict(zip([(r["vehicle_id"], r["fix_id"]) for r in rows], model.mse(np.array([r["xs"] for r in rows])).tolist()))
    past = {(r["vehicle_id"], r["fix_id"]) for r in rows if r["history"]}
    score = {(r["vehicle_id"], r["end_fix_id"]): r["mse"] for r in QUERIES["q_ae_score"](spark, SF).collect()}
    assert score == pytest.approx({k: v for k, v in errors.items() if k not in past})
    cut = round(float(np.quantile([errors[k] for k in past], 0.99)), 6)
    kept = {(r["vehicle_id"], r["fix_id"]) for r in QUERIES["q_ae_reject"](spark, SF).collect()}
    everything = {(r["vehicle_id"], r["fix_id"]) for r in QUERIES["q_stop_state"](spark, SF).collect()}
    assert everything - kept == {k for k, v in errors.items() if v > cut} != set()


def test_flagship_properties(spark):
    rows = QUERIES["q_flagship"](spark, SF).orderBy("vehicle_id", "seg_seq").collect()
    assert rows
    for a, b in zip(rows, rows[1:]):
        if a["vehicle_id"] == b["vehicle_id"]:
            assert b["eta_s"] >= a["eta_s"] and b["delay_after"] <= a["delay_after"]
    assert all(r["eta_s"] >= 0 and r["recovery"] >= 0 for r in rows)
    of = {}
    for r in rows:
        of[r["vehicle_id"]] = of.get(r["vehicle_id"], 0) + r["recovery"]
    assert all(of[r["vehicle_id"]] <= max(0, r["total_ms"]) / 1000 + 1e-4 for r in rows)


def test_percentiles_stay_in_range(spark):
    assert QUERIES["q_raw_pct"](spark, SF).filter("raw_pct < 0 or raw_pct > 100 or raw_pct is null").count() == 0


def test_few_shuffles(spark):
    """One shuffle by vehicle for the smoothing, the channels and the sums; one for all pairs of the grid, and the counts."""
    from headway.plans import queries

    assert exchanges(queries.delayed(spark, SF)) <= exchanges(queries.scored(spark, SF)) + 1
    assert exchanges(QUERIES["q_threshold_grid"](spark, SF)) <= 3


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_one_baseline_and_no_job_while_a_plan_is_built(spark):
    """A set of quantiles is one plan without a job of its own; the flagship's plan holds no second baseline."""
    from headway.plans import queries

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    rows = queries.baseline(spark, SF)
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("other", "")
    rows.collect()
    ran = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("Exchange hashpartitioning") - ran.count("ReusedExchange") <= 6
    assert exchanges(QUERIES["q_flagship"](spark, SF)) <= 10


def test_prepared_points_are_shuffled_once(spark):
    """The points that rejection leaves are read with their errors, without a join, and only the stops shuffle them; no row holds its window."""
    from headway.operators import prep
    from headway.plans import prepared, queries
    from headway.sources import fixes as src

    found = prepared.prepare(src.line_fixes(queries.base(spark, SF)), src.line_segments(spark), queries.STEP_S, queries.REJECT, prep.persistence_error, clean=None)
    assert exchanges(found.grid) == 0 and exchanges(found.episodes) == 1
    assert "collect_list" not in queries.persistence(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q_route_filter"](spark, SF)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan") :]
    assert "EqualTo(event_type,click)" in scan and "props" not in scan.split("ReadSchema")[1]
