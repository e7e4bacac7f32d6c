"""Writers that put rows in order."""

from fluxfield.plans import jobs
from fluxfield.sources import sinks


def test_rows_are_joined_once_before_they_are_ordered(spark, tmp_path, monkeypatch):
    """Ranges are found by a pass of their own, so what is put in order is a table, not the join."""
    plans, write = [], sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a, **k))
    state = spark.range(500).selectExpr("id * 3 AS node", "cast(id % 3 - 1 AS tinyint) AS value")
    sinks.write_state(state, jobs.node_index(state), str(tmp_path / "state"))
    changes = state.selectExpr("1 AS step", "node", "value AS prev", "cast(0 AS tinyint) AS new")
    sinks.write_defect_nodes(changes, jobs.node_index(state), str(tmp_path / "changes"))
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    rows = spark.read.parquet(str(tmp_path / "state"))
    assert rows.where("body_id <> node_index * 3 OR value <> node_index % 3 - 1").isEmpty() and rows.count() == 500
    assert spark.read.parquet(str(tmp_path / "changes")).where("step = 1 AND body_id = node_index * 3").count() == 500
