"""What a task takes on where tables are large."""

from fluxfield.operators import field, kernel
from fluxfield.plans import jobs, staging


def test_wide_cuts_scans_and_joined_partitions(spark):
    before = {k: spark.conf.get(k) for k in staging.PART_BYTES}
    with staging.wide(spark, 9 * staging.PART_ROWS):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
        assert {k: spark.conf.get(k) for k in staging.PART_BYTES} == {k: "16m" for k in before}
        with staging.wide(spark, 1):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    assert {k: spark.conf.get(k) for k in before} == before and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_sweep_writes_first_fields_wide(spark, monkeypatch):
    """The joins of first fields, which run as the state of the sweep is written, get partitions by the edges."""
    parts, add = [], staging.Rounds.add
    monkeypatch.setattr(staging, "PART_ROWS", 20)
    monkeypatch.setattr(kernel.Rounds, "add", lambda self, *a, **k: parts.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or add(self, *a, **k))
    edges = spark.range(300).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS weight")
    flow = jobs.gauge_sweep(edges, [1e-9, 0.5], ["sparse_dc", "raw"], 2)
    assert parts[0] == 15 and flow.curve.count() == 8
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and field.field_balance(flow.state).count() == 1
