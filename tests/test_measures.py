"""The measurement catalogue: what moves between tasks."""

from gaugeworks.operators import measures


def test_rows_of_kinds_stay_where_they_are_made(spark):
    """An item's facts meet its aggregates: its hundreds of rows are in no shuffle."""
    frames = spark.range(40).selectExpr(
        "id DIV 20 AS item", "id % 20 * 1.0D AS t", "0.1D AS x2", "0.3D AS top", "-10.0D AS level", "500.0D AS centroid", "0.1D AS flatness", "0.1D AS flux", "440.0D AS pitch", "440.0D AS target",
        "false AS fault", "-12.0D AS harmonic", "-30.0D AS residual", "0.0D AS source_start", "0L AS start_sample", "48000L AS end_sample", "48000.0D AS rate",
    )
    bands = frames.selectExpr("item", "t", "explode(array(0L, 1L)) AS band", "level", "residual")
    partials = frames.selectExpr("item", "t", "explode(array(1L, 2L)) AS partial", "0.0D AS cents", "level", "0.1D AS power")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = measures.measure(frames, bands, partials, frames.select("item", "x2").filter("item < 0"))
        above = found._jdf.queryExecution().executedPlan().toString().split("Union")[0]
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in above
    orders = sorted((r["item"], r["index"], r["value"]) for r in rows if r["kind"] == "partial_onset_order")
    assert orders == [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 1.0), (1, 2, 2.0)]
    assert len(rows) == 2 * (len(measures.FRAME_KINDS) + 1 + len(measures.ATTACK_KINDS) + 2 * len(measures.BAND_KINDS) + 2 * len(measures.PARTIAL_KINDS) + 2 + len(measures.HARMONIC_KINDS)) + sum(
        r["view"] == "LEVEL_RELATIVE" for r in rows
    )
