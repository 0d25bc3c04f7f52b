"""Saved sets: what keeps its contract comes back, anything else is refused by name."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import physical, profiles, reports
from gaugeworks.sources import contracts as C


def distributions(spark):
    obs = spark.range(200).selectExpr("CASE WHEN id % 2 = 0 THEN 'reference' ELSE 'model' END AS side", "concat('g', id % 5) AS `group`", "'rms' AS kind", "0L AS `index`", "CAST(id * id % 37 AS DOUBLE) AS value", "1.0D AS confidence")
    return profiles.distributions(obs, ["side", "group", "kind", "index"])


def comparison(spark):
    d = distributions(spark).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in C.CONTRACTS["comparison"]["distribution"].schema.fields])
    gaps = C._gaps({"distribution": d})
    return {"distribution": d, "gap": gaps.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in C.CONTRACTS["comparison"]["gap"].schema.fields])}


def items(spark):
    schema = C.CONTRACTS["items"]
    return {
        "event": spark.createDataFrame([("e1", 0.0, 1.0, 60), ("e2", 1.0, 1.0, None)], schema["event"].schema),
        "item": spark.createDataFrame([(1, "k", "note", "note", None, 0, 10, 0.5, False, False), (2, "k2", "attack", "note", 1, 0, 4, 1.0, True, False)], schema["item"].schema),
        "member": spark.createDataFrame([(1, "e1", 0, "lead"), (1, "e2", 1, "lead")], schema["member"].schema),
    }


def measurements(spark):
    schema = C.CONTRACTS["measurements"]
    stats = distributions(spark).filter("side = 'model' and `group` = 'g1'").select(F.lit(1).cast("long").alias("group_id"), "kind", "index", F.lit("dB").alias("unit"), F.lit("ABSOLUTE").alias("view"), *profiles.STATISTICS)
    return {
        "measure": spark.createDataFrame([(1, "rms", 0, "dB", "ABSOLUTE", "VALID", 1.0, 1.0, 0), (2, "rms", 0, "dB", "ABSOLUTE", "NO_DATA", None, 1.0, 0)], schema["measure"].schema),
        "group": spark.createDataFrame([(1, "a", "part", "x", 2), (2, "b", "part", "y", 0)], schema["group"].schema),
        "group_member": spark.createDataFrame([(1, 1), (1, 2)], schema["group_member"].schema),
        "statistic": stats.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema["statistic"].schema.fields]),
    }


def gap_report(spark):
    rows = [("s", f"c{k}", "gap", "fam" if k < 3 else "other", "pitch", 0.1 * k, 0.9, 0, f"case{j}" if k else None, 0.05 * k * j if k else None, None) for k in range(6) for j in range(3 if k else 1)]
    cases = spark.createDataFrame(rows, C.CONTRACTS["gap_report"]["case"].schema)
    made = reports.primaries(reports.score_candidates(cases))
    return {"case": cases, "candidate": made.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in C.CONTRACTS["gap_report"]["candidate"].schema.fields])}


def checks(spark):
    rows = [("scan", "a", "shared_gain_db", -3.0, -9.0, -6.0, "AVAILABLE"), ("scan", "a", "clipped_fraction", 0.0, None, None, "UNAVAILABLE"), ("scan", "b", "clip_fraction", 0.0, 0.5, 0.5, "AVAILABLE")]
    table = spark.createDataFrame(rows, C.CONTRACTS["physical"]["check"].schema)
    found = physical.findings(table)
    return {"check": table, "finding": found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in C.CONTRACTS["physical"]["finding"].schema.fields])}


SETS = {"comparison": comparison, "items": items, "measurements": measurements, "gap_report": gap_report, "physical": checks}


@pytest.mark.parametrize("kind", sorted(SETS))
def test_what_is_saved_comes_back(spark, tmp_path, kind):
    tables = SETS[kind](spark)
    C.save_set(kind, tables, str(tmp_path))
    back = C.load_set(spark, kind, str(tmp_path))
    assert set(back) == set(C.CONTRACTS[kind])
    for name, df in back.items():
        assert df.columns == C.CONTRACTS[kind][name].schema.names and df.count() == tables[name].count()
    with pytest.raises(C.SetError, match="already"):
        C.save_set(kind, tables, str(tmp_path))
    C.save_set(kind, tables, str(tmp_path), replace=True)


def broken(kind, table, change, spark):
    tables = SETS[kind](spark)
    return {**tables, table: change(tables[table])}


BROKEN = [
    ("items", "member", lambda d: d.withColumn("item_id", F.col("item_id") + 7), "items.member: item_id refers to no item"),
    ("items", "item", lambda d: d.withColumn("parent_id", F.lit(9).cast("long")), "items.item: parent_id refers to no item"),
    ("items", "item", lambda d: d.withColumn("end_sample", F.lit(-1).cast("long")), "an item ends behind its start"),
    ("items", "item", lambda d: d.withColumn("confidence", F.col("confidence").cast("float")), "confidence is float, not double"),
    ("items", "event", lambda d: d.union(d), "items.event: a key repeats"),
    ("items", "event", lambda d: d.drop("midi_note"), "column midi_note is missing"),
    ("items", "event", lambda d: d.withColumn("more", F.lit(1)), "column more is not known"),
    ("measurements", "group", lambda d: d.withColumn("member_count", F.col("member_count") + 1), "measurements.group: a row is not what the set gives"),
    ("measurements", "group_member", lambda d: d.limit(1), "measurements.group: a row is not what the set gives"),
    ("measurements", "statistic", lambda d: d.withColumn("q25", F.col("q75") + 1), "quantiles rise"),
    ("measurements", "measure", lambda d: d.withColumn("value", F.lit(1.0)), "a value is there where it is valid"),
    ("comparison", "gap", lambda d: d.withColumn("gap_score", F.col("gap_score") + 0.01), "comparison.gap: a row is not what the set gives"),
    ("comparison", "gap", lambda d: d.withColumn("rank", F.col("rank") % 5 + 1), "comparison.gap: a row is not what the set gives"),
    ("comparison", "gap", lambda d: d.filter("rank > 1"), "comparison.gap: a row is not what the set gives"),
    ("comparison", "distribution", lambda d: d.withColumn("mean", F.col("mean") * 2), "comparison.gap: a row is not what the set gives"),
    ("gap_report", "candidate", lambda d: d.withColumn("primary", ~F.col("primary")), "gap_report.candidate: a row is not what the set gives"),
    ("physical", "check", lambda d: d.withColumn("delta", F.col("delta") + 1), "a delta is model less reference"),
    ("physical", "finding", lambda d: d.withColumn("severity", F.lit("INFO2")), "physical.finding: a row is not what the set gives"),
]


@pytest.mark.parametrize("kind,table,change,what", BROKEN)
def test_what_breaks_a_contract_is_refused(spark, tmp_path, kind, table, change, what):
    with pytest.raises(C.SetError, match=what):
        C.save_set(kind, broken(kind, table, change, spark), str(tmp_path))


def test_files_changed_after_saving_are_refused(spark, tmp_path):
    C.save_set("comparison", comparison(spark), str(tmp_path))
    path = f"{tmp_path}/comparison/gap"
    rows = spark.createDataFrame(spark.read.parquet(path).collect(), C.CONTRACTS["comparison"]["gap"].schema)
    rows.withColumn("gap_score", F.col("gap_score") + 1e-6).write.mode("overwrite").parquet(path)
    with pytest.raises(C.SetError, match="comparison.gap: rows are not those that were saved"):
        C.load_set(spark, "comparison", str(tmp_path))
    with pytest.raises(C.SetError, match="no finished set"):
        C.load_set(spark, "items", str(tmp_path))


def test_versions_and_columns_of_old_sets_are_refused(spark, tmp_path, monkeypatch):
    C.save_set("items", items(spark), str(tmp_path))
    monkeypatch.setattr(C, "VERSION", 2)
    with pytest.raises(C.SetError, match="version 1 is not 2"):
        C.load_set(spark, "items", str(tmp_path))
