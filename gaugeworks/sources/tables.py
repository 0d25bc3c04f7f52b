"""Scores, labels, probes and manifests: explicit schemas, faults named at reading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of score and label files, in order.
SCORE = (
    "event_id string, kind string, start_beats double, duration_beats double, midi_note int, velocity int, voice string, tie string, "
    "dynamic string, mark string, score_position string, tempo_bpm double"
)
LABELS = "event_id string, " + ", ".join(
    f"{c} string" for c in ("pitch", "register", "dynamic", "articulation", "part", "physical_element", "controller", "technique", "score_section", "transition", "gesture")
)
PROBE = "index long, value double"
RUN_MANIFEST = """schema string, schema_version string, method_version string, clock_rate_hz long,
    stems array<struct<id: string, side: string, role: string, sha256: string, start_sample: long, gain_db: double, rate_hz: long, channels: int>>,
    probes array<struct<id: string, name: string, unit: string, format: string, rate_numerator: long, rate_denominator: long, start_sample: long, sha256: string>>,
    links array<struct<stem: string, probe: string, feature: string>>"""
EXPERIMENT_MANIFEST = """schema string, schema_version string, method_version string, inputs array<struct<id: string, sha256: string>>,
    parameters array<struct<id: string, unit: string, minimum: double, maximum: double, baseline: double, levels: array<double>>>,
    plan struct<kind: string, seed: long, sample_count: long, replicates: long>,
    cases array<struct<id: string, split: string, weight: double>>, responses array<struct<id: string, role: string, feature: string, index: int>>"""
GAP_MANIFEST = """schema string, schema_version string, title string, audibility_method string, sources array<struct<id: string, kind: string, sha256: string>>,
    case_labels array<struct<source: string, case: string, pitch: string, register: string, dynamic: string, gesture: string, element: string, section: string>>,
    excerpts array<struct<candidate: string, start_sample: long, end_sample: long>>"""
KINDS = ("note", "rest", "tempo", "ornament", "cadenza")


class InputError(ValueError):
    """An input that breaks a rule; the message names the rule and the first offender."""


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False, quote='"', escape='"')


def _refuse(rows: DataFrame, key: str, rule: str) -> None:
    bad = rows.select(key).limit(1).collect()
    if bad:
        raise InputError(f"{rule}: {bad[0][0]}")


def read_score(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    rows = _csv(spark, path, SCORE)
    return check_score(rows) if check else rows


def check_score(rows: DataFrame) -> DataFrame:
    """``rows`` if ids are unique, kinds known, tie chains whole and tempo set at beat 0."""
    _refuse(rows.groupBy("event_id").count().filter("count > 1"), "event_id", "event ids must be unique")
    _refuse(rows.filter(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()), "event_id", "unknown kind")
    _refuse(rows.filter("start_beats is null or start_beats < 0 or duration_beats < 0"), "event_id", "beats must not be negative")
    w = W.partitionBy("voice", "midi_note").orderBy("start_beats", "event_id")
    notes = rows.filter("kind = 'note'").withColumn("before", F.lag("tie").over(w)).withColumn("after", F.lead("tie").over(w))
    ends = F.lag(F.col("start_beats") + F.col("duration_beats")).over(w)
    notes = notes.withColumn("gap", F.abs(F.col("start_beats") - ends) > 1e-9)
    going_on = F.col("tie").isin("continue", "stop")
    broken = (going_on & (~F.coalesce(F.col("before").isin("start", "continue"), F.lit(False)) | F.col("gap"))) | (
        F.col("tie").isin("start", "continue") & ~F.coalesce(F.col("after").isin("continue", "stop"), F.lit(False))
    )
    _refuse(notes.filter(broken), "event_id", "a tie chain is broken")
    tempo = rows.filter("kind = 'tempo'")
    if not tempo.filter("start_beats = 0 and tempo_bpm > 0").limit(1).count():
        raise InputError("no tempo at beat 0")
    _refuse(tempo.filter("tempo_bpm is null or tempo_bpm <= 0"), "event_id", "tempo must be positive")
    return rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, LABELS)
    _refuse(rows.groupBy("event_id").count().filter("count > 1"), "event_id", "event ids must be unique")
    return rows


def with_labels(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with their labels; a label wins over what the event itself says."""
    names = [c for c in labels.columns if c != "event_id"]
    joined = events.alias("e").join(labels.alias("l"), "event_id", "left")
    pick = lambda c: F.coalesce(F.col(f"l.{c}"), F.col(f"e.{c}")) if c in events.columns else F.col(f"l.{c}")
    return joined.select("event_id", *[F.col(f"e.{c}") for c in events.columns if c != "event_id" and c not in names], *[pick(c).alias(c) for c in names])


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """(index, value) of a CSV probe whose index runs densely from 0."""
    rows = _csv(spark, path, PROBE)
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("index").alias("d"), F.min("index").alias("a"), F.max("index").alias("b")).first()
    if ends["n"] and (ends["d"] != ends["n"] or ends["a"] != 0 or ends["b"] != ends["n"] - 1):
        raise InputError("the probe's index is not dense")
    return rows


def read_binary_probe(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, value) of files of little-endian doubles."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                if len(content) % 8:
                    raise InputError(f"not whole doubles: {name}")
                v = np.frombuffer(bytes(content), "<f8")
                yield pd.DataFrame({"path": name, "index": np.arange(len(v)), "value": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, index long, value double")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def _ids(array: str, field: str = "id") -> str:
    return f"transform(coalesce({array}, array()), e -> e.{field})"


def _repeats(values: str) -> str:
    return f"size(array_distinct({values})) < size({values})"


def _any(array: str, test: str) -> str:
    return f"exists(coalesce({array}, array()), e -> coalesce({test}, true))"


_STREAMS = f"concat({_ids('stems')}, {_ids('probes')})"
#: What breaks a manifest, by kind: the rule and when it is broken. A value that is missing breaks its rule.
RULES = {
    "run": {
        "the clock rate must be positive": "coalesce(clock_rate_hz <= 0, true)",
        "stem and probe ids must be unique": _repeats(_STREAMS),
        "a side is reference or model": _any("stems", "e.side NOT IN ('reference', 'model')"),
        "a role has one model stem": _repeats("transform(filter(coalesce(stems, array()), e -> e.side = 'model'), e -> e.role)"),
        "rates and channels must be positive": _any("stems", "e.rate_hz <= 0 OR e.channels <= 0"),
        "a link names a stem and a probe": _any("links", f"NOT array_contains({_ids('stems')}, e.stem) OR NOT array_contains({_ids('probes')}, e.probe)"),
        "links must be unique": _repeats("coalesce(links, array())"),
    },
    "experiment": {
        "input ids must be unique": _repeats(_ids("inputs")),
        "parameter ids must be unique": _repeats(_ids("parameters")),
        "case ids must be unique": _repeats(_ids("cases")),
        "response ids must be unique": _repeats(_ids("responses")),
        "a parameter's minimum is below its maximum": _any("parameters", "e.minimum >= e.maximum"),
        "a baseline lies between minimum and maximum": _any("parameters", "e.baseline NOT BETWEEN e.minimum AND e.maximum"),
        "levels lie between minimum and maximum": _any("parameters", "exists(coalesce(e.levels, array()), l -> l NOT BETWEEN e.minimum AND e.maximum)"),
        "levels hold the baseline": _any("parameters", "size(coalesce(e.levels, array())) > 0 AND NOT array_contains(e.levels, e.baseline)"),
        "a plan is a grid, one-at-a-time or random": "coalesce(plan.kind NOT IN ('grid', 'one-at-a-time', 'random'), true)",
        "replicates must be positive": "coalesce(plan.replicates <= 0, true)",
        "weights must be positive": _any("cases", "e.weight <= 0"),
        "a split is fit or check": _any("cases", "e.split NOT IN ('fit', 'check')"),
    },
    "gap_report": {
        "source ids must be unique": _repeats(_ids("sources")),
        "a case label names a source": _any("case_labels", f"NOT array_contains({_ids('sources')}, e.source)"),
        "a case has one label row": _repeats("transform(coalesce(case_labels, array()), e -> struct(e.source, e.case))"),
        "an excerpt ends after its start": _any("excerpts", "e.end_sample <= e.start_sample OR e.start_sample < 0"),
    },
}


def check_manifest(manifest: DataFrame, kind: str) -> DataFrame:
    """``manifest`` if it keeps the rules of its kind; else the first broken one is named."""
    rules = RULES[kind]
    broken = manifest.select(*[F.expr(test).alias(f"r{k}") for k, test in enumerate(rules.values())]).collect()
    for row in broken:
        for rule, bad in zip(rules, row):
            if bad:
                raise InputError(rule)
    return manifest


def entries(manifest: DataFrame, array: str) -> DataFrame:
    """One row for each entry of a manifest's array."""
    return manifest.select(F.inline(array))
