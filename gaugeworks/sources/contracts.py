"""Contracts of saved sets: typed tables, keys, references, rules, and rows made anew.

A set is saved with what its contract says of each table. On loading, a table of another
type, a row that is missing or changed, a key that repeats, an id that refers to nothing, a
broken rule, or a derived row that is not what the set's other tables give, is refused by
the name of the table and of what is wrong. All tests are aggregations and anti-joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators import physical, profiles, reports

#: Raised whenever the meaning of a column changes.
VERSION = 1


class SetError(ValueError):
    """A set that does not keep its contract."""


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the key, references {column: (table, column)}, rules {name: when broken}."""

    columns: str
    key: tuple[str, ...]
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


_STATS = ", ".join(f"{c} {'long' if c.endswith('count') else 'double'}" for c in profiles.STATISTICS)
_COUNTS = {"counts add up": "total_count <> valid_count + missing_count", "quantiles rise": "q05 > q25 OR q25 > q50 OR q50 > q75 OR q75 > q95 OR minimum > q05 OR q95 > maximum"}
_GAPS = "mean_delta double, median_delta double, quantile_distance double, standardized_mean_shift double, valid_coverage double, gap_score double"
_CANDIDATE = "source string, candidate string, kind string, family string, metric string, raw_value double, confidence double, flags long"

CONTRACTS: dict[str, dict[str, Table]] = {
    "items": {
        "event": Table("event_id string, start_beats double, duration_beats double, midi_note int", ("event_id",), rules={"a duration is not negative": "duration_beats < 0"}),
        "item": Table(
            "id long, key string, role string, kind string, parent_id long, start_sample long, end_sample long, confidence double, locked boolean, excluded boolean",
            ("id",),
            {"parent_id": ("item", "id")},
            {"an item ends behind its start": "end_sample < start_sample", "confidence is a share": "confidence < 0 OR confidence > 1", "no item is its own parent": "parent_id = id"},
        ),
        "member": Table("item_id long, event_id string, `order` int, role string", ("item_id", "order"), {"item_id": ("item", "id"), "event_id": ("event", "event_id")}),
    },
    "measurements": {
        "measure": Table(
            "item_id long, kind string, `index` long, unit string, view string, status string, value double, confidence double, flags int",
            ("item_id", "kind", "index", "view"),
            rules={"a value is there where it is valid": "(status = 'VALID') <> (value IS NOT NULL)", "confidence is a share": "confidence < 0 OR confidence > 1"},
        ),
        "group": Table("id long, key string, selector string, value string, member_count long", ("id",)),
        "group_member": Table("group_id long, item_id long", ("group_id", "item_id"), {"group_id": ("group", "id")}),
        "statistic": Table(f"group_id long, kind string, `index` long, unit string, view string, {_STATS}", ("group_id", "kind", "index", "view"), {"group_id": ("group", "id")}, _COUNTS),
    },
    "comparison": {
        "distribution": Table(f"side string, `group` string, kind string, `index` long, {_STATS}", ("side", "group", "kind", "index"), rules={"a side is reference or model": "side NOT IN ('reference', 'model')", **_COUNTS}),
        "gap": Table(f"`group` string, kind string, `index` long, {_GAPS}, rank long", ("group", "kind", "index")),
    },
    "physical": {
        "check": Table(
            "scope string, case string, kind string, reference_value double, model_value double, delta double, availability string",
            ("scope", "case", "kind"),
            rules={"a delta is there where it is available": "(availability = 'AVAILABLE') <> (delta IS NOT NULL)", "a delta is model less reference": "abs(delta - (model_value - reference_value)) > 2e-6"},
        ),
        "finding": Table(
            "scope string, case string, kind string, reference_value double, model_value double, delta double, availability string, score double, class string, code string, severity string, finding long",
            ("scope", "case", "kind"),
            {},
        ),
    },
    "gap_report": {
        "case": Table(f"{_CANDIDATE}, case_id string, value double, case_score double", ("source", "candidate", "kind", "family", "case_id")),
        "candidate": Table(f"{_CANDIDATE}, occurrence double, size double, audibility double, confidence_factor double, score double, `primary` boolean, rank long", ("source", "candidate", "kind", "family")),
    },
}


def _gaps(tables: dict[str, DataFrame]) -> DataFrame:
    keys = ["group", "kind", "index"]
    side = lambda s: tables["distribution"].filter(F.col("side") == s).drop("side")
    return profiles.rank_gaps(profiles.gaps(side("reference"), side("model"), keys), keys)


def _groups(tables: dict[str, DataFrame]) -> DataFrame:
    members = tables["group_member"].groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return tables["group"].drop("member_count").join(members, "id", "left").withColumn("member_count", F.coalesce("n", F.lit(0)))


#: The tables that follow from others of their set.
DERIVED: dict[str, dict[str, Callable[[dict[str, DataFrame]], DataFrame]]] = {
    "measurements": {"group": _groups},
    "comparison": {"gap": _gaps},
    "physical": {"finding": lambda t: physical.findings(t["check"])},
    "gap_report": {"candidate": lambda t: reports.primaries(reports.score_candidates(t["case"]))},
}


def _first(df: DataFrame, columns) -> str | None:
    row = df.select(*columns).limit(1).collect()
    return None if not row else ", ".join(f"{c}={v}" for c, v in row[0].asDict().items())


def _quoted(names) -> list[str]:
    return [f"`{n}`" for n in names]


def _refuse(table: str, what: str, row: str | None = "") -> None:
    if row is not None:
        raise SetError(f"{table}: {what}" + (f" ({row})" if row else ""))


def _typed(kind: str, name: str, df: DataFrame) -> DataFrame:
    """The columns of the contract, in its order; refuses others, and other types."""
    want = CONTRACTS[kind][name].schema
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in want.fields:
        if f.name not in have:
            _refuse(f"{kind}.{name}", f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            _refuse(f"{kind}.{name}", f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    for extra in set(have) - set(want.names):
        _refuse(f"{kind}.{name}", f"column {extra} is not known")
    return df.select(*_quoted(want.names))


def differing(saved: DataFrame, derived: DataFrame, key: list[str], slack: float = 1e-9) -> DataFrame:
    """Keys of rows that only one of two tables has, or whose values differ: numbers by more
    than ``slack``, anything else at all."""
    rest = [c for c in saved.columns if c not in key]
    a = saved.select(*_quoted(key), F.struct(*_quoted(rest)).alias("_a"))
    b = derived.select(*_quoted(key), F.struct(*_quoted(rest)).alias("_b"))
    on = None
    for c in key:
        test = a[f"`{c}`"].eqNullSafe(b[f"`{c}`"])
        on = test if on is None else on & test
    both = a.join(b, on, "full")
    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    for c in rest:
        x, y = F.col("_a")[c], F.col("_b")[c]
        number = isinstance(saved.schema[c].dataType, T.DoubleType)
        near = F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).otherwise(F.abs(x - y) <= slack) if number else F.lit(False)
        wrong = wrong | ~(x.eqNullSafe(y) | F.coalesce(near, F.lit(False)))
    return both.filter(wrong).select(*[F.coalesce(a[f"`{c}`"], b[f"`{c}`"]).alias(c) for c in key])


def verify(kind: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with their columns in order, if they keep the contract of their kind."""
    contract = CONTRACTS[kind]
    for name in contract:
        if name not in tables:
            _refuse(f"{kind}.{name}", "the table is missing")
    for name in set(tables) - set(contract):
        _refuse(f"{kind}.{name}", "the table is not known")
    tables = {name: _typed(kind, name, tables[name]) for name in contract}
    for name, table in contract.items():
        df, label = tables[name], f"{kind}.{name}"
        key = _quoted(table.key)
        _refuse(label, "a key repeats", _first(df.groupBy(*key).count().filter("count > 1"), key))
        for rule, broken in table.rules.items():
            _refuse(label, rule, _first(df.filter(broken), key))
        for column, (other, target) in table.refs.items():
            # an id that refers to itself through another row is one, too; null refers to nothing
            ids = tables[other].select(F.col(f"`{target}`").alias("_id"))
            lost = df.filter(F.col(f"`{column}`").isNotNull()).join(ids, F.col(f"`{column}`") == F.col("_id"), "left_anti")
            _refuse(label, f"{column} refers to no {other}", _first(lost, key))
    for name, make in DERIVED.get(kind, {}).items():
        want = make(tables)
        want = want.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in contract[name].schema.fields])
        key = list(contract[name].key)
        _refuse(f"{kind}.{name}", "a row is not what the set gives", _first(differing(tables[name], want, key), _quoted(key)))
    return tables


def _digest(df: DataFrame) -> DataFrame:
    """Number of rows and a sum of their hashes, in no order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*_quoted(df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def save_set(kind: str, tables: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    """Check a set and write it; the contract's table comes last, so that a set without one
    was never finished. An existing set is only replaced when asked."""
    tables = verify(kind, tables)
    spark = next(iter(tables.values())).sparkSession
    if not replace and _saved(spark, kind, path) is not None:
        raise SetError(f"{kind}: {path} has one already")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
    written = [_digest(spark.read.schema(df.schema).parquet(f"{path}/{kind}/{name}")).select(F.lit(VERSION).alias("version"), F.lit(name).alias("table"), F.lit(CONTRACTS[kind][name].columns).alias("columns"), "rows", "digest") for name, df in tables.items()]
    reports.union(written).coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}/contract")


def _saved(spark: SparkSession, kind: str, path: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        return {r["table"]: r for r in spark.read.parquet(f"{path}/{kind}/contract").collect()}
    except AnalysisException:
        return None


def load_set(spark: SparkSession, kind: str, path: str) -> dict[str, DataFrame]:
    """A saved set, after its contract: version, columns, rows as they were written, keys,
    references, rules, and derived tables as its others give them."""
    saved = _saved(spark, kind, path)
    if saved is None:
        raise SetError(f"{kind}: no finished set in {path}")
    tables = {}
    for name, table in CONTRACTS[kind].items():
        label = f"{kind}.{name}"
        if name not in saved:
            _refuse(label, "the table is missing")
        if saved[name]["version"] != VERSION:
            _refuse(label, f"version {saved[name]['version']} is not {VERSION}")
        if saved[name]["columns"] != table.columns:
            _refuse(label, "it was saved with other columns")
        df = _typed(kind, name, spark.read.parquet(f"{path}/{kind}/{name}"))
        now = _digest(df).first()
        if (now["rows"], now["digest"]) != (saved[name]["rows"], saved[name]["digest"]):
            _refuse(label, "rows are not those that were saved")
        tables[name] = df
    return verify(kind, tables)
