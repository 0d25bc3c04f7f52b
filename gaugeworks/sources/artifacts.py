"""Saved results: a folder of Parquet tables for each set, exports and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of each kind of set.
TABLES = {
    "alignment": ("meta", "anchor", "match", "unmatched", "warning"),
    "items": ("event", "item", "member"),
    "measurements": ("context", "measure", "group", "group_member", "statistic"),
    "comparison": ("distribution", "gap"),
    "physical": ("check", "finding"),
    "production": ("span", "fit", "evaluation", "view"),
    "run": ("source", "clock", "feature", "stage", "probe", "link"),
    "experiment": ("parameter", "level", "case", "point", "value", "job", "observation", "candidate", "sensitivity", "interaction"),
    "gap_report": ("label", "candidate", "family", "group", "case", "excerpt", "warning"),
}


def save(kind: str, tables: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    """Write a set's tables; an existing one is only replaced when asked."""
    unknown = set(tables) - set(TABLES[kind])
    if unknown:
        raise ValueError(f"{kind} has no table {sorted(unknown)[0]}")
    for name, df in tables.items():
        df.write.mode("overwrite" if replace else "error").parquet(f"{path}/{kind}/{name}")


def load(spark: SparkSession, kind: str, path: str, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{kind}/{name}") for name in names or TABLES[kind]}


def export_frames(frames: DataFrame, path: str) -> None:
    """Frame tracks as CSV; what is not valid is an empty cell, arrays spread to columns."""
    wide = [F.col(f"{c}")[k].alias(f"{c}_{k}_db") for c, t in frames.dtypes if t.startswith("array") for k in range(10)]
    plain = [c for c, t in frames.dtypes if not t.startswith("array")]
    frames.select(*plain, *wide).write.csv(path, header=True, emptyValue="", nullValue="")


def export_spectrogram(spectrogram: DataFrame, path: str, rate: float, frame_size: int) -> None:
    """(time_seconds, power) as long CSV rows time_seconds, frequency_hz, power_db."""
    rows = spectrogram.select("time_seconds", F.posexplode("power").alias("k", "power_db"))
    rows.select("time_seconds", (F.col("k") * rate / frame_size).alias("frequency_hz"), "power_db").write.csv(path, header=True)


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest differs, or that only one side has."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    return a.join(b, "path", "full").filter(~F.col("was").eqNullSafe(F.col("now")))


def _shown(df: DataFrame, most: int) -> tuple[list, int]:
    """(first rows, number of all rows), by rank where there is one, then by the columns in turn."""
    order = [c for c, t in df.dtypes if c == "rank"] + [c for c, t in df.dtypes if c != "rank" and "map<" not in t]
    return df.orderBy(*order).limit(most).collect(), df.count()


def report_html(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report page of tables: each shows its first ``most`` rows and how many there are; the
    whole tables are in the saved set."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows, total = _shown(df, most)
        out.append(f"<h2>{html.escape(name)}</h2><p>{len(rows)} of {total} rows</p><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        for row in rows:
            out.append("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in row) + "</tr>")
        out.append("</table>")
    return "".join(out) + "</body></html>"


def report_json(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """As ``report_html``; ``total_rows`` says how many rows each section has in all."""
    shown = {name: _shown(df, most) for name, df in sections.items()}
    whole = {"title": title, "total_rows": {name: total for name, (_, total) in shown.items()}}
    return json.dumps(whole | {name: [r.asDict(True) for r in rows] for name, (rows, _) in shown.items()}, default=str)
