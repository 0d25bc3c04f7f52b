"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local is a temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gw-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gw-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gw_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``settle`` wrote for the tables, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_gw_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> F.Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``; ``run`` finds its columns by place, so that they may
    have any names."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def pieces(texts: list, rows: int, characters: int):
    """(place, texts) of runs of at most ``rows`` texts that end where ``characters`` are
    reached, so that memory is bounded by them and the longest text."""
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if k + 1 - at == rows or size >= characters or k + 1 == len(texts):
            yield at, texts[at : k + 1]
            at, size = k + 1, 0


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether two rows have one id; nulls are one id, too."""
    return bool(docs.groupBy(column(id_col)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())


def row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a further column that names one row, and that column's name: the id or,
    only where ids repeat, the id and a number of the row in a settled copy of ``docs``.
    Such keys are in the order of ids, null ids last. No group of rows with one id is
    gathered anywhere, so any share of the rows may have it."""
    key, id_ = fresh(docs, "_key"), column(id_col)
    if not ids_repeat(docs, id_col):
        return docs.withColumn(key, id_), key
    return settle(docs.withColumn(key, F.struct(id_.isNull().alias("none"), id_.alias("id"), F.monotonically_increasing_id().alias("row")))), key


def keep_rows(keyed: DataFrame, key: str, decided: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key ``decided`` (doc_id, kept) keeps, without the key."""
    name = fresh(keyed, "_keep")
    kept = settle(decided.filter("kept").select(F.col("doc_id").alias(name)))
    # the kept ids grow with the corpus: never broadcast, whatever their size here
    return keyed.join(kept.hint("merge"), keyed[key].eqNullSafe(kept[name]), "left_semi").drop(key)
