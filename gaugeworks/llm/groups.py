"""Grouping helpers that no hot key can stall: salted group statistics, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import discard, partitions, settle


def with_group(rows: DataFrame, keys: list[str], **stats) -> DataFrame:
    """``rows`` with statistics of their group: name=(aggregate, merge, column).

    Each group's rows are dealt to as many salts as there are shuffle partitions, summed
    per salt, then per group; the group's row returns to each of its salts and from there
    to the rows. ``rows`` is evaluated twice, so it should be a settled table or cheap.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(partitions(rows.sparkSession))).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[agg(col).alias(name) for name, (agg, _, col) in stats.items()])
    whole = part.groupBy(*keys).agg(*[merge(F.col(name)).alias(name) for name, (_, merge, _) in stats.items()])
    back = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the least node it reaches.

    Each round a node takes the least label among its own, its neighbours' and that of its
    label, so long chains shorten by half; each round is settled. Joins have a plain table
    on either side, so that a hot node's rows can be split at run time.
    """
    both = settle(links.select(F.col("a"), F.col("b")).union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
        old = labels.select(F.col("node"), F.col("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = old.join(up, "root").select("node", F.least("root", "above").alias("root"))
        new = settle(reduce(DataFrame.union, [old, told, jumped]).groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("most")))
        moved = new.filter(F.col("root") != F.col("most")).limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            out = labels.select("node", "root")
            out._gw_path = labels._gw_path
            return out


def pa_types(schema) -> list:
    """The Arrow type of each field of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


#: Bytes of binary values at which a block is closed, and at which finished blocks are handed on.
BLOCK_BYTES = 1 << 22


def blocks_of(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` gathered into blocks of ``size`` rows at most with the same ``keys``:
    the keys, ``block`` (a number of its own) and an array for each other column. A block
    ends sooner where its binary values reach ``BLOCK_BYTES``.

    Rows are range-sorted on keys and order, so a hot key spans many tasks.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    others = [c for c in rows.columns if c not in keys]
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("block", T.LongType())]
        + [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in others]
    )

    types = pa_types(schema)

    def gather(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        done: list = []
        kept: list = []
        last = None
        here = held = 0

        def flush():
            nonlocal held
            columns = list(zip(*done))
            done.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        def close():
            nonlocal number, here, held
            held, here = held + here, 0
            done.append((*last, number, *[list(c) for c in zip(*kept)]))
            number += 1
            kept.clear()

        for batch in batches:
            heads, rest = [batch.column(k).to_pylist() for k in keys], [batch.column(c).to_pylist() for c in others]
            for key, row in zip(zip(*heads), zip(*rest)):
                if kept and (key != last or len(kept) == size or here >= BLOCK_BYTES):
                    close()
                    if len(done) == 64 or held >= BLOCK_BYTES:
                        yield flush()
                last = key
                kept.append(row)
                here += sum(len(v) for v in row if isinstance(v, bytes))
        if kept:
            close()
        if done:
            yield flush()

    sorted_rows = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(gather, schema)
