"""Score, label and item queries: orders stand for notes, lines for their parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import expr as E
from gaugeworks.functions.expr import tidy
from gaugeworks.operators import items as I
from gaugeworks.plans.registry import query, table


@query(
    "unit_conversions",
    """SELECT p_partkey, round(440 * pow(2, (p_size - 69) / 12), 6) AS hz, round(69 + 12 * log2(p_retailprice / 440), 6) + 0.0 AS midi, round(1200 * log2(p_retailprice / 1000), 6) + 0.0 AS cents,
              CASE WHEN p_retailprice * p_size < 60 THEN 0 WHEN p_retailprice * p_size < 120 THEN 1 WHEN p_retailprice * p_size < 250 THEN 2 WHEN p_retailprice * p_size < 500 THEN 3
              WHEN p_retailprice * p_size < 1000 THEN 4 WHEN p_retailprice * p_size < 2000 THEN 5 WHEN p_retailprice * p_size < 4000 THEN 6 WHEN p_retailprice * p_size < 8000 THEN 7
              WHEN p_retailprice * p_size < 16000 THEN 8 ELSE 9 END AS band, CAST(floor(p_size * 44.1 + 0.5) AS BIGINT) AS sample, round(10 * log10(p_retailprice / 1e4), 6) + 0.0 AS db,
              round(greatest(-3.0, least(3.0, (p_size - 25) / 5)), 6) + 0.0 AS clamped FROM part""",
)
def unit_conversions(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(E.midi_to_hz(size), 6).alias("hz"),
        tidy(E.hz_to_midi(price)).alias("midi"),
        tidy(E.cents(price, F.lit(1000.0))).alias("cents"),
        E.band(price * size).alias("band"),
        E.seconds_to_sample(size, 44.1).alias("sample"),
        tidy(E.power_db(price / 1e4)).alias("db"),
        tidy(E.clamp((size - 25) / 5, -3.0, 3.0)).alias("clamped"),
    )


@query(
    "tie_groups",
    """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS k, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS starts FROM orders
                  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
       g AS (SELECT *, sum(starts) OVER (PARTITION BY o_custkey ORDER BY k) AS note_group FROM n)
       SELECT o_custkey, CAST(note_group AS BIGINT) AS note_group, min(o_orderkey) FILTER (starts = 1) AS first_event, count(*) AS members FROM g GROUP BY o_custkey, note_group""",
)
def tie_groups(spark, sf_dir):
    return I.tie_groups(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "o_orderkey")


@query(
    "chord_buckets",
    """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 86400e6 AS beat FROM orders),
       n AS (SELECT *, CASE WHEN abs(beat - lag(beat) OVER w) < 15 THEN 0 ELSE 1 END AS turn FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY beat, o_orderkey)),
       g AS (SELECT *, sum(turn) OVER (PARTITION BY o_custkey ORDER BY beat, o_orderkey) AS chord FROM n)
       SELECT o_custkey, CAST(chord AS BIGINT) AS chord, count(*) AS notes, min(beat) AS beat FROM g GROUP BY o_custkey, chord HAVING count(*) > 1""",
)
def chord_buckets(spark, sf_dir):
    beat = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)") / 86400e6
    return I.chords(table(spark, sf_dir, "orders").withColumn("beat", beat), ["o_custkey"], "beat", "o_orderkey", 15.0)


@query(
    "label_override",
    """SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS label, c_mktsegment IS NOT NULL AS overridden, CASE WHEN c_mktsegment IS NOT NULL THEN 1 ELSE 0 END
              | CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS flags FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def label_override(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(labels, F.col("o_custkey") == F.col("c_custkey"), "left")
    over = F.col("c_mktsegment").isNotNull()
    flags = F.when(over, 1).otherwise(0).bitwiseOR(F.when(F.col("o_orderstatus") == "F", 2).otherwise(0))
    return rows.select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("label"), over.alias("overridden"), flags.alias("flags"))


@query(
    "item_edits",
    """SELECT p_partkey, CASE WHEN s_suppkey % 3 = 0 THEN 'noise' END AS exclusion_reason, coalesce(CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey END, p_size) AS end_bound, coalesce(s_suppkey % 3 = 1, false) AS locked
       FROM part LEFT JOIN supplier ON p_partkey = s_suppkey WHERE NOT coalesce(s_suppkey % 3 = 2, false)""",
)
def item_edits(spark, sf_dir):
    """Keyed edits: exclude an item, lock its bound, or remove it."""
    edits = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("item"), F.element_at(F.array(F.lit("exclude"), F.lit("lock"), F.lit("drop")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("action"), F.col("s_suppkey").alias("bound"), F.lit("noise").alias("reason")
    )
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("long").alias("end_bound"))
    return I.apply_edits(items, edits).select(F.col("item").alias("p_partkey"), "exclusion_reason", "end_bound", "locked")


@query(
    "availability",
    """SELECT c_custkey, 'available' AS state FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') UNION ALL
       SELECT c_custkey, 'unavailable' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
)
def availability(spark, sf_dir):
    cases, checks = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    some, none = cases.join(checks, "c_custkey", "left_semi"), cases.join(checks, "c_custkey", "left_anti")
    return some.withColumn("state", F.lit("available")).unionByName(none.withColumn("state", F.lit("unavailable")))


_TRAITS = """tw AS (SELECT p_brand AS element, l_returnflag AS side, [avg(l_quantity) / 10, avg(l_extendedprice) / 10000, avg(l_discount) / 0.02, avg(l_tax) / 0.02, avg(p_size) / 10, avg(p_retailprice) / 100] AS vs
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY p_brand, l_returnflag),
    tr AS (SELECT element, side, unnest(['quantity', 'price', 'discount', 'tax', 'size', 'retail']) AS trait, unnest(vs) AS v FROM tw)"""


def traits(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).select("l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    scale = {"quantity": ("l_quantity", 10), "price": ("l_extendedprice", 10000), "discount": ("l_discount", 0.02), "tax": ("l_tax", 0.02), "size": ("p_size", 10), "retail": ("p_retailprice", 100)}
    wide = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("element"), F.col("l_returnflag").alias("side")).agg(*[(F.avg(c) / s).alias(t) for t, (c, s) in scale.items()])
    return wide.unpivot(["element", "side"], list(scale), "trait", "v")


@query(
    "element_distance",
    f"""WITH {_TRAITS}, d AS (SELECT a.element AS left_element, b.element AS right_element, a.side, count(*) AS traits, sqrt(avg((a.v - b.v) ** 2)) AS distance
            FROM tr a JOIN tr b ON a.trait = b.trait AND a.side = b.side AND a.element < b.element GROUP BY ALL HAVING count(*) >= 4)
        SELECT left_element, right_element, round(max(distance) FILTER (side = 'A'), 6) + 0.0 AS reference_distance, round(max(distance) FILTER (side = 'R'), 6) + 0.0 AS model_distance,
               round(max(distance) FILTER (side = 'R') - max(distance) FILTER (side = 'A'), 6) + 0.0 AS delta FROM d GROUP BY ALL""",
)
def element_distance(spark, sf_dir):
    return I.element_distances(traits(spark, sf_dir), "A", "R")


@query(
    "trait_findings",
    f"""WITH {_TRAITS}, d AS (SELECT r.element, r.trait, round(m.v - r.v, 6) + 0.0 AS delta FROM tr r JOIN tr m ON r.element = m.element AND r.trait = m.trait AND r.side = 'A' AND m.side = 'R'),
        s AS (SELECT *, least(abs(delta) / 2, 1.0) AS score FROM d)
        SELECT element, trait, delta, round(score, 8) + 0.0 AS score, row_number() OVER (ORDER BY round(score, 8) DESC, element, trait) AS finding FROM s""",
)
def trait_findings(spark, sf_dir):
    wide = traits(spark, sf_dir).groupBy("element", "trait").pivot("side", ["A", "R"]).agg(F.max("v")).filter("A is not null and R is not null")
    rows = wide.select("element", "trait", tidy(F.col("R") - F.col("A")).alias("delta"))
    rows = rows.withColumn("score", tidy(F.least(F.abs("delta") / 2, F.lit(1.0)), 8))
    return rows.withColumn("finding", F.row_number().over(W.orderBy(F.desc("score"), "element", "trait")).cast("long"))


@query(
    "role_pivot",
    """WITH s AS (SELECT l_partkey AS "case", sum(l_extendedprice) FILTER (l_returnflag = 'N') AS joint, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS a, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS b
                  FROM lineitem GROUP BY l_partkey)
       SELECT "case", round(20 * log10(greatest(abs(joint - (a + b)) / joint, 1e-15)), 6) + 0.0 AS joint_residual_db, round(20 * log10(joint / (a + b)), 6) + 0.0 AS shared_gain_db
       FROM s WHERE joint IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL""",
)
def role_pivot(spark, sf_dir):
    """The joint recording against the sum of its isolated halves."""
    roles = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case")).pivot("l_returnflag", ["N", "A", "R"]).agg(F.sum("l_extendedprice"))
    joint, parts = F.col("N"), F.col("A") + F.col("R")
    rows = roles.filter("N is not null and A is not null and R is not null")
    joint, parts = F.when(joint != 0, joint), F.when(parts != 0, parts)
    return rows.select("case", tidy(20 * F.log10(F.greatest(F.abs(joint - parts) / joint, F.lit(1e-15)))).alias("joint_residual_db"), tidy(20 * F.log10(joint / parts)).alias("shared_gain_db"))


@query(
    "catalog_expansion",
    """WITH f AS (SELECT s_suppkey, l_linenumber AS kind, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity > 49 GROUP BY ALL)
       SELECT e.s_suppkey, k AS kind, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability
       FROM (SELECT s_suppkey, unnest(range(1, 8)) AS k FROM supplier) e LEFT JOIN f ON f.s_suppkey = e.s_suppkey AND f.kind = e.k""",
)
def catalog_expansion(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").cast("long").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return I.expand(table(spark, sf_dir, "supplier").select("s_suppkey"), list(range(1, 8)), facts, ["s_suppkey"])


@query(
    "text_keys",
    """SELECT c_custkey, hex(c_name) AS hex_key, concat_ws('|', c_mktsegment, c_name) AS joined, sha256(c_name) AS digest FROM customer""",
)
def text_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex("c_name").alias("hex_key"), F.concat_ws("|", "c_mktsegment", "c_name").alias("joined"), F.sha2("c_name", 256).alias("digest"))


@query(
    "probe_sample",
    """WITH s AS (SELECT o_orderkey, CAST(floor((o_orderkey * 44100::HUGEINT - 22050) * 3 / (44100 * 7::HUGEINT)) AS BIGINT) AS idx FROM orders WHERE o_orderkey >= 1)
       SELECT o_orderkey, idx, p_retailprice AS value FROM s LEFT JOIN part ON p_partkey = idx""",
)
def probe_sample(spark, sf_dir):
    """The probe value at each note's sample: the index is exact in whole numbers."""
    notes = table(spark, sf_dir, "orders").filter("o_orderkey >= 1").select("o_orderkey")
    index = I.probe_index(F.col("o_orderkey") * 44100, 22050, 3, 7, 44100)
    probe = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    return notes.withColumn("idx", index).join(probe, "idx", "left").select("o_orderkey", "idx", "value")


@query(
    "probe_statistics",
    """SELECT event_type AS probe, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS population_sd FROM events GROUP BY event_type""",
)
def probe_statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("probe")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), tidy(F.avg("value")).alias("mean"), tidy(F.stddev_pop("value")).alias("population_sd")
    )


@query(
    "channel_weights",
    """WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'lfe' WHEN 1 THEN 'left_surround' WHEN 2 THEN 'right_surround' ELSE 'left' END AS pos, abs(s_acctbal) / 1e4 AS p FROM supplier)
       SELECT pos AS position, count(*) AS channels, round(-0.691 + CASE WHEN sum(p * CASE pos WHEN 'lfe' THEN 0 WHEN 'left' THEN 1 ELSE 1.41 END) > 1e-30
              THEN 10 * log10(sum(p * CASE pos WHEN 'lfe' THEN 0 WHEN 'left' THEN 1 ELSE 1.41 END)) ELSE -300.0 END, 6)::DOUBLE AS lufs FROM c GROUP BY pos""",
)
def channel_weights(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    position = F.when(k == 0, "lfe").when(k == 1, "left_surround").when(k == 2, "right_surround").otherwise("left")
    rows = table(spark, sf_dir, "supplier").select(position.alias("position"), (F.abs("s_acctbal") / 1e4).alias("p"))
    return rows.groupBy("position").agg(F.count(F.lit(1)).alias("channels"), tidy(E.loudness(F.sum(F.col("p") * E.channel_weight(F.col("position"))))).alias("lufs"))
