"""Production accounting: splits, samples, correction fits and corrected views.

A part is a span; its lines of flag A are the reference side, those of flag R the model's.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import expr as E
from gaugeworks.functions.expr import tidy
from gaugeworks.operators import fits
from gaugeworks.plans.registry import query, table

_MOD5 = "list_sum(list_transform(string_split(sha256({x}), ''), lambda c: instr('0123456789abcdef', c) - 1)) % 5"


@query(
    "hash_split_sample",
    f"""WITH k AS (SELECT 'item:' || o_orderkey AS item_key, o_orderpriority AS family,
                CASE WHEN {_MOD5.format(x='CAST(o_orderkey AS VARCHAR)')} = 0 THEN 'check' ELSE 'train' END AS split FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY family, split ORDER BY sha256(item_key), item_key) AS rank FROM k)
        SELECT item_key, family, split, rank FROM r WHERE rank <= CASE WHEN split = 'train' THEN 64 ELSE 16 END""",
)
def hash_split_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    items = orders.select(F.concat(F.lit("item:"), F.col("o_orderkey").cast("string")).alias("item_key"), F.col("o_orderpriority").alias("family"))
    return fits.sample(fits.split(items, "item_key"), ["family"], "item_key")


_SPANS = f"""
    lv AS (SELECT l_partkey AS span, l_linenumber AS node, l_returnflag AS side, 20 * log10(avg(l_extendedprice)) - 100 AS db, count(*) AS c
           FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    sp AS (SELECT r.span, r.node, r.db AS ref, m.db AS model,
           CASE WHEN {_MOD5.format(x="CAST(r.span AS VARCHAR)")} = 0 THEN 'check' ELSE 'train' END AS split
           FROM lv r JOIN lv m ON r.span = m.span AND r.node = m.node AND r.side = 'A' AND m.side = 'R')"""
_FIT = f"""{_SPANS},
    g AS (SELECT node, count(*) AS spans, least(6.0, greatest(-6.0, round(quantile_cont(ref - model, 0.5), 6))) AS raw FROM sp WHERE split = 'train' GROUP BY node HAVING count(*) >= 8),
    q AS (SELECT max(raw) FILTER (node = 1) AS r1, max(raw) FILTER (node = 2) AS r2, max(raw) FILTER (node = 3) AS r3, max(raw) FILTER (node = 4) AS r4,
          max(raw) FILTER (node = 5) AS r5, max(raw) FILTER (node = 6) AS r6, max(raw) FILTER (node = 7) AS r7 FROM g),
    f1 AS (SELECT *, r1 AS g1 FROM q), f2 AS (SELECT *, greatest(g1 - 3, least(g1 + 3, r2)) AS g2 FROM f1), f3 AS (SELECT *, greatest(g2 - 3, least(g2 + 3, r3)) AS g3 FROM f2),
    f4 AS (SELECT *, greatest(g3 - 3, least(g3 + 3, r4)) AS g4 FROM f3), f5 AS (SELECT *, greatest(g4 - 3, least(g4 + 3, r5)) AS g5 FROM f4),
    f6 AS (SELECT *, greatest(g5 - 3, least(g5 + 3, r6)) AS g6 FROM f5), f7 AS (SELECT *, greatest(g6 - 3, least(g6 + 3, r7)) AS g7 FROM f6),
    fit AS (SELECT unnest(range(1, 8)) AS node, unnest([g1, g2, g3, g4, g5, g6, g7]) AS gain_db FROM f7)"""


def spans(spark, sf_dir):
    """(span, node, ref, model, split): level by part and line number on either side."""
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    level = items.groupBy(F.col("l_partkey").alias("span"), F.col("l_linenumber").alias("node")).pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_extendedprice"))
    db = lambda c: 20 * F.log10(F.col(c)) - 100
    both = level.filter("A is not null and R is not null").select("span", "node", db("A").alias("ref"), db("R").alias("model"))
    return fits.split(both.withColumn("_key", F.col("span").cast("string")), "_key").drop("_key")


@query("eq_fit", f"WITH {_FIT} SELECT fit.node, spans, raw + 0.0 AS raw_db, round(gain_db, 6) + 0.0 AS gain_db FROM fit JOIN g USING (node)")
def eq_fit(spark, sf_dir):
    return fits.eq_gains(spans(spark, sf_dir).filter("split = 'train'"))


@query(
    "dynamics_fit",
    f"""WITH {_SPANS}, pt AS (SELECT span, avg(ref) AS ref, avg(model) AS model FROM sp WHERE split = 'train' GROUP BY span
        QUALIFY row_number() OVER (ORDER BY sha256(CAST(span AS VARCHAR)), span) <= 64),
        grid AS (SELECT -48.0::DOUBLE + t AS threshold, r AS ratio FROM range(43) a(t), (VALUES (1.0::DOUBLE), (1.25), (1.5), (2.0), (3.0), (4.0), (6.0), (10.0), (20.0)) b(r)),
        res AS (SELECT threshold, ratio, ref - CASE WHEN model <= threshold THEN model ELSE threshold + (model - threshold) / ratio END AS residual FROM pt, grid),
        mk AS (SELECT threshold, ratio, least(12.0, greatest(-12.0, quantile_cont(residual, 0.5))) AS makeup FROM res GROUP BY ALL),
        sse AS (SELECT threshold, ratio, round(max(makeup), 6) + 0.0 AS makeup_db, round(sum((residual - makeup) ** 2), 6) AS sse FROM res JOIN mk USING (threshold, ratio) GROUP BY ALL)
        SELECT threshold, ratio, makeup_db, sse FROM sse ORDER BY sse, threshold, ratio LIMIT 1""",
)
def dynamics_fit(spark, sf_dir):
    points = spans(spark, sf_dir).filter("split = 'train'").groupBy("span").agg(F.avg("ref").alias("ref"), F.avg("model").alias("model"))
    kept = points.orderBy(F.sha2(F.col("span").cast("string"), 256), "span").limit(64)
    return fits.dynamics(kept)


@query(
    "dynamics_interval",
    f"""WITH {_SPANS}, pt AS (SELECT span, avg(ref) AS ref, avg(model) AS model FROM sp WHERE split = 'train' GROUP BY span
        QUALIFY row_number() OVER (ORDER BY sha256(CAST(span AS VARCHAR)), span) <= 64),
        grid AS (SELECT -48.0::DOUBLE + t AS threshold, r AS ratio FROM range(43) a(t), (VALUES (1.0::DOUBLE), (1.25), (1.5), (2.0), (3.0), (4.0), (6.0), (10.0), (20.0)) b(r)),
        po AS (SELECT out, pt.* FROM pt, (SELECT span AS out FROM pt UNION ALL SELECT -1) WHERE out <> span),
        res AS (SELECT out, threshold, ratio, ref - CASE WHEN model <= threshold THEN model ELSE threshold + (model - threshold) / ratio END AS residual FROM po, grid),
        mk AS (SELECT out, threshold, ratio, least(12.0, greatest(-12.0, quantile_cont(residual, 0.5))) AS makeup FROM res GROUP BY ALL),
        sse AS (SELECT out, threshold, ratio, max(makeup) AS makeup, round(sum((residual - makeup) ** 2), 6) AS sse FROM res JOIN mk USING (out, threshold, ratio) GROUP BY ALL),
        best AS (SELECT * FROM sse QUALIFY row_number() OVER (PARTITION BY out ORDER BY sse, threshold, ratio) = 1),
        l AS (SELECT count(*) AS n, list_sort(list(threshold)) AS t, list_sort(list(ratio)) AS r, quantile_cont(makeup, 0.05) AS m05, quantile_cont(makeup, 0.95) AS m95 FROM best WHERE out <> -1),
        b AS (SELECT l.*, best.*, CAST(floor((n - 1) * 0.05) AS INT) + 1 AS lo, CAST(ceil((n - 1) * 0.95) AS INT) + 1 AS hi FROM l, best WHERE out = -1 AND n >= 8)
        SELECT 'threshold' AS fit, n AS spans, threshold AS estimate, least(t[lo], threshold) AS q05, greatest(t[hi], threshold) AS q95 FROM b
        UNION ALL SELECT 'ratio', n, ratio, least(r[lo], ratio), greatest(r[hi], ratio) FROM b
        UNION ALL SELECT 'makeup_db', n, round(makeup, 6) + 0.0, round(least(m05, makeup), 6) + 0.0, round(greatest(m95, makeup), 6) + 0.0 FROM b""",
)
def dynamics_interval(spark, sf_dir):
    points = spans(spark, sf_dir).filter("split = 'train'").groupBy("span").agg(F.avg("ref").alias("ref"), F.avg("model").alias("model"))
    return fits.dynamics_interval(points.orderBy(F.sha2(F.col("span").cast("string"), 256), "span").limit(64))


_STEREO = ("avg(l_linenumber) * 8", "20 * log10(avg(l_extendedprice)) - 100", "avg(l_discount) * 20", "avg(l_tax) * 25 - 1")
_STEREO_KINDS = ("delay_samples", "balance_db", "width_ratio", "correlation")


@query(
    "stereo_fits",
    f"""WITH sv AS (SELECT l_partkey AS span, l_returnflag AS side, {_MOD5.format(x="CAST(l_partkey AS VARCHAR)")} = 0 AS held, [{', '.join(_STEREO)}] AS vs FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
        st AS (SELECT span, side, unnest([{', '.join(f"'{k}'" for k in _STEREO_KINDS)}]) AS kind, unnest(vs) AS v FROM sv WHERE NOT held),
        sb AS (SELECT a.kind, a.v AS ref, b.v AS model FROM st a JOIN st b ON a.span = b.span AND a.kind = b.kind AND a.side = 'A' AND b.side = 'R'),
        sg AS (SELECT count(*) AS spans, CASE WHEN quantile_cont(ref, 0.5) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS r, CASE WHEN quantile_cont(model, 0.5) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS m FROM sb WHERE kind = 'correlation'),
        lg AS (SELECT kind, unnest(['reference', 'model', 'correction']) AS scope, unnest([ref, model, CASE kind
                 WHEN 'width_ratio' THEN CASE WHEN model > 2.2250738585072014e-308 THEN least(4.0, greatest(0.25, ref / model)) ELSE 4.0 END
                 WHEN 'correlation' THEN least(1.0, greatest(-1.0, ref - CASE WHEN spans >= 8 THEN r * m ELSE 1 END * model))
                 WHEN 'delay_samples' THEN least(96.0, greatest(-96.0, ref - model)) ELSE least(12.0, greatest(-12.0, ref - model)) END]) AS v FROM sb, sg),
        q AS (SELECT scope, kind, count(*) AS spans, quantile_cont(v, 0.5) AS e, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM lg GROUP BY scope, kind HAVING count(*) >= 8)
        SELECT scope, kind, spans, round(e, 6) + 0.0 AS estimate, round(least(lo, e), 6) + 0.0 AS q05, round(greatest(hi, e), 6) + 0.0 AS q95 FROM q
        UNION ALL SELECT unnest(['reference', 'model', 'correction']), 'polarity', spans, unnest([r, m, r * m]), NULL, NULL FROM sg WHERE spans >= 8""",
)
def stereo_fits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    wide = lines.groupBy(F.col("l_partkey").alias("span"), "l_returnflag").agg(*[F.expr(text).alias(k) for k, text in zip(_STEREO_KINDS, _STEREO)])
    long = wide.unpivot(["span", "l_returnflag"], list(_STEREO_KINDS), "kind", "v").groupBy("span", "kind").pivot("l_returnflag", ["A", "R"]).agg(F.max("v"))
    both = fits.split(long.select("span", "kind", F.col("A").alias("ref"), F.col("R").alias("model"), F.col("span").cast("string").alias("_key")), "_key").drop("_key")
    return fits.stereo(both.filter("split = 'train'"), 48000.0)


@query(
    "fit_summary",
    f"""WITH {_SPANS}, s AS (SELECT node, count(*) AS spans, quantile_cont(ref - model, 0.5) AS med, quantile_cont(ref - model, 0.05) AS lo, quantile_cont(ref - model, 0.95) AS hi
        FROM sp WHERE split = 'train' GROUP BY node)
        SELECT node, spans, round(med, 6) + 0.0 AS estimate, round(least(lo, med), 6) + 0.0 AS q05, round(greatest(hi, med), 6) + 0.0 AS q95 FROM s""",
)
def fit_summary(spark, sf_dir):
    q = F.percentile(F.col("ref") - F.col("model"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = spans(spark, sf_dir).filter("split = 'train'").groupBy("node").agg(F.count(F.lit(1)).alias("spans"), q.alias("q"))
    q = F.col("q")
    return rows.select("node", "spans", tidy(q[1]).alias("estimate"), tidy(F.least(q[0], q[1])).alias("q05"), tidy(F.greatest(q[2], q[1])).alias("q95"))


@query(
    "corrected_views",
    f"""WITH {_FIT}, v AS (SELECT split, 'RAW' AS view, node, ref, model FROM sp UNION ALL
          SELECT split, 'DRY_LIKE', sp.node, ref - gain_db, model FROM sp JOIN fit USING (node) UNION ALL
          SELECT split, 'ROOM_MATCHED', sp.node, ref, model + gain_db FROM sp JOIN fit USING (node)),
        s AS (SELECT split, view, node, count(*) AS spans, avg(model - ref) AS delta, stddev_pop(model - ref) AS sd FROM v GROUP BY ALL),
        z AS (SELECT split, view, node, spans, CASE WHEN spans >= 2 THEN round(delta, 6) + 0.0 END AS delta_db,
              CASE WHEN spans >= 2 THEN round(CASE WHEN sd > 0 THEN abs(delta) / sd / (1 + abs(delta) / sd) WHEN delta = 0 THEN 0 ELSE 1 END, 6) + 0.0 END AS gap_score FROM s)
        SELECT z.split, z.view, z.node, z.spans, z.delta_db, z.gap_score,
               coalesce(z.gap_score >= 0.20 AND r.gap_score >= 0.20 AND z.split = 'check' AND z.view <> 'RAW', false) AS survives
        FROM z LEFT JOIN z r ON r.split = z.split AND r.node = z.node AND r.view = 'RAW'""",
)
def corrected_views(spark, sf_dir):
    rows = spans(spark, sf_dir)
    gains = fits.eq_gains(rows.filter("split = 'train'")).select("node", "gain_db")
    return fits.views(rows, gains)


@query(
    "item_match",
    f"""WITH i AS (SELECT l_partkey AS item, l_returnflag AS side, sum(l_quantity) AS duration, count(DISTINCT l_linenumber) AS bands, avg(1 - l_tax) AS confidence
                   FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
        j AS (SELECT r.item, least(r.duration, m.duration) AS d, least(r.bands, m.bands) AS b, round(least(r.confidence, m.confidence), 6) AS c
              FROM i r JOIN i m ON r.item = m.item AND r.side = 'A' AND m.side = 'R'),
        f AS (SELECT item, (CASE WHEN d >= 100 AND b >= 6 THEN 1 ELSE 0 END) + (CASE WHEN d >= 200 THEN 2 ELSE 0 END) + (CASE WHEN d >= 300 THEN 4 ELSE 0 END)
              + (CASE WHEN d < 100 THEN 8 ELSE 0 END) AS families, c + 0.0 AS confidence FROM j WHERE c >= 0.95)
        SELECT item, families, confidence FROM f WHERE families <> 0""",
)
def item_match(spark, sf_dir):
    """Items that both sides have, with the fit families that they qualify for as bits."""
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    facts = items.groupBy(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("side")).agg(
        F.sum("l_quantity").alias("duration"), F.countDistinct("l_linenumber").alias("bands"), F.avg(1 - F.col("l_tax")).alias("confidence")
    )
    side = lambda s: facts.filter(F.col("side") == s).drop("side")
    r, m = side("A").alias("r"), side("R").alias("m")
    least = lambda c: F.least(F.col(f"r.{c}"), F.col(f"m.{c}"))
    both = r.join(m, F.col("r.item") == F.col("m.item")).select(F.col("r.item").alias("item"), least("duration").alias("d"), least("bands").alias("b"), tidy(least("confidence")).alias("confidence"))
    bit = lambda test, n: F.when(test, n).otherwise(0)
    d, b = F.col("d"), F.col("b")
    families = bit((d >= 100) & (b >= 6), 1).bitwiseOR(bit(d >= 200, 2)).bitwiseOR(bit(d >= 300, 4)).bitwiseOR(bit(d < 100, 8))
    return both.filter("confidence >= 0.95").select("item", families.alias("families"), "confidence").filter("families <> 0")


@query(
    "quality_flags",
    """WITH f AS (SELECT l_suppkey, (CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) | (CASE WHEN l_tax = 0 THEN 2 ELSE 0 END) | (CASE WHEN l_quantity >= 48 THEN 4 ELSE 0 END) AS flags, 1 - l_tax AS c FROM lineitem)
       SELECT l_suppkey, bit_or(flags) AS flags, round(avg(c) / (1 + bit_count(bit_or(flags))), 6) + 0.0 AS confidence, max(c) AS best FROM f GROUP BY l_suppkey""",
)
def quality_flags(spark, sf_dir):
    bit = lambda test, n: F.when(test, n).otherwise(0)
    flags = bit(F.col("l_discount") == 0, 1).bitwiseOR(bit(F.col("l_tax") == 0, 2)).bitwiseOR(bit(F.col("l_quantity") >= 48, 4))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", flags.alias("flags"), (1 - F.col("l_tax")).alias("c"))
    return rows.groupBy("l_suppkey").agg(F.bit_or("flags").alias("flags"), tidy(E.flagged(F.avg("c"), F.bit_or("flags"))).alias("confidence"), F.max("c").alias("best"))


@query(
    "previous_contrast",
    """WITH o AS (SELECT l_suppkey, l_partkey % 12 AS pitch, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity AS level, l_extendedprice, l_linestatus, l_discount, l_tax,
              row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_linestatus, l_returnflag) AS k FROM lineitem),
       h AS (SELECT *, CASE WHEN level >= 3 THEN level END AS heard FROM o),
       p AS (SELECT *, last_value(heard IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
             last_value(heard IGNORE NULLS) OVER (PARTITION BY l_suppkey, pitch ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM h)
       SELECT l_suppkey, k, level - prior AS contrast, level - same AS same_pitch_contrast, CASE WHEN l_linestatus = 'F' THEN level - prior END AS accent FROM p""",
)
def previous_contrast(spark, sf_dir):
    """Level against the last heard one in the part, and in the part at the same pitch."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag"]
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)).cast("long"))
    rows = rows.select("l_suppkey", (F.col("l_partkey") % 12).alias("pitch"), "k", F.col("l_quantity").alias("level"), "l_linestatus")
    heard = F.when(F.col("level") >= 3, F.col("level"))
    last = lambda *key: F.last(heard, ignorenulls=True).over(W.partitionBy(*key).orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    contrast = F.col("level") - last("l_suppkey")
    return rows.select(
        "l_suppkey", "k", contrast.alias("contrast"), (F.col("level") - last("l_suppkey", "pitch")).alias("same_pitch_contrast"), F.when(F.col("l_linestatus") == "F", contrast).alias("accent")
    )
