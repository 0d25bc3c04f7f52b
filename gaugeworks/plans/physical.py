"""Physical checks: a user's views are the reference's samples, the clicks the model's; an
embedding and the next of its label are a pair of spectra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import expr as E
from gaugeworks.operators import items as I
from gaugeworks.operators import physical as P
from gaugeworks.operators import series as S
from gaugeworks.plans.items import _TRAITS, traits
from gaugeworks.plans.registry import query, table
from gaugeworks.plans.signals import _LAGS, _X, samples

_SCAN = f"""{_X}, s0 AS (SELECT CASE event_type WHEN 'view' THEN 'reference' ELSE 'model' END AS side, CAST(user_id AS VARCHAR) AS "case", round(x, 2) AS x,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) - 1 AS n FROM x WHERE event_type IN ('view', 'click')),
    s1 AS (SELECT *, lag(x) OVER w AS prev, count(*) OVER (PARTITION BY side, "case") AS of, abs(x) >= 0.99 AS clipped,
           CASE WHEN n % 2 = 1 AND n >= 3 THEN CASE WHEN x = lag(x, 2) OVER w AND lag(x) OVER w = lag(x, 3) OVER w THEN 1.0e0 ELSE 0.0e0 END END AS again
           FROM s0 WINDOW w AS (PARTITION BY side, "case" ORDER BY n))"""
_BINS = """e0 AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
    e1 AS (SELECT label || ':' || (i // 2) AS "case", CASE WHEN i % 2 = 0 THEN 'reference' ELSE 'model' END AS side, unnest(embedding)::DOUBLE ** 2 AS p, unnest(range(64)) AS k, 64 AS bins FROM e0),
    e2 AS (SELECT *, min_by(k, -p * 1e9 + k * 1e-9) OVER (PARTITION BY side, "case") AS peak, 5 AS f1, 9 AS f2 FROM e1)"""


def _compare(kinds: dict, source: str, scope: str) -> str:
    """Kinds said anew for the oracle, from their definitions."""
    wide = ", ".join(f"CAST({text} AS DOUBLE) AS {name}" for name, text in kinds.items())
    values = f"""SELECT side, "case", kind, round(v, 6) + 0.0 AS v FROM (SELECT side, "case", unnest([{', '.join(f"'{k}'" for k in kinds)}]) AS kind, unnest([{', '.join(kinds)}]) AS v
              FROM (SELECT side, "case", {wide} FROM {source} GROUP BY side, "case"))"""
    return _met(values, scope)


def _met(values: str, scope: str, known: str = "max(v) FILTER (side = 'model') - max(v) FILTER (side = 'reference')") -> str:
    return f"""SELECT '{scope}' AS scope, "case", kind, max(v) FILTER (side = 'reference') AS reference_value, max(v) FILTER (side = 'model') AS model_value,
        round(max(v) FILTER (side = 'model') - max(v) FILTER (side = 'reference'), 6) + 0.0 AS delta,
        CASE WHEN {known} IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability FROM ({values}) GROUP BY "case", kind"""


_TENTH = "CAST(greatest(of // 10, 1) AS BIGINT)"
_SCAN_SAID = {
    "dc_offset": "sum(x) / count(x)",
    "dc_drift": f"avg(CASE WHEN n > of - 1 - {_TENTH} THEN x END) - avg(CASE WHEN n <= {_TENTH} - 1 THEN x END)",
    "clip_fraction": "count(*) FILTER (abs(x) >= 0.99) / count(*)",
    "hard_bound_fraction": "count(*) FILTER (x >= 1 OR x <= -1) / count(*)",
    "repeated_block_fraction": "sum(again) / nullif(count(again), 0)",
    "stuck_state_fraction": "count(*) FILTER (x = prev AND x <> 0) / count(*)",
    "max_step_dbfs": "10 * log10(greatest(max((x - prev) ** 2), 1e-30))",
    "runaway_slope_db_per_second": "48 * covar_pop(20 * log10(greatest(abs(x), 1e-15)), n) / nullif(var_pop(n), 0)",
    "return_level_dbfs": f"20 * log10(greatest(sqrt(avg(CASE WHEN n > of - 1 - {_TENTH} THEN x * x END)), 1e-15))",
    "denormal_fraction": "avg(CASE WHEN abs(x) > 0 AND abs(x) < 2.2250738585072014e-308 THEN 1 ELSE 0 END)",
}
_TONES = "nullif(sum(CASE WHEN k IN (5, 9) THEN p END), 0)"
_SPECTRUM_SAID = {
    "high_band_ratio": "sum(CASE WHEN k > 51 THEN p ELSE 0 END) / nullif(sum(p), 0)",
    "subharmonic_ratio": "max(CASE WHEN k > 0 AND k <= peak // 2 THEN p END) / nullif(max(p), 0)",
    "fixed_tone_prominence_db": "10 * log10(greatest(max(p), 1e-30)) - 10 * log10(greatest((sum(p) - max(p)) / 63, 1e-30))",
    "intermodulation_ratio": f"sqrt(sum(CASE WHEN k IN (1, 13) THEN p ELSE 0 END) / {_TONES})",
    "sum_tone_db": f"10 * log10(greatest(sum(CASE WHEN k = 14 THEN p ELSE 0 END), 1e-30) / {_TONES})",
    "difference_tone_db": f"10 * log10(greatest(sum(CASE WHEN k = 4 THEN p ELSE 0 END), 1e-30) / {_TONES})",
}
_ROLES = """rr AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'reference' ELSE 'model' END AS side, CASE WHEN event_type IN ('view', 'purchase') THEN 'baseline' ELSE 'variant' END AS role,
        CAST(user_id AS VARCHAR) AS "case", round(x, 2) AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) - 1 AS n FROM x WHERE event_type IN ('view', 'click', 'purchase', 'error')),
    rb AS (SELECT a.side, a."case", a.n, a.x AS a, b.x AS b FROM rr a JOIN rr b ON a.side = b.side AND a."case" = b."case" AND a.n = b.n AND a.role = 'baseline' AND b.role = 'variant'),
    rk AS (SELECT side, "case", count(*) AS total FROM rb GROUP BY side, "case"),
    rl AS ({lags}),
    rs AS (SELECT rl.*, round(abs(correlation) * pairs / total, 6) + 0.0 AS score FROM rl JOIN rk USING (side, "case") WHERE pairs >= 3 AND correlation IS NOT NULL AND NOT isnan(correlation)),
    rg AS (SELECT side, "case", lag, correlation FROM rs QUALIFY row_number() OVER (PARTITION BY side, "case" ORDER BY score DESC, abs(lag), lag DESC) = 1),
    ra AS (SELECT a.side, a."case", a.x AS r, b.x AS m FROM rr a JOIN rg USING (side, "case") JOIN rr b ON a.side = b.side AND a."case" = b."case" AND b.n = a.n + lag AND a.role = 'baseline' AND b.role = 'variant'),
    rd AS (SELECT side, "case", unnest(['render_rms_error_db', 'render_max_error_dbfs']) AS kind,
           unnest([10 * log10(greatest(sum((m - r) ** 2) / coalesce(nullif(sum(r * r), 0), count(*)), 1e-30)), 10 * log10(greatest(max((m - r) ** 2), 1e-30))]) AS v FROM ra GROUP BY side, "case"),
    rp AS (SELECT *, max(abs(x)) OVER (PARTITION BY side, "case", role) AS top FROM rr),
    re AS (SELECT side, "case", role, min(n) / 48.0::DOUBLE AS f, (max(n) - min(n)) / 48.0::DOUBLE AS d FROM rp WHERE top > 0 AND abs(x) >= 0.1 * top GROUP BY side, "case", role),
    rf AS (SELECT a.side, a."case", b.f - a.f AS attack, b.d - a.d AS decay FROM re a LEFT JOIN re b ON a.side = b.side AND a."case" = b."case" AND b.role = 'variant' WHERE a.role = 'baseline'
           UNION ALL SELECT side, "case", NULL, NULL FROM re GROUP BY side, "case" HAVING count(*) FILTER (role = 'baseline') = 0),
    q0 AS (SELECT label || ':' || (i // 4) AS "case", CASE WHEN i % 4 < 2 THEN 'reference' ELSE 'model' END AS side, CASE WHEN i % 2 = 0 THEN 'baseline' ELSE 'variant' END AS role,
           unnest(embedding)::DOUBLE ** 2 AS p, unnest(range(64)) AS k FROM e0),
    q1 AS (SELECT a.side, a."case", sqrt(avg((10 * log10(b.p / a.p)) ** 2)) AS far FROM q0 a JOIN q0 b ON a.side = b.side AND a."case" = b."case" AND a.k = b.k AND a.role = 'baseline' AND b.role = 'variant'
           WHERE a.k > 0 AND a.p > 0 AND b.p > 0 GROUP BY a.side, a."case"),
    q2 AS (SELECT side, "case", role, arg_max(k, p) AS top FROM q0 GROUP BY ALL),
    q3 AS (SELECT a.side, a."case", 1200 * (log2(b.top) - log2(a.top)) AS cents FROM q2 a JOIN q2 b ON a.side = b.side AND a."case" = b."case" AND a.role = 'baseline' AND b.role = 'variant' WHERE a.top > 0 AND b.top > 0),
    rv AS (SELECT * FROM rd UNION ALL SELECT side, "case", 'render_lag_samples', lag FROM rg UNION ALL SELECT side, "case", 'render_correlation', correlation FROM rg
           UNION ALL SELECT side, "case", 'render_attack_delta_seconds', attack FROM rf UNION ALL SELECT side, "case", 'render_decay_delta_seconds', decay FROM rf
           UNION ALL SELECT side, "case", 'render_spectral_distance_db', far FROM q1 UNION ALL SELECT side, "case", 'render_pitch_delta_cents', cents FROM q3)""".replace(
    "{lags}",
    """SELECT side, "case", lag, count(*) AS pairs, round(corr(l.a, r.b), 6) + 0.0 AS correlation FROM rb l JOIN (SELECT side, "case", unnest(range(-8, 9)) AS lag, n AS m, b FROM rb WHERE b IS NOT NULL) r USING (side, "case")
           WHERE a IS NOT NULL AND l.n = r.m - r.lag GROUP BY ALL""",
)
_RENDER = _met("""SELECT side, "case", kind, round(v, 6) + 0.0 AS v FROM rv""", "render", "coalesce(max(v) FILTER (side = 'model'), max(v) FILTER (side = 'reference'))")
_NEVER = f"""SELECT 'declared' AS scope, "case", unnest([{', '.join(f"'{k}'" for k in P.NEVER)}]) AS kind, NULL::DOUBLE AS reference_value, NULL::DOUBLE AS model_value, NULL::DOUBLE AS delta, 'UNAVAILABLE' AS availability
    FROM (SELECT DISTINCT "case" FROM s1)"""
_CHECKS = f"""{_SCAN}, {_BINS}, {_ROLES}, ck AS ({_compare(_SCAN_SAID, 's1', 'scan')} UNION ALL {_compare(_SPECTRUM_SAID, 'e2', 'spectrum')} UNION ALL {_RENDER} UNION ALL {_NEVER})"""


def sides(spark, sf_dir):
    rows = samples(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    side = F.when(F.col("event_type") == "view", "reference").otherwise("model")
    rows = rows.select(side.alias("side"), F.col("user_id").cast("string").alias("case"), E.rounded(F.col("x"), 2).alias("x"), F.col("n").alias("_n"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("side", "case").orderBy("_n")) - 1)
    w = W.partitionBy("side", "case").orderBy("n")
    same = (F.col("x") == F.lag("x", 2).over(w)) & (F.lag("x").over(w) == F.lag("x", 3).over(w))
    again = F.when((F.col("n") % 2 == 1) & (F.col("n") >= 3), F.when(same, 1.0).otherwise(0.0))
    return rows.select("side", "case", "n", "x", F.lag("x").over(w).alias("prev"), F.count(F.lit(1)).over(W.partitionBy("side", "case")).alias("of"), (F.abs("x") >= 0.99).alias("clipped"), again.alias("again"))


def spectra(spark, sf_dir):
    w = W.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("i", F.row_number().over(w) - 1)
    case = F.concat(F.col("label").cast("string"), F.lit(":"), F.floor(F.col("i") / 2).cast("string"))
    side = F.when(F.col("i") % 2 == 0, "reference").otherwise("model")
    power = F.transform("embedding", lambda e: e.cast("double") * e.cast("double"))
    bins = rows.select(case.alias("case"), side.alias("side"), F.posexplode(power).alias("k", "p")).withColumn("bins", F.lit(64))
    peak = F.min_by("k", -F.col("p") * 1e9 + F.col("k") * 1e-9).over(W.partitionBy("side", "case"))
    return bins.withColumn("peak", peak).withColumn("f1", F.lit(5)).withColumn("f2", F.lit(9))


def roles(spark, sf_dir):
    """(side, case, role, n, x): a user's views and clicks are the reference's baseline and
    variant, purchases and errors the model's."""
    rows = samples(spark, sf_dir).filter(F.col("event_type").isin("view", "click", "purchase", "error"))
    side = F.when(F.col("event_type").isin("view", "click"), "reference").otherwise("model")
    role = F.when(F.col("event_type").isin("view", "purchase"), "baseline").otherwise("variant")
    n = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("n")) - 1
    return rows.select(side.alias("side"), F.col("user_id").cast("string").alias("case"), role.alias("role"), n.cast("long").alias("n"), E.rounded(F.col("x"), 2).alias("x"))


def render(spark, sf_dir):
    rows, key = roles(spark, sf_dir), ["side", "case"]
    one = rows.filter("role = 'baseline'").select(*key, "n", F.col("x").alias("a"))
    two = rows.filter("role = 'variant'").select(*key, "n", F.col("x").alias("b"))
    both = one.join(two, [*key, "n"])
    total = both.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    lags = S.best_lag(S.lagged_correlation(both, key, 8).join(total, key), key, "total").select(*key, "lag", "correlation")
    moved = one.join(lags, key).select(*key, (F.col("n") + F.col("lag")).alias("n"), F.col("a").alias("r"))
    pairs = moved.join(two, [*key, "n"]).select(*key, "r", F.col("b").alias("m"))
    top = F.max(F.abs("x")).over(W.partitionBy(*key, "role"))
    edges = rows.withColumn("top", top).filter((F.col("top") > 0) & (F.abs("x") >= 0.1 * F.col("top")))
    edges = edges.groupBy(*key, "role").agg((F.min("n") / P.RATE).alias("first"), (F.max("n") / P.RATE).alias("last"))
    w = W.partitionBy("label").orderBy("vec_id")
    spectra_ = table(spark, sf_dir, "embeddings").withColumn("i", F.row_number().over(w) - 1)
    case = F.concat(F.col("label").cast("string"), F.lit(":"), F.floor(F.col("i") / 4).cast("string"))
    power = F.transform("embedding", lambda e: e.cast("double") * e.cast("double"))
    bins = spectra_.select(
        F.when(F.col("i") % 4 < 2, "reference").otherwise("model").alias("side"), case.alias("case"), F.when(F.col("i") % 2 == 0, "baseline").otherwise("variant").alias("role"), F.posexplode(power).alias("k", "p")
    )
    return P.render_checks(pairs, lags, edges, bins.withColumn("hz", F.col("k") * 187.5))


def all_checks(spark, sf_dir):
    rows = sides(spark, sf_dir)
    parts = [P.scans(rows), P.spectrum_checks(spectra(spark, sf_dir)), render(spark, sf_dir), P.never(rows.select("case").distinct())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("physical_checks", f"WITH {_CHECKS} SELECT * FROM ck")
def physical_checks(spark, sf_dir):
    return all_checks(spark, sf_dir)


_RULES = """
    CASE WHEN kind IN ('render_rms_error_db', 'render_max_error_dbfs', 'render_spectral_distance_db') THEN abs(delta) / 12 WHEN kind IN ('sum_tone_db', 'difference_tone_db') THEN abs(delta) / 20
         WHEN kind = 'intermodulation_ratio' THEN abs(delta) * 4 WHEN kind = 'render_correlation' THEN abs(delta) * 5 WHEN kind = 'render_lag_samples' THEN abs(delta) / 32
         WHEN kind = 'render_pitch_delta_cents' THEN abs(delta) / 25 WHEN kind IN ('render_attack_delta_seconds', 'render_decay_delta_seconds') THEN abs(delta) * 20
         WHEN kind IN ('dc_offset', 'dc_drift') THEN abs(val) * 100 WHEN kind IN ('clip_fraction', 'hard_bound_fraction') THEN val * 1000 WHEN kind IN ('repeated_block_fraction', 'stuck_state_fraction') THEN val * 10
         WHEN kind = 'max_step_dbfs' THEN greatest(val / 12 + 1, 0) WHEN kind = 'runaway_slope_db_per_second' THEN greatest(val, 0) / 6 WHEN kind = 'return_level_dbfs' THEN greatest(val / 60 + 1, 0)
         WHEN kind = 'denormal_fraction' THEN val * 1e6 END"""
_FAULTS = "('dc_offset', 'dc_drift', 'clip_fraction', 'hard_bound_fraction', 'repeated_block_fraction', 'stuck_state_fraction', 'max_step_dbfs', 'runaway_slope_db_per_second', 'return_level_dbfs', 'denormal_fraction')"


@query(
    "physical_findings",
    f"""WITH {_CHECKS}, sc AS (SELECT *, CASE WHEN {_RULES} IS NOT NULL THEN round(least({_RULES} + 1e-9, 1), 6) + 0.0 END AS score FROM (SELECT *, coalesce(model_value, reference_value) AS val FROM ck WHERE availability = 'AVAILABLE'))
        SELECT scope, "case", kind, delta, CASE WHEN kind IN {_FAULTS} THEN 'FAULT' ELSE 'GAP' END AS class, CASE WHEN kind IN {_FAULTS} THEN 'numeric-fault' ELSE 'physical-gap' END AS code,
               CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.4 THEN 'WARNING' ELSE 'INFO' END AS severity, score, row_number() OVER (ORDER BY score DESC, scope, "case", kind) AS finding
        FROM sc WHERE score >= 0.2""",
)
def physical_findings(spark, sf_dir):
    return P.findings(all_checks(spark, sf_dir)).select("scope", "case", "kind", "delta", "class", "code", "severity", "score", "finding")


@query(
    "body_modes",
    f"""WITH {_BINS}, mp AS (SELECT side, "case", k, p, coalesce(lag(p) OVER w, 0) AS l, coalesce(lead(p) OVER w, 0) AS r, peak, (sum(p) OVER (PARTITION BY side, "case") - p) / 63 AS rest FROM e2 WINDOW w AS (PARTITION BY side, "case" ORDER BY k)),
        md AS (SELECT side, "case", greatest(k, 1) * 187.5::DOUBLE AS hz, 10 * log10(p / rest) AS prominence, (CASE WHEN p > l THEN least(1.0, p / 2 / (p - l)) ELSE 1.0 END + CASE WHEN p > r THEN least(1.0, p / 2 / (p - r)) ELSE 1.0 END) * 187.5 AS bw
               FROM mp WHERE k = peak),
        lg AS (SELECT side, "case", unnest(['body_mode_frequency_hz', 'body_mode_bandwidth_hz', 'body_mode_q', 'body_mode_prominence_db', 'body_mode_decay_seconds']) AS kind,
               unnest([round(hz, 6), round(bw, 6), round(hz / bw, 6), round(prominence, 6), round(ln(1000) / (pi() * bw), 6)]) AS v FROM md)
        SELECT 'mode' AS scope, "case", kind, max(v) FILTER (side = 'reference') AS reference_value, max(v) FILTER (side = 'model') AS model_value,
               round(max(v) FILTER (side = 'model') - max(v) FILTER (side = 'reference'), 6) + 0.0 AS delta,
               CASE WHEN max(v) FILTER (side = 'model') - max(v) FILTER (side = 'reference') IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability FROM lg GROUP BY "case", kind
        UNION ALL SELECT 'mode', "case", 'body_mode_distance_cents', NULL, NULL, round(1200 * log2(max(hz) FILTER (side = 'model') / max(hz) FILTER (side = 'reference')), 6) + 0.0,
               CASE WHEN count(*) < 2 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END FROM md GROUP BY "case\"""",
)
def body_modes(spark, sf_dir):
    w = W.partitionBy("side", "case")
    bins = spectra(spark, sf_dir)
    near = w.orderBy("k")
    rows = bins.withColumn("left", F.coalesce(F.lag("p").over(near), F.lit(0.0))).withColumn("right", F.coalesce(F.lead("p").over(near), F.lit(0.0)))
    rows = rows.withColumn("rest", (F.sum("p").over(w) - F.col("p")) / 63).filter("k = peak")
    modes = rows.select("side", "case", (F.greatest("k", F.lit(1)) * 187.5).alias("hz"), "p", "left", "right", (10 * F.log10(F.col("p") / F.col("rest"))).alias("prominence"))
    return P.mode_facts(modes, 187.5)


@query(
    "element_checks",
    f"""WITH {_TRAITS}, {_SCAN.strip()}, d AS (SELECT a.element AS l, b.element AS r, a.side, sqrt(avg((a.v - b.v) ** 2)) AS distance FROM tr a JOIN tr b ON a.trait = b.trait AND a.side = b.side AND a.element < b.element
             GROUP BY ALL HAVING count(*) >= 4),
        p AS (SELECT l, r, round(max(distance) FILTER (side = 'A'), 6) AS rd, round(max(distance) FILTER (side = 'R'), 6) AS md FROM d GROUP BY l, r HAVING count(*) = 2),
        lv AS (SELECT p_brand AS element, 20 * log10(avg(l_extendedprice) FILTER (l_returnflag = 'A')) - 100 AS r, 20 * log10(avg(l_extendedprice) FILTER (l_returnflag = 'R')) - 100 AS m
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
        co AS (SELECT side, "case", 10 * log10(greatest(max(x * x) FILTER (n = 0), 1e-30) / greatest(max(x * x) FILTER (n = of - 1), 1e-30)) AS db FROM s1 GROUP BY side, "case"),
        cm AS (SELECT quantile_cont(db, 0.5) FILTER (side = 'reference') AS rv, quantile_cont(db, 0.5) FILTER (side = 'model') AS mv FROM co),
        u AS (SELECT l || '|' || r AS "case", 'element_distinctness_ratio' AS kind, rd AS rv, md AS mv FROM p
              UNION ALL SELECT p.l || '|' || p.r, 'element_gain_only_score', least(1.0, abs(b.r - a.r) / 6) / (1 + rd), least(1.0, abs(b.m - a.m) / 6) / (1 + md) FROM p JOIN lv a ON a.element = p.l JOIN lv b ON b.element = p.r
              UNION ALL SELECT '', 'element_carryover_db', rv, mv FROM cm)
        SELECT 'element' AS scope, "case", kind, round(rv, 6) + 0.0 AS reference_value, round(mv, 6) + 0.0 AS model_value, round(round(mv, 6) - round(rv, 6), 6) + 0.0 AS delta,
               CASE WHEN mv - rv IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability FROM u""",
)
def element_checks(spark, sf_dir):
    """Brands are elements; a user's views or clicks, from the first to the last, a transition."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("element"))
    side = F.when(F.col("l_returnflag") == "A", "reference").otherwise("model").alias("side")
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    levels = lines.groupBy("element", side).agg((20 * F.log10(F.avg("l_extendedprice")) - 100).alias("db"))
    power = lambda at: F.greatest(F.max(F.when(F.col("n") == at, F.col("x") * F.col("x"))), F.lit(1e-30))
    carry = sides(spark, sf_dir).groupBy("side", "case").agg((10 * F.log10(power(0) / power(F.col("of") - 1))).alias("db"))
    return P.element_checks(I.element_distances(traits(spark, sf_dir), "A", "R"), levels, carry)


@query(
    "render_shift_checks",
    f"""WITH {_SCAN}, {_BINS}, al AS (SELECT a."case", a.n, a.x AS a, b.x AS b FROM s1 a JOIN s1 b ON a."case" = b."case" AND a.n = b.n AND a.side = 'reference' AND b.side = 'model'),
        g AS ({_LAGS.format(key='"case"', left='al', right='al', r=8)}), k AS (SELECT "case", count(*) AS total FROM al GROUP BY "case"),
        s AS (SELECT g.*, round(abs(correlation) * pairs / total, 6) + 0.0 AS score FROM g JOIN k USING ("case") WHERE pairs >= 3 AND correlation IS NOT NULL AND NOT isnan(correlation)),
        best AS (SELECT "case", lag FROM s QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY score DESC, abs(lag), lag DESC) = 1),
        pk AS (SELECT "case", max(peak * 187.5::DOUBLE) FILTER (side = 'reference' AND peak > 0) AS r, max(peak * 187.5::DOUBLE) FILTER (side = 'model' AND peak > 0) AS m FROM e2 GROUP BY "case"),
        u AS (SELECT k."case", 'render_lag_samples' AS kind, CAST(lag AS DOUBLE) AS delta FROM k LEFT JOIN best USING ("case") UNION ALL SELECT "case", 'render_pitch_delta_cents', round(1200 * log2(m / r), 6) + 0.0 FROM pk)
        SELECT 'render' AS scope, "case", kind, NULL::DOUBLE AS reference_value, NULL::DOUBLE AS model_value, delta, CASE WHEN delta IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability FROM u""",
)
def render_shift_checks(spark, sf_dir):
    rows = sides(spark, sf_dir)
    r = rows.filter("side = 'reference'").select("case", "n", F.col("x").alias("a"))
    m = rows.filter("side = 'model'").select("case", "n", F.col("x").alias("b"))
    both = r.join(m, ["case", "n"])
    total = both.groupBy("case").agg(F.count(F.lit(1)).alias("total"))
    best = S.best_lag(S.lagged_correlation(both, ["case"], 8).join(total, ["case"]), ["case"], "total").select("case", "lag")
    peaks = spectra(spark, sf_dir).select("side", "case", (F.col("peak") * 187.5).alias("hz")).distinct()
    return P.shift_checks(total.select("case").join(best, "case", "left"), peaks)
