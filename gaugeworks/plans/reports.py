"""Run stages and gap reports over all sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.expr import tidy
from gaugeworks.operators import profiles as P
from gaugeworks.operators import reports as R
from gaugeworks.plans import profiles, signals
from gaugeworks.plans.profiles import _GAPS, KEYS
from gaugeworks.plans.registry import query, table

ROLES = ["view", "click", "signup", "purchase", "error"]
FEATURES = [("rms_dbfs", 0), ("crest_db", 0), *[("band_level_dbfs", k) for k in range(10)]]

_ROLE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END"
_RUN = f"""
    e AS (SELECT {_ROLE} AS role, ts < TIMESTAMP '2024-01-16' AS ref, user_id % 10 AS band, 'u' || (user_id % 3) AS c, value / 500 AS x FROM events),
    w AS (SELECT role, ref, 'rms_dbfs' AS kind, 0 AS idx, 20 * log10(sqrt(avg(x * x))) AS v FROM e GROUP BY ALL UNION ALL
          SELECT role, ref, 'crest_db', 0, 20 * log10(max(abs(x))) - 20 * log10(sqrt(avg(x * x))) FROM e GROUP BY role, ref UNION ALL
          SELECT role, ref, 'band_level_dbfs', band, 10 * log10(avg(x * x)) FROM e GROUP BY role, ref, band),
    cat AS (SELECT r AS role, k AS kind, i AS idx FROM range(1, 6) a(r), (SELECT 'rms_dbfs' AS k, 0 AS i UNION ALL SELECT 'crest_db', 0 UNION ALL SELECT 'band_level_dbfs', unnest(range(10)))),
    f AS (SELECT c.role, c.kind, CAST(c.idx AS BIGINT) AS idx, round(a.v, 6) + 0.0 AS reference_value, round(b.v, 6) + 0.0 AS model_value, round(b.v - a.v, 6) + 0.0 AS delta,
          round(least(abs(b.v - a.v) / 12, 1), 6) + 0.0 AS normalized_gap FROM cat c LEFT JOIN w a ON a.role = c.role AND a.kind = c.kind AND a.idx = c.idx AND a.ref
          LEFT JOIN w b ON b.role = c.role AND b.kind = c.kind AND b.idx = c.idx AND NOT b.ref),
    g AS (SELECT role, CASE WHEN count(normalized_gap) = 12 THEN avg(normalized_gap) END AS gap FROM f GROUP BY role),
    st AS (SELECT role - 1 AS stage, lag(gap) OVER (ORDER BY role) AS prior, gap FROM g),
    sg AS (SELECT stage, round(prior, 6) + 0.0 AS prior_gap, round(gap, 6) + 0.0 AS current_gap, round(gap - prior, 6) + 0.0 AS added_gap FROM st WHERE stage >= 1)"""


def _sides(spark, sf_dir, by: list[str]):
    """(role, by, kind, idx, a, b): each role's facts before (a) and after (b) mid-January."""
    role = F.coalesce(*[F.when(F.col("event_type") == r, k + 1) for k, r in enumerate(ROLES)])
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    case = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    e = table(spark, sf_dir, "events").select(role.cast("long").alias("role"), case.alias("case_id"), early.alias("ref"), (F.col("user_id") % 10).alias("band"), (F.col("value") / 500).alias("x"))
    e = e.withColumn("p", F.col("x") * F.col("x"))
    # one shuffle: band sums first, the role's facts from them
    bands = e.groupBy("role", *by, "ref", "band").agg(F.sum("p").alias("s"), F.count("p").alias("n"), F.max(F.abs("x")).alias("top"))
    whole = bands.groupBy("role", *by, "ref").agg((F.sum("s") / F.sum("n")).alias("p"), F.max("top").alias("top"))
    db = lambda p: 10 * F.log10(p)
    none = F.lit(0).cast("long").alias("idx")
    rms = whole.select("role", *by, "ref", F.lit("rms_dbfs").alias("kind"), none, db(F.col("p")).alias("v"))
    crest = whole.select("role", *by, "ref", F.lit("crest_db").alias("kind"), none, (20 * F.log10("top") - db(F.col("p"))).alias("v"))
    level = bands.select("role", *by, "ref", F.lit("band_level_dbfs").alias("kind"), F.col("band").alias("idx"), db(F.col("s") / F.col("n")).alias("v"))
    found = rms.unionByName(crest).unionByName(level)
    return found.groupBy("role", *by, "kind", "idx").agg(F.max(F.when(F.col("ref"), F.col("v"))).alias("a"), F.max(F.when(~F.col("ref"), F.col("v"))).alias("b"))


def _gap(a="a", b="b"):
    delta = F.col(b) - F.col(a)
    return F.when(delta.isNotNull(), F.least(F.abs(delta) / 12, F.lit(1.0)))


def run_facts(spark, sf_dir):
    """(role, kind, idx, reference_value, model_value, delta, normalized_gap): every role by
    every feature, whether there are samples or not."""
    catalog = spark.createDataFrame([(r + 1, k, i) for r in range(len(ROLES)) for k, i in FEATURES], "role long, kind string, idx long")
    return catalog.join(_sides(spark, sf_dir, []), ["role", "kind", "idx"], "left").select(
        "role", "kind", "idx", tidy(F.col("a")).alias("reference_value"), tidy(F.col("b")).alias("model_value"), tidy(F.col("b") - F.col("a")).alias("delta"), tidy(_gap()).alias("normalized_gap")
    )


def stages(facts, by=()):
    """The gap that each role adds to the one before; only roles with all features count."""
    role = facts.groupBy("role", *by).agg(F.when(F.count("normalized_gap") == len(FEATURES), F.avg("normalized_gap")).alias("gap"))
    w = W.partitionBy(*by).orderBy("role")
    before = F.when(F.lag("role").over(w) == F.col("role") - 1, F.lag("gap").over(w))
    rows = role.withColumn("prior", before).withColumn("stage", F.col("role") - 1).filter("stage >= 1")
    return rows.select("stage", *by, tidy(F.col("prior")).alias("prior_gap"), tidy(F.col("gap")).alias("current_gap"), tidy(F.col("gap") - F.col("prior")).alias("added_gap"))


@query("run_features", f"WITH {_RUN} SELECT * FROM f")
def run_features(spark, sf_dir):
    return run_facts(spark, sf_dir)


@query("stage_gaps", f"WITH {_RUN} SELECT *, CASE WHEN added_gap IS NULL THEN 0 ELSE row_number() OVER (ORDER BY added_gap IS NULL, added_gap DESC, stage) END AS rank FROM sg")
def stage_gaps(spark, sf_dir):
    from gaugeworks.operators.profiles import ranked

    return ranked(stages(run_facts(spark, sf_dir)), [F.desc("added_gap"), "stage"], "added_gap")


_CANDIDATES = f"""{_GAPS[_GAPS.index('base AS'):]}, {_RUN},
    cand AS (SELECT 'measure' AS source, selector || ':' || group_value || ':' || kind AS candidate, kind, 'measure:' || kind AS family,
               CASE kind WHEN 'l_quantity' THEN 'level' WHEN 'l_extendedprice' THEN 'pitch' WHEN 'l_discount' THEN 'timing' ELSE 'other' END AS metric,
               gap_score / nullif(valid_coverage, 0) AS raw_value, valid_coverage AS confidence, CASE WHEN valid_coverage < 1 THEN 1 ELSE 0 END AS flags FROM gap WHERE gap_score IS NOT NULL
             UNION ALL SELECT 'run', role || ':' || kind || ':' || idx, kind, 'run:' || kind || ':' || idx,
               CASE kind WHEN 'rms_dbfs' THEN 'level' WHEN 'crest_db' THEN 'crest' ELSE 'band:' || idx END, normalized_gap, 1.0, 0 FROM f WHERE normalized_gap IS NOT NULL
             UNION ALL SELECT 'stage', CAST(stage AS VARCHAR), 'stage', 'stage:' || stage, 'other', added_gap, 0.75, 0 FROM sg WHERE added_gap > 0),
    mc AS (SELECT selector || ':' || group_value || ':' || kind AS candidate, 'c' || line AS case_id, (avg(value) FILTER (side = 'R') - avg(value) FILTER (side = 'A')) / nullif(any_value(pooled), 0) AS v
           FROM obs JOIN gap USING (selector, group_value, kind) GROUP BY ALL),
    we AS (SELECT role, c, ref, 'rms_dbfs' AS kind, 0 AS idx, 20 * log10(sqrt(avg(x * x))) AS v FROM e GROUP BY ALL UNION ALL
           SELECT role, c, ref, 'crest_db', 0, 20 * log10(max(abs(x))) - 20 * log10(sqrt(avg(x * x))) FROM e GROUP BY role, c, ref UNION ALL
           SELECT role, c, ref, 'band_level_dbfs', band, 10 * log10(avg(x * x)) FROM e GROUP BY role, c, ref, band),
    wg AS (SELECT role, c, kind, idx, least(abs(max(v) FILTER (NOT ref) - max(v) FILTER (ref)) / 12, 1) AS g, max(v) FILTER (NOT ref) - max(v) FILTER (ref) IS NOT NULL AS there FROM we GROUP BY role, c, kind, idx),
    sgc AS (SELECT role, c, CASE WHEN count(*) FILTER (there) = 12 THEN avg(round(g, 6)) END AS gap FROM wg GROUP BY role, c),
    ss AS (SELECT b.role - 1 AS stage, b.c, b.gap - a.gap AS added FROM sgc b JOIN sgc a ON a.role = b.role - 1 AND a.c = b.c),
    cases AS (SELECT 'measure' AS source, candidate, case_id, v FROM mc UNION ALL SELECT 'run', role || ':' || kind || ':' || idx, c, CASE WHEN there THEN g END FROM wg UNION ALL SELECT 'stage', CAST(stage AS VARCHAR), c, added FROM ss),
    cv AS (SELECT source, candidate, case_id, confidence, round(v, 6) + 0.0 AS value, round(least(abs(round(v, 6)), 1) * confidence, 6) + 0.0 AS case_score FROM cases JOIN cand USING (source, candidate) WHERE v IS NOT NULL),
    occ AS (SELECT source, candidate, round(avg(CASE WHEN abs(value) >= 1.0 / 12 THEN 1.0 ELSE 0.0 END), 6) AS occurrence FROM cv GROUP BY ALL),
    aud AS (SELECT c.*, o.occurrence, least(abs(raw_value), 1.0) AS size, confidence / (1 + bit_count(flags)) AS confidence_factor,
            CASE metric WHEN 'level' THEN 0.85::DOUBLE WHEN 'crest' THEN 0.75 WHEN 'pitch' THEN 1.0 WHEN 'timing' THEN 1.0 WHEN 'other' THEN 0.7
            ELSE [0.25, 0.35, 0.55, 0.75, 0.90, 1.0, 1.0, 0.90, 0.70, 0.45][CAST(split_part(metric, ':', 2) AS INT) + 1] END AS audibility FROM cand c LEFT JOIN occ o USING (source, candidate)),
    sc AS (SELECT *, round(size * audibility * coalesce(occurrence, 0) * confidence_factor, 6) + 0.0 AS score FROM aud),
    pr AS (SELECT *, row_number() OVER (PARTITION BY source, family ORDER BY score IS NULL, score DESC, kind, candidate) = 1 AS "primary" FROM sc)"""


def all_cases(spark, sf_dir):
    """The candidates of the measurement, run and stage sources in one form, each with its
    cases: a line number, or a third of the users, in which reference and model are met."""
    gaps = profiles.ranked_gaps(spark, sf_dir).filter("gap_score is not null")
    metric = F.when(F.col("kind") == "l_quantity", "level").when(F.col("kind") == "l_extendedprice", "pitch").when(F.col("kind") == "l_discount", "timing").otherwise("other")
    cover = F.col("valid_coverage")
    both = F.col("r_valid_count") + F.col("m_valid_count")
    pooled = F.sqrt((F.col("r_valid_count") * F.col("r_population_sd") ** 2 + F.col("m_valid_count") * F.col("m_population_sd") ** 2) / both)
    measure = gaps.select(
        *KEYS,
        F.lit("measure").alias("source"),
        F.concat_ws(":", *KEYS).alias("candidate"),
        F.concat(F.lit("measure:"), "kind").alias("family"),
        metric.alias("metric"),
        (F.col("gap_score") / F.when(cover != 0, cover)).alias("raw_value"),
        cover.alias("confidence"),
        F.when(cover < 1, 1).otherwise(0).alias("flags"),
        F.when(pooled > 0, pooled).alias("pooled"),
    )
    # sums by all labels at once, and of these the selectors' groups
    parts = profiles.observations(spark, sf_dir).groupBy("side", "kind", "line", *profiles.LABELS).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    total = lambda c, side: F.sum(F.when((F.col("side") == side) & (F.col("n") > 0), F.col(c)))
    mean = lambda side: total("s", side) / total("n", side)
    lines = P.by_selector(parts, ["kind", "line"], profiles.LABELS, mean("A").alias("a"), mean("R").alias("b"))
    lines = lines.withColumn("case_id", F.concat(F.lit("c"), F.col("line").cast("string"))).drop("line")
    facts = run_facts(spark, sf_dir)
    name = F.when(F.col("kind") == "rms_dbfs", "level").when(F.col("kind") == "crest_db", "crest").otherwise(F.concat(F.lit("band:"), F.col("idx").cast("string")))
    run = facts.filter("normalized_gap is not null").select(
        "role",
        "kind",
        "idx",
        F.lit("run").alias("source"),
        F.concat_ws(":", "role", "kind", "idx").alias("candidate"),
        F.concat_ws(":", F.lit("run"), "kind", "idx").alias("family"),
        name.alias("metric"),
        F.col("normalized_gap").alias("raw_value"),
        F.lit(1.0).alias("confidence"),
        F.lit(0).alias("flags"),
    )
    thirds = _sides(spark, sf_dir, ["case_id"]).withColumn("normalized_gap", tidy(_gap()))
    stage = stages(facts).filter("added_gap > 0").select(
        "stage",
        F.lit("stage").alias("source"),
        F.col("stage").cast("string").alias("candidate"),
        F.lit("stage").alias("kind"),
        F.concat(F.lit("stage:"), F.col("stage").cast("string")).alias("family"),
        F.lit("other").alias("metric"),
        F.col("added_gap").alias("raw_value"),
        F.lit(0.75).alias("confidence"),
        F.lit(0).alias("flags"),
    )
    return R.union(
        [
            R.with_cases(measure, lines, KEYS, (F.col("b") - F.col("a")) / F.col("pooled")),
            R.with_cases(run, thirds.drop("a", "b"), ["role", "kind", "idx"], F.col("normalized_gap")),
            R.with_cases(stage, stages(thirds, ["case_id"]).select("stage", "case_id", F.col("added_gap").alias("apart")), ["stage"], F.col("apart")),
        ]
    )


@query(
    "candidate_score",
    f"""WITH {_CANDIDATES}, rk AS (SELECT source, candidate, row_number() OVER (ORDER BY score IS NULL, score DESC, size DESC, occurrence DESC, confidence_factor DESC, family, source, kind, candidate) AS rank
            FROM pr WHERE "primary" AND score IS NOT NULL)
        SELECT pr.source, pr.candidate, family, metric, round(size, 6) + 0.0 AS size, audibility, occurrence, round(confidence_factor, 6) + 0.0 AS confidence_factor, score, "primary",
               coalesce(rk.rank, 0) AS rank FROM pr LEFT JOIN rk USING (source, candidate)""",
)
def candidate_score(spark, sf_dir):
    scored = R.primaries(R.score_candidates(all_cases(spark, sf_dir)))
    return scored.select("source", "candidate", "family", "metric", tidy(F.col("size")).alias("size"), "audibility", "occurrence", tidy(F.col("confidence_factor")).alias("confidence_factor"), "score", "primary", "rank")


@query("family_primary", f'WITH {_CANDIDATES} SELECT source, family, candidate, score FROM pr WHERE "primary"')
def family_primary(spark, sf_dir):
    return R.primaries(R.score_candidates(all_cases(spark, sf_dir))).filter("primary").select("source", "family", "candidate", "score")


_LABELS = """lb AS (SELECT * FROM (VALUES ('c1', 'low', 'bass', 'p', 'slide', 'string'), ('c2', 'mid', 'tenor', 'f', 'slide', NULL), ('u0', 'high', NULL, 'f', 'hold', 'air')) t(case_id, pitch, register, "dynamic", gesture, element))"""


def labels(spark):
    rows = [("c1", "low", "bass", "p", "slide", "string", None), ("c2", "mid", "tenor", "f", "slide", None, None), ("u0", "high", None, "f", "hold", "air", None)]
    return spark.createDataFrame(rows, "case_id string, " + ", ".join(f"{a} string" for a in R.AXES))


@query(
    "axis_groups",
    f"""WITH {_CANDIDATES}, {_LABELS}, j AS (SELECT cv.*, coalesce(pitch, 'unlabelled') AS pitch, coalesce(register, 'unlabelled') AS register, coalesce("dynamic", 'unlabelled') AS dyn,
            coalesce(gesture, 'unlabelled') AS gesture, coalesce(element, 'unlabelled') AS element FROM cv LEFT JOIN lb USING (case_id)),
        u AS (SELECT source, candidate, case_score, unnest(['pitch', 'register', 'dynamic', 'gesture', 'element', 'section']) AS axis, unnest([pitch, register, dyn, gesture, element, 'unlabelled']) AS axis_value FROM j),
        b AS (SELECT axis, axis_value, source, candidate, max(case_score) AS best FROM u GROUP BY ALL)
        SELECT axis, axis_value, count(*) AS candidates, round(quantile_cont(best, 0.05), 8) + 0.0 AS q05, round(quantile_cont(best, 0.25), 8) + 0.0 AS q25, round(quantile_cont(best, 0.5), 8) + 0.0 AS q50,
               round(quantile_cont(best, 0.75), 8) + 0.0 AS q75, round(quantile_cont(best, 0.95), 8) + 0.0 AS q95, round(quantile_cont(best, 0.95) - quantile_cont(best, 0.05), 8) + 0.0 AS spread
        FROM b GROUP BY axis, axis_value""",
)
def axis_groups(spark, sf_dir):
    return R.axis_groups(R.label_cases(all_cases(spark, sf_dir), labels(spark), ["case_id"]))


@query("worst_cases", f"WITH {_CANDIDATES} SELECT source, candidate, case_id, value, case_score FROM cv ORDER BY case_score DESC, abs(value) DESC, confidence DESC, source, candidate, case_id LIMIT 20")
def worst_cases(spark, sf_dir):
    return R.worst_cases(all_cases(spark, sf_dir)).select("source", "candidate", "case_id", "value", "case_score")


@query(
    "warnings_union",
    f"""WITH {_CANDIDATES}
        SELECT 'low_coverage' AS code, 'a side misses values' AS message, selector || ':' || group_value || ':' || kind AS reference FROM gap WHERE valid_coverage < 0.92 UNION ALL
        SELECT 'saturated', 'a gap is at its limit', role || ':' || kind || ':' || idx FROM f WHERE normalized_gap >= 1 UNION ALL
        SELECT 'no_added_gap', 'a stage adds nothing', CAST(stage AS VARCHAR) FROM sg WHERE added_gap <= 0""",
)
def warnings_union(spark, sf_dir):
    facts = run_facts(spark, sf_dir)
    return R.warnings(
        [
            (profiles.ranked_gaps(spark, sf_dir).filter("valid_coverage < 0.92"), "low_coverage", "a side misses values", F.concat_ws(":", *KEYS)),
            (facts.filter("normalized_gap >= 1"), "saturated", "a gap is at its limit", F.concat_ws(":", "role", "kind", "idx")),
            (stages(facts).filter("added_gap <= 0"), "no_added_gap", "a stage adds nothing", F.col("stage")),
        ]
    )


@query(
    "saved_equals_derived",
    """WITH s AS (SELECT user_id, count(*) AS samples FROM events GROUP BY user_id)
       SELECT user_id, samples + unnest([0, 1]) AS samples, unnest([-1::BIGINT, 1]) AS surplus FROM s WHERE user_id % 7 = 3""",
)
def saved_equals_derived(spark, sf_dir):
    """Counts per user made in two ways, of which one has been changed for every seventh
    user: the rows that either has alone, and no others."""
    one = signals.samples(spark, sf_dir).groupBy("user_id").agg((F.count(F.lit(1)) + F.when(F.col("user_id") % 7 == 3, 1).otherwise(0)).alias("samples"))
    two = signals.samples(spark, sf_dir).groupBy("user_id").agg((F.max("n") + 1).cast("long").alias("samples"))
    return R.same_rows(one, two)
