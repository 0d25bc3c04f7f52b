"""Signal queries: each user's events, in order, stand for a sample stream."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import expr as E
from gaugeworks.functions.expr import tidy
from gaugeworks.functions.stats import correlation
from gaugeworks.operators import series as S
from gaugeworks.plans.registry import query, table

KEY = ["user_id"]
_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"

#: Samples: value less the user's mean, in hundredths, numbered by time.
_X = """
    mean AS (SELECT user_id, round(avg(value), 3) AS m, min(epoch_us(ts)) AS t0 FROM events GROUP BY user_id),
    x AS (SELECT user_id, event_id, event_type, round((value - m) / 100, 6) AS x, (epoch_us(ts) - t0) / 3.6e9 AS t, epoch_us(ts) AS us,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events JOIN mean USING (user_id))"""
_DB = "CASE WHEN {p} > 1e-30 THEN 10 * log10({p}) ELSE -300 END"


def db(p: str) -> str:
    return f"(CASE WHEN {p} > 1e-30 THEN 10 * log10({p}) ELSE -300.0 END)"


def samples(spark, sf_dir):
    """(user_id, event_id, event_type, n, x, t, us): x in hundredths about the mean, t in hours."""
    events = table(spark, sf_dir, "events").withColumn("us", F.expr(_US))
    # the mean is rounded, often at a half, so its last bits count: values are added in their order
    whole = W.partitionBy(*KEY).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = events.select("user_id", "event_id", "event_type", "value", "us", "ts", E.rounded(F.avg("value").over(whole), 3).alias("m"), F.min("us").over(whole).alias("t0"))
    rows = rows.withColumn("x", E.rounded((F.col("value") - F.col("m")) / 100, 6)).withColumn("t", (F.col("us") - F.col("t0")) / 3.6e9)
    return S.numbered(rows, KEY, ["ts", "event_id"]).drop("m", "t0", "value", "ts")


@query(
    "level_facts",
    f"""WITH {_X}, s AS (SELECT *, CASE WHEN x <> 0 THEN sign(x) END AS sg FROM x),
        z AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
        SELECT user_id, count(*) AS samples, round(max(abs(x)), 6) + 0.0 AS peak, round(sqrt(avg(x * x)), 6) + 0.0 AS rms, round(avg(x), 6) + 0.0 AS dc,
               round({db('max(abs(x)) * max(abs(x))')} - {db('(sqrt(avg(x * x)) * sqrt(avg(x * x)))')}, 6) + 0.0 AS crest_db,
               CAST(count(*) FILTER (sg <> before) AS BIGINT) AS zero_crossings, CAST(count(*) FILTER (abs(x) >= 1) AS BIGINT) AS clipped
        FROM z GROUP BY user_id""",
)
def level_facts(spark, sf_dir):
    return S.level_facts(samples(spark, sf_dir), KEY, 1.0)


@query(
    "level_slopes",
    f"""WITH {_X}, y AS (SELECT *, {db('x * x')} AS y FROM x)
        SELECT user_id, count(*) AS points, round(regr_slope(y, t), 6) + 0.0 AS slope, round(stddev_pop(y), 6) + 0.0 AS spread,
               round(max_by(y, n) - min_by(y, n), 6) + 0.0 AS fall, round(regr_r2(y, t), 6) + 0.0 AS r_squared FROM y GROUP BY user_id""",
)
def level_slopes(spark, sf_dir):
    return S.slopes(samples(spark, sf_dir).withColumn("y", E.amplitude_db(F.col("x"))), KEY)


_MOVING = f"""{_X}, w AS (SELECT user_id, n, CASE WHEN n >= 3 THEN avg(x * x) OVER (PARTITION BY user_id ORDER BY n ROWS 3 PRECEDING) END AS mp,
    CASE WHEN n >= 29 AND (n - 29) % 10 = 0 THEN avg(x * x) OVER (PARTITION BY user_id ORDER BY n ROWS 29 PRECEDING) END AS sp FROM x),
    mv AS (SELECT user_id, n, mp, sp, CASE WHEN mp IS NOT NULL THEN round(-0.691 + {db('mp')}, 6) + 0.0 END AS momentary_lufs,
    CASE WHEN sp IS NOT NULL THEN round(-0.691 + {db('sp')}, 6) + 0.0 END AS short_lufs FROM w)"""


def steps(spark, sf_dir):
    return samples(spark, sf_dir).select("user_id", "n", (F.col("x") * F.col("x")).alias("p"))


@query("moving_loudness", f"WITH {_MOVING} SELECT user_id, n, momentary_lufs, short_lufs FROM mv")
def moving_loudness(spark, sf_dir):
    return S.moving_loudness(steps(spark, sf_dir), KEY).select("user_id", "n", "momentary_lufs", "short_lufs")


_BIN = "round(-120.0 + (least(greatest(floor(({v} + 120) / 0.1), 0), 1600) + 0.5) * 0.1, 6)"


@query(
    "loudness_range",
    f"""WITH {_MOVING}, b AS (SELECT *, {_BIN.format(v='momentary_lufs')} AS mb, {_BIN.format(v='short_lufs')} AS sb FROM mv),
        g AS (SELECT user_id, round(greatest(-70.0, -0.691 + {db('avg(mp) FILTER (mb >= -70)')} - 10), 6) AS gate FROM b GROUP BY user_id),
        i AS (SELECT user_id, round(-0.691 + {db('avg(mp) FILTER (mb >= gate)')}, 6) + 0.0 AS integrated_lufs FROM b JOIN g USING (user_id) GROUP BY user_id),
        c AS (SELECT user_id, sb, count(*) AS c FROM b JOIN i USING (user_id) WHERE sb >= greatest(-70.0, coalesce(integrated_lufs - 20, -70.0)) GROUP BY user_id, sb),
        u AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY sb) AS upto, sum(c) OVER (PARTITION BY user_id) AS n FROM c),
        r AS (SELECT user_id, CASE WHEN max(n) >= 2 THEN round(min(sb) FILTER (upto >= ceil(n * 0.95)) - min(sb) FILTER (upto >= ceil(n * 0.1)), 6) + 0.0 END
              AS loudness_range_lu FROM u GROUP BY user_id)
        SELECT user_id, integrated_lufs, loudness_range_lu FROM i LEFT JOIN r USING (user_id)""",
)
def loudness_range(spark, sf_dir):
    return S.gated_loudness(S.moving_loudness(steps(spark, sf_dir), KEY), KEY)


@query(
    "activity_blocks",
    f"""WITH {_X}, b AS (SELECT user_id, n // 10 AS b, avg(x * x) AS p FROM x GROUP BY ALL), s AS (SELECT *, round({db('p')}, 6) < -15.0 AS silent FROM b)
        SELECT user_id, count(*) AS blocks, round(avg(CASE WHEN silent THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS silence_fraction,
               min(b) FILTER (NOT silent) AS first_active, max(b) FILTER (NOT silent) AS last_active FROM s GROUP BY user_id""",
)
def activity_blocks(spark, sf_dir):
    return S.activity(samples(spark, sf_dir), KEY, 10, -15.0)


@query(
    "change_scan",
    f"""WITH {_X}, q AS (SELECT user_id, n, round(x, 1) AS x FROM x),
        l AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY n) AS prev, count(*) OVER (PARTITION BY user_id) AS k FROM q),
        f AS (SELECT user_id, round(count(*) FILTER (x = prev AND x <> 0) / count(*), 6) + 0.0 AS stuck_fraction,
              round({db('max(abs(x - prev)) * max(abs(x - prev))')}, 6) + 0.0 AS max_step_db,
              round(avg(x) FILTER (n >= k - k // 10) - avg(x) FILTER (n < k // 10), 6) + 0.0 AS dc_drift,
              round({db('(sqrt(avg(x * x) FILTER (n >= k - k // 10)) * sqrt(avg(x * x) FILTER (n >= k - k // 10)))')}, 6) + 0.0 AS return_level_db
              FROM l GROUP BY user_id),
        b AS (SELECT user_id, n // 2 AS b, list(x ORDER BY n) AS xs FROM q GROUP BY ALL HAVING count(*) = 2 AND max(abs(x)) > 0),
        r AS (SELECT user_id, b, coalesce(xs = lag(xs) OVER (PARTITION BY user_id ORDER BY b), false) AS again FROM b),
        s AS (SELECT user_id, round(avg(CASE WHEN again THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS repeated_block_fraction FROM r GROUP BY user_id)
        SELECT user_id, stuck_fraction, max_step_db, dc_drift, return_level_db, repeated_block_fraction FROM f LEFT JOIN s USING (user_id)""",
)
def change_scan(spark, sf_dir):
    return S.change_scan(samples(spark, sf_dir).withColumn("x", E.rounded(F.col("x"), 1)), KEY, 2)


def _spans(spark, sf_dir):
    """An event lasts value minutes."""
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", F.expr(_US).alias("start"), (F.expr(_US) + F.floor(F.col("value") * 6e7).cast("long")).alias("end"))


_SPANS = "sp AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 6e7) AS BIGINT) AS e FROM events)"


@query(
    "interval_overlap",
    f"""WITH {_SPANS}, pt AS (SELECT user_id, pos, sum(step) AS step FROM (SELECT user_id, s AS pos, 1 AS step FROM sp UNION ALL SELECT user_id, e, -1 FROM sp) GROUP BY ALL),
        d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS until FROM pt),
        i AS (SELECT *, CASE WHEN (depth >= 2) = lag(depth >= 2) OVER (PARTITION BY user_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM d),
        g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM i)
        SELECT user_id, min(pos) AS region_start, max(until) AS region_end, CAST(max(depth) AS BIGINT) AS depth FROM g WHERE depth >= 2 GROUP BY user_id, island""",
)
def interval_overlap(spark, sf_dir):
    return S.overlaps(_spans(spark, sf_dir), KEY)


@query(
    "transition_roles",
    f"""WITH {_SPANS}, n AS (SELECT *, lead(s) OVER w AS next_start, lead(event_id) OVER w AS next_id FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
        SELECT user_id, event_id, next_id, CASE WHEN event_type = 'signup' THEN 'restart' WHEN abs(next_start - e) < 5000000 THEN 'touch'
               WHEN next_start > e THEN 'gap' ELSE 'overlap' END AS role, round((next_start - e) / 1e6, 6) + 0.0 AS gap_seconds FROM n WHERE next_id IS NOT NULL""",
)
def transition_roles(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("start", "event_id")
    rows = _spans(spark, sf_dir).withColumn("next_start", F.lead("start").over(w)).withColumn("next_id", F.lead("event_id").over(w)).filter("next_id is not null")
    gap = F.col("next_start") - F.col("end")
    # a label of its own wins over what the times say
    role = F.when(F.col("event_type") == "signup", "restart").when(F.abs(gap) < 5_000_000, "touch").when(gap > 0, "gap").otherwise("overlap")
    return rows.select("user_id", "event_id", "next_id", role.alias("role"), tidy(gap / 1e6).alias("gap_seconds"))


@query(
    "unmatched_islands",
    f"""WITH {_X}, u AS (SELECT user_id, n, us, event_type IN ('error', 'signup') AS free, event_type, abs(x) < 0.02 AS quiet FROM x),
        i AS (SELECT *, CASE WHEN free = lag(free) OVER (PARTITION BY user_id ORDER BY n) THEN 0 ELSE 1 END AS turn FROM u),
        g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY n) AS island FROM i)
        SELECT user_id, min(us) AS span_start, max(us) AS span_end, count(*) AS steps,
               CASE WHEN bool_or(event_type = 'error') THEN 'fault' WHEN bool_and(quiet) THEN 'rest' ELSE 'insertion' END AS reason
        FROM g WHERE free GROUP BY user_id, island""",
)
def unmatched_islands(spark, sf_dir):
    free = F.col("event_type").isin("error", "signup")
    runs = S.islands(samples(spark, sf_dir), KEY, ["n"], free).filter(free)
    reason = F.when(F.bool_or(F.col("event_type") == "error"), "fault").when(F.bool_and(F.abs("x") < 0.02), "rest").otherwise("insertion")
    return runs.groupBy("user_id", "island").agg(F.min("us").alias("span_start"), F.max("us").alias("span_end"), F.count(F.lit(1)).alias("steps"), reason.alias("reason")).drop("island")


@query(
    "tempo_asof",
    """WITH p AS (SELECT o_orderstatus AS part, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS beat, 60.0 + count(*) % 120 AS bpm FROM orders GROUP BY ALL),
       l AS (SELECT *, lead(beat) OVER w AS until, (lead(beat) OVER w - beat) * 60 / bpm AS lasts FROM p WINDOW w AS (PARTITION BY part ORDER BY beat)),
       t AS (SELECT *, coalesce(sum(lasts) OVER (PARTITION BY part ORDER BY beat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seconds FROM l),
       q AS (SELECT o_orderkey, o_orderstatus AS part, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) + (day(o_orderdate) - 1) / 31 AS pos FROM orders),
       j AS (SELECT q.o_orderkey, q.pos, t.beat, t.bpm, t.seconds FROM q ASOF JOIN t ON q.part = t.part AND q.pos >= t.beat)
       SELECT o_orderkey, round(pos, 6) + 0.0 AS beat, round(seconds + (pos - beat) * 60 / bpm, 6) + 0.0 AS seconds,
              round(beat + (seconds + (pos - beat) * 60 / bpm - seconds) * bpm / 60, 6) + 0.0 AS beat_again FROM j""",
)
def tempo_asof(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    points = orders.groupBy(F.col("o_orderstatus").alias("part"), month.cast("double").alias("beat")).agg((60.0 + F.count(F.lit(1)) % 120).alias("bpm"))
    spans = S.tempo_spans(points, ["part"])
    notes = orders.select("o_orderkey", F.col("o_orderstatus").alias("part"), (month + (F.day("o_orderdate") - 1) / 31).alias("at"))
    placed = S.interval_join(notes, spans, ["part"], "at", "beat", "until", 1.0)
    seconds = E.beats_to_seconds(F.col("at"), F.col("beat"), F.col("seconds"), F.col("bpm"))
    return placed.withColumn("s", seconds).select(
        "o_orderkey",
        tidy(F.col("at")).alias("beat"),
        tidy(F.col("s")).alias("seconds"),
        tidy(E.seconds_to_beats(F.col("s"), F.col("beat"), F.col("seconds"), F.col("bpm"))).alias("beat_again"),
    )


_LAGS = """SELECT {key}, lag, count(*) AS pairs, round(corr(l.a, r.b), 6) + 0.0 AS correlation
    FROM {left} l JOIN (SELECT {key}, unnest(range(-{r}, {r} + 1)) AS lag, n AS m, b FROM {right} WHERE b IS NOT NULL) r USING ({key})
    WHERE a IS NOT NULL AND l.n = r.m - r.lag GROUP BY ALL"""


@query(
    "lag_link",
    f"""WITH h AS (SELECT user_id, epoch_us(ts) // 86400000000 AS n, sum(value) FILTER (event_type IN ('click', 'view')) AS a, sum(value) FILTER (event_type = 'error') AS b
                   FROM events GROUP BY ALL),
        g AS ({_LAGS.format(key='user_id', left='h', right='h', r=5)}), k AS (SELECT user_id, count(a) AS total FROM h GROUP BY user_id),
        s AS (SELECT g.*, round(abs(correlation) * pairs / total, 6) + 0.0 AS score FROM g JOIN k USING (user_id) WHERE pairs >= 3 AND correlation IS NOT NULL AND NOT isnan(correlation))
        SELECT user_id, lag, pairs, correlation, score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, abs(lag), lag DESC) = 1""",
)
def lag_link(spark, sf_dir):
    day = F.floor(F.expr(_US) / 86_400_000_000).alias("n")
    pick = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")))
    days = table(spark, sf_dir, "events").groupBy("user_id", day).agg(pick("click", "view").alias("a"), pick("error").alias("b"))
    total = days.groupBy("user_id").agg(F.count("a").alias("total"))
    return S.best_lag(S.lagged_correlation(days, KEY, 5).join(total, KEY), KEY, "total").select("user_id", "lag", "pairs", "correlation", "score")


@query(
    "delay_estimate",
    f"""WITH {_X}, e AS (SELECT user_id, n, x AS a, lag(x, 2) OVER (PARTITION BY user_id ORDER BY n) + x * 0.1 AS b FROM x),
        g AS ({_LAGS.format(key='user_id', left='e', right='e', r=4)}), k AS (SELECT user_id, count(*) AS total FROM e GROUP BY user_id),
        s AS (SELECT g.*, round(abs(correlation) * pairs / total, 6) + 0.0 AS score FROM g JOIN k USING (user_id) WHERE pairs >= 3 AND correlation IS NOT NULL AND NOT isnan(correlation))
        SELECT user_id, lag, pairs, correlation, score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, abs(lag), lag DESC) = 1""",
)
def delay_estimate(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("n")
    rows = samples(spark, sf_dir).select("user_id", "n", F.col("x").alias("a"), (F.lag("x", 2).over(w) + F.col("x") * 0.1).alias("b"))
    total = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return S.best_lag(S.lagged_correlation(rows, KEY, 4).join(total, KEY), KEY, "total").select("user_id", "lag", "pairs", "correlation", "score")


@query(
    "streaming_moments",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(var_samp(value), 6) AS sample_variance,
              round(covar_pop(value, user_id), 6) AS covariance, round(covar_samp(value, user_id), 6) AS sample_covariance, round(corr(value, user_id), 6) + 0.0 AS correlation
       FROM events GROUP BY event_type""",
)
def streaming_moments(spark, sf_dir):
    pair = (F.col("value"), F.col("user_id").cast("double"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        tidy(F.avg("value")).alias("mean"),
        tidy(F.var_pop("value")).alias("variance"),
        tidy(F.var_samp("value")).alias("sample_variance"),
        tidy(F.covar_pop(*pair)).alias("covariance"),
        tidy(F.covar_samp(*pair)).alias("sample_covariance"),
        tidy(F.corr(*pair)).alias("correlation"),
    )


@query(
    "channel_mix",
    """WITH c AS (SELECT user_id, epoch_us(ts) // 3600000000 AS frame, event_type AS channel, avg(value) / 100 AS x FROM events GROUP BY ALL)
       SELECT user_id, frame, count(*) AS channels, round(avg(x), 6) + 0.0 AS mixed, abs(round(avg(x), 6)) >= 1 AS clipped FROM c GROUP BY ALL""",
)
def channel_mix(spark, sf_dir):
    frame = F.floor(F.expr(_US) / 3_600_000_000).alias("frame")
    channels = table(spark, sf_dir, "events").groupBy("user_id", frame, "event_type").agg((F.avg("value") / 100).alias("x"))
    mixed = tidy(F.avg("x"))
    return channels.groupBy("user_id", "frame").agg(F.count(F.lit(1)).alias("channels"), mixed.alias("mixed"), (F.abs(mixed) >= 1).alias("clipped"))


@query(
    "stereo_facts",
    f"""WITH {_X}, lr AS (SELECT user_id, n // 2 AS f, max(x) FILTER (n % 2 = 0) AS l, max(x) FILTER (n % 2 = 1) AS r FROM x GROUP BY ALL)
        SELECT user_id, count(*) AS frames, round(sqrt(avg(((l + r) / 2) ** 2)), 6) + 0.0 AS mid_rms, round(sqrt(avg(((l - r) / 2) ** 2)), 6) + 0.0 AS side_rms,
               round({db('avg(r * r)')} - {db('avg(l * l)')}, 6) + 0.0 AS balance_db, round(sqrt(avg(((l - r) / 2) ** 2)) / sqrt(avg(((l + r) / 2) ** 2)), 6) + 0.0 AS width,
               round(corr(l, r), 6) + 0.0 AS correlation FROM lr WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY user_id HAVING count(*) >= 3""",
)
def stereo_facts(spark, sf_dir):
    side = lambda k: F.max(F.when(F.col("n") % 2 == k, F.col("x")))
    frames = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("n") / 2).alias("f")).agg(side(0).alias("l"), side(1).alias("r"))
    rms = lambda c: F.sqrt(F.avg(c * c))
    left, right = F.col("l"), F.col("r")
    mid, wide = rms((left + right) / 2), rms((left - right) / 2)
    facts = frames.filter("l is not null and r is not null").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("frames"),
        tidy(mid).alias("mid_rms"),
        tidy(wide).alias("side_rms"),
        tidy(E.power_db(F.avg(right * right)) - E.power_db(F.avg(left * left))).alias("balance_db"),
        tidy(wide / F.when(mid > 0, mid)).alias("width"),
        tidy(correlation("l", "r")).alias("correlation"),
    )
    return facts.filter("frames >= 3")


@query(
    "rise_times",
    f"""WITH {_X}, b AS (SELECT user_id, n // 20 AS item, n % 20 AS k, abs(x) AS v FROM x), r AS (SELECT *, v / max(v) OVER (PARTITION BY user_id, item) AS rel FROM b)
        SELECT user_id, item, min(k) FILTER (rel >= 0.1) AS rise_10, min(k) FILTER (rel >= 0.5) AS rise_50, min(k) FILTER (rel >= 0.9) AS rise_90,
               round(max(v) - avg(v) FILTER (k >= 16), 6) + 0.0 AS overshoot FROM r GROUP BY ALL""",
)
def rise_times(spark, sf_dir):
    """First crossings of 10, 50 and 90 per cent of each item's largest value."""
    item = F.floor(F.col("n") / 20)
    rows = samples(spark, sf_dir).select("user_id", item.alias("item"), (F.col("n") % 20).alias("k"), F.abs("x").alias("v"))
    top = F.max("v").over(W.partitionBy("user_id", "item"))
    rows = rows.withColumn("rel", F.col("v") / F.when(top > 0, top))
    first = lambda p: F.min(F.when(F.col("rel") >= p, F.col("k")))
    return rows.groupBy("user_id", "item").agg(
        first(0.1).alias("rise_10"), first(0.5).alias("rise_50"), first(0.9).alias("rise_90"), tidy(F.max("v") - F.avg(F.when(F.col("k") >= 16, F.col("v")))).alias("overshoot")
    )


@query(
    "settle_time",
    f"""WITH {_X}, m AS (SELECT *, avg(x) OVER (PARTITION BY user_id) AS mean FROM x), i AS (SELECT user_id, n, t, abs(round(x - mean, 6)) <= 0.15 AS calm FROM m),
        r AS (SELECT *, lead(calm) OVER w AS c1, lead(calm, 2) OVER w AS c2 FROM i WINDOW w AS (PARTITION BY user_id ORDER BY n))
        SELECT user_id, round(min(t) FILTER (calm AND c1 AND c2), 6) + 0.0 AS settle_hours FROM r GROUP BY user_id""",
)
def settle_time(spark, sf_dir):
    """Time of the first of three points in a row that stay near the mean."""
    w = W.partitionBy("user_id").orderBy("n")
    calm = F.abs(F.round(F.col("x") - F.avg("x").over(W.partitionBy("user_id")), 6)) <= 0.15
    rows = samples(spark, sf_dir).withColumn("calm", calm)
    run = F.col("calm") & F.lead("calm").over(w) & F.lead("calm", 2).over(w)
    return rows.withColumn("run", run).groupBy("user_id").agg(tidy(F.min(F.when(F.col("run"), F.col("t")))).alias("settle_hours"))


@query(
    "track_resample",
    """SELECT user_id, epoch_us(ts) // 21600000000 AS bucket, count(*) AS points, round(avg(value), 6) + 0.0 AS energy, round(max(value), 6) + 0.0 AS onset,
              round(((atan2(sum(value * sin(2 * pi() * (event_id % 12) / 12)), sum(value * cos(2 * pi() * (event_id % 12) / 12))) * 12 / (2 * pi())) + 12) % 12, 4) % 12 AS pitch_class
       FROM events GROUP BY ALL""",
)
def track_resample(spark, sf_dir):
    """Tumbling buckets of a track; the pitch class is a weighted circular mean."""
    turn = 2 * F.pi() * (F.col("event_id") % 12) / 12
    mean = F.atan2(F.sum(F.col("value") * F.sin(turn)), F.sum(F.col("value") * F.cos(turn))) * 12 / (2 * F.pi())
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.expr(_US) / 21_600_000_000).alias("bucket")).agg(
        F.count(F.lit(1)).alias("points"), tidy(F.avg("value")).alias("energy"), tidy(F.max("value")).alias("onset"), (F.round((mean + 12) % 12, 4) % 12).alias("pitch_class")
    )


@query(
    "sliding_rms",
    f"""WITH {_X}, k AS (SELECT user_id, max(n) + 1 AS of FROM x GROUP BY user_id), f AS (SELECT user_id, unnest(range(0, of // 5)) AS frame, of FROM k),
        p AS (SELECT f.user_id, f.frame, sum(x.x ** 2) / 10 AS p, count(*) AS c FROM f JOIN x ON x.user_id = f.user_id AND x.n >= 5 * f.frame AND x.n < 5 * f.frame + 10 GROUP BY f.user_id, f.frame)
        SELECT user_id, frame, round(sqrt(p), 6) + 0.0 AS rms, round({db('p')}, 6) + 0.0 AS level_db FROM p WHERE c = 10""",
)
def sliding_rms(spark, sf_dir):
    """Windows of ten samples every five."""
    return S.sliding_rms(samples(spark, sf_dir), KEY, 5)


_PITCHES = "pf AS (SELECT user_id, n, n // 8 AS pair, 440 * pow(2, x / 2) AS pitch_hz, (event_id % 10) / 10 AS confidence, 20 * log10(greatest(abs(x), 1e-15)) AS level FROM x)"


def pitches(spark, sf_dir):
    """A sample's value, in half octaves about 440 Hz, stands for a frame's pitch."""
    x = F.col("x")
    return samples(spark, sf_dir).select(
        "user_id",
        "n",
        F.floor(F.col("n") / 8).alias("pair"),
        (440 * F.pow(F.lit(2.0), x / 2)).alias("pitch_hz"),
        (F.col("event_id") % 10 / 10).alias("confidence"),
        (20 * F.log10(F.greatest(F.abs(x), F.lit(1e-15)))).alias("level"),
    )


@query(
    "tuning_offset",
    f"""WITH {_X}, {_PITCHES}, c AS (SELECT user_id, confidence AS w, 12 * log2(pitch_hz / 440) - round(12 * log2(pitch_hz / 440)) AS apart FROM pf WHERE confidence >= 0.35 AND level >= -30),
        s AS (SELECT user_id, sum(w * cos(2 * pi() * apart)) AS a, sum(w * sin(2 * pi() * apart)) AS b, sum(w) AS w FROM c GROUP BY user_id)
        SELECT user_id, round(atan2(b, a) * 50 / pi(), 6) + 0.0 AS offset_cents, round(least(sqrt(a * a + b * b) / w, 1), 6) + 0.0 AS confidence FROM s""",
)
def tuning_offset(spark, sf_dir):
    return S.tuning_offset(pitches(spark, sf_dir), KEY, -30.0)


@query(
    "pitch_continuity",
    f"""WITH {_X}, {_PITCHES}, m AS (SELECT user_id, pair, pair % 2 = 0 AS rising, n, 69 + 12 * log2(pitch_hz / 440) AS midi FROM pf WHERE confidence >= 0.35),
        d AS (SELECT *, round(midi - lag(midi) OVER (PARTITION BY user_id, pair ORDER BY n), 9) AS change FROM m),
        g AS (SELECT user_id, pair, count(*) AS points, max(midi) - min(midi) AS span, count(*) FILTER (CASE WHEN rising THEN change + 0.05 >= 0 ELSE change - 0.05 <= 0 END) AS steps FROM d GROUP BY user_id, pair)
        SELECT user_id, pair, points, CASE WHEN points >= 3 AND round(span, 9) >= 0.5 THEN round(steps / (points - 1), 6) ELSE 0.0 END AS confidence,
               points >= 3 AND round(span, 9) >= 0.5 AND round(steps / nullif(points - 1, 0), 9) >= 0.65 AS glide FROM g""",
)
def pitch_continuity(spark, sf_dir):
    """Eight frames of a user lie between two notes, of which every other second is higher."""
    rows = pitches(spark, sf_dir).filter("confidence >= 0.35")
    rows = rows.select("user_id", "pair", "n", (F.col("pair") % 2 == 0).alias("rising"), (69 + 12 * F.log2(F.col("pitch_hz") / 440)).alias("midi"))
    return S.pitch_continuity(rows, ["user_id", "pair"], "n")
