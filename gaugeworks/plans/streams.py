"""Stream queries: the same block facts from a table and from a stream."""

from __future__ import annotations

from gaugeworks.plans.registry import query, table
from gaugeworks.streaming import blocks

_FACTS = """SELECT {start} AS window_start, event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) + 0.0 AS mean,
    round(10 * log10(sqrt(avg(value * value)) * sqrt(avg(value * value))), 6) + 0.0 AS rms_db FROM {source} GROUP BY ALL"""


@query("stream_block_facts", _FACTS.format(start="time_bucket(INTERVAL 1 DAY, ts)", source="events"))
def stream_block_facts(spark, sf_dir):
    stream = blocks.read_events(spark, sf_dir, "events.parquet")
    return blocks.run_to_end(blocks.block_facts(stream, late="31 days"), ["window_start", "event_type"])


@query("sliding_block_facts", _FACTS.format(start="s", source="(SELECT *, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL (unnest([0, 12])) HOUR AS s FROM events)"))
def sliding_block_facts(spark, sf_dir):
    return blocks.block_facts(table(spark, sf_dir, "events"), "1 day", "12 hours")
