"""Facts and frame tracks of streams of sample blocks, with state from batch to batch.

A series' state is what the next block needs of all before it: the samples that coming
frames overlap, the filter's state, the sums of the tenth of a second that is under way, and
blocks that came before their turn. It grows with none of the series' length. What a batch
gives is final, so the outputs are appended, and are those of the batch operators.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.operators import analysis as A
from gaugeworks.operators import chunks as C

#: Samples of a series that may wait for a block before them. More is taken for a lost block.
WAITING = 1 << 22
_STATE = "next long, first long, tail array<double>, filter array<double>, step_n long, step_power double, waiting array<struct<start: long, samples: array<double>>>"
PARTS = "source_id string, channel int, rate int, start_frame long, n long, peak double, total double, energy double, steps array<struct<step: long, power: double>>"


class _Series:
    """The state of one series, unpacked."""

    def __init__(self, state: GroupState):
        none = (0, 0, [], [], 0, 0.0, [])
        self.next, self.first, tail, filter_, self.step_n, self.step_power, waiting = state.get if state.exists else none
        self.tail, self.filter = np.array(tail, float), np.array(filter_, float)
        self.waiting = {int(w[0]): np.array(w[1], float) for w in waiting}

    def packed(self) -> tuple:
        waiting = [(s, x.tolist()) for s, x in sorted(self.waiting.items())]
        return int(self.next), int(self.first), self.tail.tolist(), self.filter.tolist(), int(self.step_n), float(self.step_power), waiting

    def ready(self, rows: pd.DataFrame, key: tuple, waiting: int):
        """The samples that follow on what was seen, block by block. A block that was seen
        before is left out; one that leaves a gap waits."""
        for start, samples in zip(rows["start_frame"], rows["samples"]):
            if start >= self.next and len(samples):
                self.waiting[int(start)] = np.asarray(samples, float)
        while self.next in self.waiting:
            yield (x := self.waiting.pop(self.next))
            self.next += len(x)
        if sum(map(len, self.waiting.values())) > waiting:
            raise ValueError(f"series {key}: the block at {self.next} has not come")


def _run(blocks: DataFrame, work, schema: str) -> DataFrame:
    def update(key, batches, state):
        rows = pd.concat(list(batches))
        series = _Series(state)
        out = work(key, float(rows["rate"].iloc[0]), series, rows)
        state.update(series.packed())
        yield from out

    some = blocks.select("source_id", "channel", "rate", "start_frame", "samples")
    return some.groupBy("source_id", "channel").applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def frame_stream(blocks: DataFrame, options: A.Options = A.Options(), waiting: int = WAITING) -> DataFrame:
    """The frame track (``analysis.TRACK``) of a stream of blocks (source_id, channel, rate,
    start_frame, samples), each frame as soon as its samples are there."""
    names = [c.split()[0] for c in A.TRACK.split(", ")]

    def work(key, rate, series, rows):
        new = list(series.ready(rows, key, waiting))
        if not new:
            return []
        x = np.concatenate([series.tail, *new])
        out = A.track(x, rate, options)
        done = series.first // options.hop  # the first frame of what is held; at most two are known
        lead = min(series.step_n, 2)
        n = len(out["frame_index"])
        out["frame_index"] = out["frame_index"] + done
        out["time_seconds"] = out["time_seconds"] + done * options.hop / rate
        table = pd.DataFrame({c: list(out[c])[lead:] for c in names[2:]})
        table.insert(0, "channel", key[1])
        table.insert(0, "source_id", key[0])
        # the next frame, and the two before it
        series.step_n += max(n - lead, 0)
        keep = max(0, series.step_n - 2) * options.hop
        series.tail, series.first = x[keep - series.first :], keep
        return [table[names]] if len(table) else []

    return _run(blocks, work, A.TRACK)


def part_stream(blocks: DataFrame, waiting: int = WAITING) -> DataFrame:
    """``PARTS``: what each run of new samples adds to the facts of its series, and the
    K-weighted mean squares of the tenths of a second that it ends."""

    def work(key, rate, series, rows):
        start = series.next
        new = list(series.ready(rows, key, waiting))
        if not new:
            return []
        x = np.concatenate(new)
        cascade = C.k_weighting(rate)
        y, series.filter = cascade.run(x, series.filter if len(series.filter) else np.zeros(4))
        tenth, steps, at = max(int(rate / 10 + 0.5), 1), [], 0
        while at < len(y):
            part = y[at : at + tenth - series.step_n]
            series.step_power, series.step_n, at = series.step_power + float(part @ part), series.step_n + len(part), at + len(part)
            if series.step_n == tenth:
                steps.append(((start + at) // tenth - 1, series.step_power / tenth))
                series.step_power, series.step_n = 0.0, 0
        facts = (key[0], key[1], int(rate), start, len(x), float(np.abs(x).max()), float(x.sum()), float((x * x).sum()), [{"step": s, "power": p} for s, p in steps])
        return [pd.DataFrame([facts], columns=[c.split()[0] for c in "source_id channel rate start_frame n peak total energy steps".split(" ")])]

    return _run(blocks, work, PARTS)


def facts_of_parts(parts: DataFrame) -> DataFrame:
    """(source_id, channel, frames, peak, rms, dc, crest_db, integrated_lufs) of all parts so
    far. The true peak needs samples that have not come, so the batch operator alone has it."""
    sums = parts.groupBy(*A.SERIES).agg(F.sum("n").alias("frames"), F.max("peak").alias("peak"), F.sum("energy").alias("energy"), F.sum("total").alias("total"))
    mean = F.col("energy") / F.col("frames")
    plain = lambda p: F.when(p > 1e-30, 10 * F.log10(p)).otherwise(F.lit(-300.0))
    level = sums.select(*A.SERIES, "frames", "peak", F.sqrt(mean).alias("rms"), (F.col("total") / F.col("frames")).alias("dc"), (plain(F.col("peak") * F.col("peak")) - plain(mean)).alias("crest_db"))
    return level.join(A.gated_loudness(parts.select(*A.SERIES, F.inline("steps")), A.SERIES), A.SERIES, "left")
