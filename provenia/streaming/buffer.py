"""Streaming intake: a bounded salience buffer per tenant, drained in batches, and batch consolidation.

The buffer is arbitrary state: it keeps at most ``capacity`` percepts by salience (the newest of
equals), and drains the ``batch`` most salient (the oldest of equals) once it holds that many, or
once it has been idle. A drain is one turn of the tenant.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY, BATCH, IDLE_MS = 256, 32, 2000
PERCEPT = "tenant string, seq long, claim string, evidence string, confidence double, salience double"
DRAINED = f"{PERCEPT}, turn long, drain_rank long"
STATE = "held string, turn long, admitted long, evicted long"
_FIELDS = ("tenant", "seq", "claim", "evidence", "confidence", "salience")


def coerce(raw: DataFrame) -> DataFrame:
    """Proposals as percepts: confidence and salience within 0..1, salience defaults to confidence, empty claims go."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double")))
    confidence = clamp(F.coalesce(F.col("confidence"), F.lit(0.5)))
    out = raw.withColumn("confidence", confidence).withColumn("salience", clamp(F.coalesce(F.col("salience"), F.col("confidence"))))
    return out.filter(F.trim("claim") != "").select(F.col("tenant").cast("string"), F.col("seq").cast("long"), "claim", "evidence", "confidence", "salience")


def step(held: list[tuple], arrivals: list[tuple], capacity: int) -> tuple[list[tuple], int]:
    """The buffer after arrivals, and how many it evicted; rows end with salience, second is seq."""
    both = sorted({r[1]: r for r in (*held, *arrivals)}.values(), key=lambda r: (-r[5], -r[1]))
    return both[:capacity], max(0, len(both) - capacity)


def take(held: list[tuple], batch: int) -> tuple[list[tuple], list[tuple]]:
    """The next batch and what is left."""
    order = sorted(held, key=lambda r: (-r[5], r[1]))
    return order[:batch], order[batch:]


def drained(percepts: DataFrame, capacity: int = CAPACITY, batch: int = BATCH, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of percepts as a stream of drained batches (``DRAINED``)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_json, turn, admitted, evicted = state.get if state.exists else ("[]", 0, 0, 0)
        held = [tuple(r) for r in json.loads(held_json)]
        rows = [] if state.hasTimedOut else [tuple(r) for f in frames for r in f[list(_FIELDS)].itertuples(index=False, name=None)]
        held, gone = step(held, sorted(rows, key=lambda r: r[1]), capacity)
        out = []
        while len(held) >= batch or (state.hasTimedOut and held):
            now, held = take(held, batch)
            turn += 1
            out += [(*r, turn, k + 1) for k, r in enumerate(now)]
        state.update((json.dumps(held, default=lambda x: x.item()), int(turn), int(admitted + len(rows)), int(evicted + gone)))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[*_FIELDS, "turn", "drain_rank"])

    return percepts.groupBy("tenant").applyInPandasWithState(run, DRAINED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def consolidate(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Hand every micro-batch to ``apply(batch, batch_id)``. ``apply`` must write by batch id, so that a retry replaces its own rows."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
