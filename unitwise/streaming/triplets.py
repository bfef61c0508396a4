"""Consecutive-frame windows over a stream, and work resumed where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def triplets(frames: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """(folder, before, centre, after) from a stream of (folder, idx, id): a centre is sent when its successor arrives.

    The state of a folder is its two newest frames, and goes when the folder has been silent for idle_ms; frames of a folder are
    expected in the order of their indices over batches (within one batch they are sorted), older ones are passed over. A folder
    that speaks again later begins anew, so no triplet spans such a silence."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [(i, k) for i, k in zip(*(list(x) for x in state.get), strict=True)] if state.exists else []
        new = sorted((int(i), int(k)) for b in batches for i, k in zip(b["idx"], b["id"], strict=True))
        out = []
        for i, k in new:
            if held and i <= held[-1][0]:
                continue
            if len(held) == 2 and held[0][0] + 1 == held[1][0] == i - 1:
                out.append((key[0], held[0][1], held[1][1], k))
            held = [*held[-1:], (i, k)]
        state.update(([i for i, _ in held], [k for _, k in held]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["folder", "before", "centre", "after"])

    return frames.groupBy("folder").applyInPandasWithState(step, "folder string, before long, centre long, after long", "idx array<long>, id array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def remaining(units: DataFrame, done: DataFrame, unit: str = "unit") -> DataFrame:
    """Units without a row in what was written so far; to be appended unit by unit."""
    return units.join(done.select(unit).distinct(), unit, "left_anti")
