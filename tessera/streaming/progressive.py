"""Captures that arrive in parts, as a stream: each frame is told once when it is there, and once more when its colour is.

Input rows are (capture, camera, frame, colour): a frame's payload is complete (camera set), or the capture's colour calibration
has come (camera null, colour true). Order and repeats do not matter: what comes twice is told once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "capture string, camera string, frame int, coloured boolean"
STATE = "frames array<string>, colour boolean"


def told(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """(capture, camera, frame, coloured). The state of a capture is its list of frames (a few dozen at most), and goes when nothing of it has come for so long."""
    limit = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames, colour = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        seen, rows = set(frames), []
        for part in parts:
            for e in part.itertuples(index=False):
                if e.colour and not colour:
                    colour = True
                    rows += [(f.rsplit("/", 1)[0], int(f.rsplit("/", 1)[1]), True) for f in frames]
                if e.camera is not None and e.camera == e.camera:
                    name = f"{e.camera}/{int(e.frame)}"
                    if name not in seen:
                        seen.add(name)
                        frames.append(name)
                        rows.append((e.camera, int(e.frame), colour))
        state.update((frames, colour))
        state.setTimeoutDuration(limit)
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["capture", "camera", "frame", "coloured"])

    return events.groupBy("capture").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
