"""Groups of a sorted stream of frames, for tasks that handle many small groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that end where a group ends, with the places at which their groups start (and the end).

    The rows come sorted by key; a group may be spread over several frames of the input.
    """
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = [frame[k].to_numpy() for k in key]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        first = [k[0] for k in keys]
        if kept and any(kept[-1][k].iat[-1] != v for k, v in zip(key, first, strict=True)):
            yield _ready(kept, key)
            kept = []
        if not len(changes):
            kept.append(frame)
            continue
        kept.append(frame.iloc[: changes[-1]])
        yield _ready(kept, key)
        kept = [frame.iloc[changes[-1] :]]
    if kept:
        yield _ready(kept, key)


def _ready(kept: list[pd.DataFrame], key: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    frame = pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0].reset_index(drop=True)
    keys = [frame[k].to_numpy() for k in key]
    changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return frame, np.concatenate([[0], changes, [len(frame)]])
