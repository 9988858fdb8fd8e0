"""Idle-frame machine, run in blocks by Python workers.

The rule is a machine with ``after + drop`` states: 0..after-1 count empty
frames, the others count down the frames still to drop.  A block of frames maps
each entry state to an exit state, and such maps compose, so blocks run in
parallel and only their maps (one byte per state) are chained per camera.  With
41 states a camera chains 41 bytes per million frames: 28 MB for 7e11 frames,
a third of a 100 TB frame table.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Workers get these functions by value; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def step_tables(after: int, drop: int) -> np.ndarray:
    """Next state for [frame has a person][state]."""
    n = after + drop
    table = np.zeros((2, n), dtype=np.uint8)
    table[0, :after] = np.arange(1, after + 1)
    # State ``after`` has just been reached: ``drop`` frames remain, so the
    # countdown runs from ``after`` to the last state and then back to zero.
    table[:, after : n - 1] = np.arange(after + 1, n)
    table[:, n - 1] = 0
    return table


def block_map(after: int, drop: int):
    steps = step_tables(after, drop)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = np.arange(after + drop, dtype=np.uint8)
        for has in pdf.sort_values("_n")["has_person"].to_numpy(dtype=np.intp):
            state = steps[has][state]
        return pd.DataFrame([[*key, state.tobytes()]])

    return run


def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_block")
    entry, state = [], 0
    for exits in pdf["_exits"]:
        entry.append(state)
        state = exits[state]
    return pdf.assign(_entry=entry)[["race_id", "camera_id", "_block", "_entry"]]


def replay(after: int, drop: int):
    steps = step_tables(after, drop)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        state, kept = int(pdf["_entry"].iloc[0]), np.zeros(len(pdf), dtype=bool)
        for i, has in enumerate(pdf["has_person"].to_numpy(dtype=np.intp)):
            kept[i] = state < after
            state = steps[has, state]
        return pdf[kept][["race_id", "camera_id", "frame_ord"]]

    return run
