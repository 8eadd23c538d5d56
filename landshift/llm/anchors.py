"""Anchors: positions chosen by content, so that equal windows of two texts hold the same one.

Of the grams that start in a window, the one whose hash is smallest (the leftmost of
equals) is the window's anchor. Windows that hold equal symbols choose the same gram at the
same offset, wherever they stand; so whatever can repeat a window is found among the
anchors with an equal gram, and there are only some two anchors per window length.
"""

from __future__ import annotations

import numpy as np

PLACE_BITS = 20  # positions of one stretch; longer texts are cut into overlapping stretches
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _stretch(order: np.ndarray, width: int) -> np.ndarray:
    ranked = ((order * _MIX) & ~_LOW) | np.arange(len(order), dtype=np.uint64)
    return (sliding_min(ranked, width) & _LOW).astype(np.int64)


def window_anchors(order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, first, last): each anchor and the first and last of the windows that choose it.

    `order` has a 64-bit value for the gram at each position; a window covers `width` of them.
    """
    windows = len(order) - width + 1
    if windows < 1:
        return (np.empty(0, np.int64),) * 3
    step = (1 << PLACE_BITS) - width
    if windows <= step:
        chosen = _stretch(order, width)
    else:
        chosen = np.concatenate([_stretch(order[i:i + step + width - 1], width) + i for i in range(0, windows, step)])
    new = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    return chosen[new], new, np.concatenate([new[1:], [windows]]) - 1
