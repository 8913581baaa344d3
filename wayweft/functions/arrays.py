"""Helpers for whole-array code inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i repeated counts[i] times: i, and 0, 1, ... within it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def cuts(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose counts add up to about `most` (more only where a single one is larger)."""
    upto, start = np.cumsum(counts), 0
    while start < len(counts):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield slice(start, end)
        start = end
