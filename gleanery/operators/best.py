"""The best of each query while a task reads its part of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Best:
    """The ``k`` least values of each of ``n`` queries; ties go to the lesser id.

    What is added waits until it is worth a sort, so ``bar`` (what a value must not exceed, infinite until ``k`` are held)
    may lag behind, never ahead.
    """

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = 0
        self.bar = np.full(n, np.inf)

    def add(self, rows: np.ndarray, values: np.ndarray, ids: pa.Array) -> bool:
        """Whether the bar was set anew."""
        if len(rows):
            self.held.append((rows, values, ids))
            self.waiting += len(rows)
        if self.waiting < self.n * self.k // 2 and (len(self.held) != 1 or not self.waiting):
            return False
        self.merge()
        return True

    def merge(self) -> None:
        if not self.waiting:
            return
        rows, values, ids = np.concatenate([x[0] for x in self.held]), np.concatenate([x[1] for x in self.held]), pa.concat_arrays([x[2] for x in self.held])
        at = np.lexsort((pc.rank(ids, tiebreaker="first").to_numpy(), values, rows))
        rows = rows[at]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < self.k
        rows, values, ids = rows[keep], values[at[keep]], ids.take(pa.array(at[keep]))
        self.held, self.waiting = [(rows, values, ids)], 0
        full = np.bincount(rows, minlength=self.n) >= self.k
        self.bar = np.where(full, values[np.searchsorted(rows, np.arange(self.n), "right") - 1], np.inf)

    def ahead(self, ids: pa.Array, queries: np.ndarray) -> np.ndarray:
        """How many of ``ids``, which are sorted, come before the last id of each query, all of which hold ``k``; all where ids may be null."""
        rows, _, held = self.held[0]
        last = held.take(pa.array(np.searchsorted(rows, queries, "right") - 1))
        if ids.null_count or last.null_count:
            return np.full(len(queries), len(ids))
        plain = [x.to_numpy() if pa.types.is_integer(x.type) else np.array([*x.to_pylist(), None], object)[:-1] for x in (ids, last)]
        return np.searchsorted(*plain)
