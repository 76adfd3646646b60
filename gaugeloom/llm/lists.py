"""Candidate pairs from inverted lists that are read sorted, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "a bigint, b bigint, value_a bigint, value_b bigint, met bigint, token bigint"
#: What a pair from a long list counts, as it meets its hub only in some of the lists that both are in.
FREE = 1 << 40


class Lists:
    """From entries (token, id, value, ...) sorted by token: candidate pairs (a, b), with their values and in how many
    short lists they met, and the tokens of long lists.

    Lists of up to `longest` entries give all pairs that may link, longer ones pairs with the entry before and with a hub.
    At most one list of up to `longest` entries, a hub and a last one are carried from batch to batch.
    """

    columns: tuple[str, ...]
    longest: int

    def may_link(self, rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the entries x and y, row numbers, may link."""
        raise NotImplementedError

    def reach(self, rows: list[np.ndarray], at: int) -> int:
        """Up to which entry of a long list the one at `at` is a hub."""
        return len(rows[0])

    def _ok(self, rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = self.may_link(rows, x, y)
        x, y = x[ok], y[ok]
        turned = rows[1][x] > rows[1][y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        return np.stack([rows[1][x], rows[1][y], rows[2][x], rows[2][y]], 1).astype(np.int64)

    def _short(self, rows: list[np.ndarray]) -> Iterator[np.ndarray]:
        token = rows[0]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(token)]]))
        for k in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(k, 1)
            starts, step = first[sizes == k], max(1, 2_000_000 // len(i))
            for at in range(0, len(starts), step):
                s = starts[at : at + step, None]
                yield self._ok(rows, (s + i).ravel(), (s + j).ravel())

    def _long(self, rows: list[np.ndarray], state: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """State: the hub's and the last entry."""
        begin = 1
        if state is not None:
            rows, begin = [np.concatenate(x) for x in zip(state, rows, strict=True)], 2
        end = len(rows[0])
        all_rows = np.arange(begin, end)
        hubs, at, i = np.empty(end, np.int64), 0, begin
        while i < end:
            stop = max(i, self.reach(rows, at))
            hubs[i:stop] = at
            if stop < end:
                hubs[stop] = at = stop
            i = stop + 1
        return [self._ok(rows, all_rows - 1, all_rows), self._ok(rows, hubs[begin:], all_rows)], [x[[at, end - 1]] for x in rows]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last list's rows, as there may be more to come
        state = None  # or, if that list is long, its hub and last row
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns]
            found, far, hot = [], [], []
            if state is not None and len(rows[0]):
                more = int(np.searchsorted(rows[0], state[0][0], "right"))
                if more:
                    pairs, state = self._long([x[:more] for x in rows], state)
                    far += pairs
                rows = [x[more:] for x in rows]
                if len(rows[0]):
                    state = None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            held = None
            token = rows[0]
            if len(token):
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                ends = np.concatenate([first[1:], [len(token)]])
                short = np.ones(len(token), bool)
                for i in np.flatnonzero(ends - first > self.longest):
                    f, e = first[i], ends[i]
                    short[f:e] = False
                    hot.append(token[f])
                    pairs, last = self._long([x[f:e] for x in rows], None)
                    far += pairs
                    if e == len(token):
                        state = last
                if state is None:
                    held = [x[first[-1] :] for x in rows]
                    short[first[-1] :] = False
                if short.any():
                    found += self._short([x[short] for x in rows])
            yield from self._out(found, far, hot)
        if held is not None:
            yield from self._out(list(self._short(held)), [], [])

    @staticmethod
    def _out(found: list[np.ndarray], far: list[np.ndarray], hot: list[int]) -> Iterator[pa.RecordBatch]:
        none = np.empty((0, 4), np.int64)
        near, met = np.unique(np.concatenate([*found, none]), axis=0, return_counts=True)
        away = np.unique(np.concatenate([*far, none]), axis=0)
        pairs, met = np.concatenate([near, away]), np.concatenate([met, np.full(len(away), FREE)]).astype(np.int64)
        other = pairs[:, 0] != pairs[:, 1]
        pairs, met = pairs[other], met[other]
        if len(pairs) or hot:
            empty = pa.nulls(len(hot), pa.int64())
            columns = [pa.concat_arrays([pa.array(x), empty]) for x in (*pairs.T, met)]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(np.array(hot, np.int64))])], ["a", "b", "value_a", "value_b", "met", "token"])
