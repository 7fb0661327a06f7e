"""Weighted acyclic automata over rows of 64-bit labels, built from sorted rows and kept as arrays by depth.

A state is a distinct prefix; its arcs are in label order; its weight is the count of the row that ends there. All steps
work on whole columns: rows are added in sorted blocks to the path of the row before, unions sum equal rows, and
composition walks many rows at a time, a depth at a time.
"""

from __future__ import annotations

import numpy as np

#: Fills rows that are shorter than others; sorts first and is no label.
NONE = np.uint64(0)


def sort_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, equal ones summed."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(counts, at)


class Automaton:
    """labels[d], parents[d] (states of depth d - 1; 0 for the start) and weights[d] of the states that d + 1 labels lead to."""

    def __init__(self, depth: int):
        self.labels = [np.zeros(0, np.uint64) for _ in range(depth)]
        self.parents = [np.zeros(0, np.int64) for _ in range(depth)]
        self.weights = [np.zeros(0, np.int64) for _ in range(depth)]
        self.last: np.ndarray | None = None

    def add(self, rows: np.ndarray, counts: np.ndarray) -> Automaton:
        """Add distinct rows in order, all after those added before; what the last row shares with the first is not built again."""
        if not len(rows):
            return self
        changed = np.zeros(len(rows), bool)
        changed[0] = self.last is None
        up = np.zeros(len(rows), np.int64)
        for d in range(len(self.labels)):
            col = rows[:, d]
            changed[1:] |= col[1:] != col[:-1]
            changed[0] |= self.last is not None and self.last[d] != col[0]
            real = col != NONE
            new = np.flatnonzero(changed & real)
            had = len(self.labels[d])
            # a row's state: the last one that was made up to it
            state = np.cumsum(changed & real) + had - 1
            end = real & (rows[:, d + 1] == NONE if d + 1 < rows.shape[1] else True)
            w = np.zeros(had + len(new), np.int64)
            w[:had] = self.weights[d]
            w[state[end]] += counts[end]
            self.labels[d], self.parents[d], self.weights[d] = np.append(self.labels[d], col[new]), np.append(self.parents[d], up[new]), w
            up = state
        self.last = rows[-1].copy()
        return self

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows with a weight, in order, and their weights."""
        depth, found, counts = len(self.labels), [], []
        path = np.zeros((1, depth), np.uint64)
        for d in range(depth):
            path = path[self.parents[d]]
            path[:, d] = self.labels[d]
            has = self.weights[d] > 0
            found.append(path[has])
            counts.append(self.weights[d][has])
        return sort_rows(np.concatenate(found), np.concatenate(counts))

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        """The weight of each row: 0 where no path accepts it."""
        out = np.zeros(len(rows), np.int64)
        state, alive = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for d, (labels, parents) in enumerate(zip(self.labels, self.parents)):
            alive &= rows[:, d] != NONE
            at = np.flatnonzero(alive)
            if not len(at) or not len(labels):
                break
            known, code = np.unique(labels, return_inverse=True)
            arcs = parents * len(known) + code  # in order, as arcs are by parent and label
            label = np.searchsorted(known, rows[at, d])
            label[label == len(known)] = 0
            asked = state[at] * len(known) + label
            there = np.minimum(np.searchsorted(arcs, asked), len(arcs) - 1)
            ok = (known[label] == rows[at, d]) & (arcs[there] == asked)
            alive[at[~ok]] = False
            state[at[ok]] = there[ok]
            ends = at[ok][(rows[at[ok], d + 1] == NONE) if d + 1 < rows.shape[1] else slice(None)]
            out[ends] = self.weights[d][state[ends]]
        return out

    def dump(self, first: bool = True) -> bytes:
        """As bytes; without the labels of the first depth if they follow from the others. Steps and weights take as few bytes as they need."""
        head, body = [len(self.labels)], []
        for d, (labels, parents, weights) in enumerate(zip(self.labels, self.parents, self.weights)):
            steps = _narrow(np.diff(parents, prepend=0))
            weights = _narrow(weights) if weights.any() else np.zeros(0, np.uint8)
            labels = labels if d or first else labels[:0]
            head += [len(parents), len(labels), steps.itemsize, len(weights), weights.itemsize]
            body += [labels.tobytes(), steps.tobytes(), weights.tobytes()]
        return np.array(head, np.int64).tobytes() + b"".join(body)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        depth = int(np.frombuffer(data, np.int64, 1)[0])
        head, at = np.frombuffer(data, np.int64, 5 * depth, 8).reshape(depth, 5).tolist(), 8 * (1 + 5 * depth)
        out = cls(depth)
        for d, (n, n_labels, wide, n_weights, weight_wide) in enumerate(head):
            out.labels[d] = np.frombuffer(data, np.uint64, n_labels, at)
            at += 8 * n_labels
            out.parents[d] = np.cumsum(np.frombuffer(data, f"u{wide}", n, at), dtype=np.int64)
            at += wide * n
            out.weights[d] = np.frombuffer(data, f"u{weight_wide}", n_weights, at).astype(np.int64) if n_weights else np.zeros(n, np.int64)
            at += weight_wide * n_weights
        return out


def _narrow(numbers: np.ndarray) -> np.ndarray:
    most = int(numbers.max(initial=0))
    return numbers.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def union(parts: list[Automaton]) -> Automaton:
    """All rows of the parts, weights of equal rows summed."""
    every = [p.rows() for p in parts]
    return Automaton(len(parts[0].labels)).add(*sort_rows(np.concatenate([r for r, _ in every]), np.concatenate([c for _, c in every])))
