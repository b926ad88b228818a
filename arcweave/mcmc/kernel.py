"""One Metropolis-Hastings chain over a network's ties, in numpy, as it runs inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from arcweave.operators.base import Term


class State:
    """The network of a chain: a[i, j] for a tie from i to j (symmetric when undirected), its transpose, degrees."""

    def __init__(self, a: np.ndarray, directed: bool):
        self.a, self.t, self.directed = a, a.T, directed
        self.dout, self.din = a.sum(1), a.sum(0)

    def toggle(self, i: int, j: int, y: int) -> None:
        step = -1 if y else 1
        self.a[i, j] = not y
        self.dout[i] += step
        self.din[j] += step
        if not self.directed:
            self.a[j, i] = not y
            self.dout[j] += step
            self.din[i] += step


@dataclass
class Chain:
    """What every chain of a job shares: terms bound to vertex positions, the observed ties and the dyads that stay.

    `ties` and `fixed` are position pairs (i < j when undirected); fixed dyads keep their face value."""

    terms: list[Term]
    ids: np.ndarray
    ties: np.ndarray
    fixed: np.ndarray
    directed: bool

    def matrix(self, ties: np.ndarray) -> np.ndarray:
        a = np.zeros((len(self.ids), len(self.ids)), bool)
        a[ties[:, 0], ties[:, 1]] = True
        if not self.directed:
            a[ties[:, 1], ties[:, 0]] = True
        return a

    def held(self) -> set[int]:
        n = len(self.ids)
        return set((self.fixed[:, 0] * n + self.fixed[:, 1]).tolist())

    def random_ties(self, density: float, rng: np.random.Generator) -> np.ndarray:
        """Each free dyad tied with the same probability; fixed ones as observed."""
        n = len(self.ids)
        a = rng.random((n, n)) < density
        np.fill_diagonal(a, False)
        if not self.directed:
            a = np.triu(a)
        if len(self.fixed):
            face = self.matrix(self.ties)
            a[self.fixed[:, 0], self.fixed[:, 1]] = face[self.fixed[:, 0], self.fixed[:, 1]]
        return np.argwhere(a)

    def stats(self, ties: np.ndarray) -> np.ndarray:
        """Statistics as the sum of changes while ties come in one by one."""
        n = len(self.ids)
        state = State(np.zeros((n, n), bool), self.directed)
        total = np.array([t.empty(n) for t in self.terms])
        for i, j in ties.tolist():
            total += [t.local(state, i, j, 0) for t in self.terms]
            state.toggle(i, j, 0)
        return total

    def design(self, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rows of change statistics over the free dyads of a network, their dyads and ties."""
        n, held = len(self.ids), self.held()
        state = State(self.matrix(ties), self.directed)
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            for j in range(0 if self.directed else i + 1, n):
                if i != j and i * n + j not in held:
                    y = int(state.a[i, j])
                    got = seen.setdefault(tuple(round(float(t.local(state, i, j, y)), 10) for t in self.terms), [0, 0])
                    got[0] += 1
                    got[1] += y
        counts = np.array(list(seen.values()), float)
        return np.array(list(seen), float), counts[:, 0], counts[:, 1]

    def free_dyads(self) -> int:
        n = len(self.ids)
        return n * (n - 1) // (1 if self.directed else 2) - len(self.fixed)

    def run(self, theta: np.ndarray, ties: np.ndarray, stats: np.ndarray, draws: int, burnin: int, interval: int, rng: np.random.Generator, networks: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """`draws` times the statistics (and the ties), every `interval` steps after the burn-in."""
        n = len(self.ids)
        if self.free_dyads() < 1:
            raise ValueError("all dyads are unobserved; there is nothing to sample")
        held, terms, directed = self.held(), self.terms, self.directed
        state, now = State(self.matrix(ties), directed), np.array(stats, float)
        weights, block = np.asarray(theta, float), 1 << 14
        step, last = 0, burnin + draws * interval
        while step < last:
            size = min(block, last - step)
            # a second vertex among the n - 1 others makes every ordered pair equally likely
            first = rng.integers(0, n, size)
            second = rng.integers(0, n - 1, size)
            second += second >= first
            if not directed:
                first, second = np.minimum(first, second), np.maximum(first, second)
            for i, j, u in zip(first.tolist(), second.tolist(), np.log(rng.random(size)).tolist()):
                while held and i * n + j in held:
                    i, j = int(rng.integers(0, n)), int(rng.integers(0, n - 1))
                    j += j >= i
                    if not directed and i > j:
                        i, j = j, i
                y = int(state.a[i, j])
                delta = np.array([t.local(state, i, j, y) for t in terms], float)
                sign = -1.0 if y else 1.0
                if u < sign * float(weights @ delta):
                    state.toggle(i, j, y)
                    now += sign * delta
                step += 1
                if step > burnin and (step - burnin) % interval == 0:
                    yield now.copy(), (np.argwhere(state.a if directed else np.triu(state.a)) if networks else None)
