"""Grouping genetic algorithm for bins of equal capacity, over integer lengths. Pure functions with a seed: same input, same bins."""

from __future__ import annotations

import random
from collections.abc import Sequence

Bins = list[list[int]]  # piece numbers of each bin


class OpenBins:
    """Bins by the room they have left; finds the tightest one that still takes a length."""

    def __init__(self, lengths: Sequence[int], capacity: int, bins: Bins = ()):
        self.lengths, self.capacity = lengths, capacity
        self.bins: Bins = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if some bin has room r
        for b in bins:
            self._open(b, capacity - sum(lengths[p] for p in b))

    def _open(self, pieces: list[int], room: int) -> None:
        self.bins.append(pieces)
        self.by_room[room].append(len(self.bins) - 1)
        self.rooms |= 1 << room

    def add(self, piece: int) -> None:
        n = self.lengths[piece]
        fits = self.rooms >> n
        if not fits:
            self._open([piece], self.capacity - n)
            return
        room = n + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        b = held.pop()
        if not held:
            self.rooms ^= 1 << room
        self.bins[b].append(piece)
        self.by_room[room - n].append(b)
        self.rooms |= 1 << (room - n)


def best_fit(pieces: Sequence[int], lengths: Sequence[int], capacity: int, bins: Bins = ()) -> Bins:
    """Add pieces in the given order, each to the tightest bin that takes it."""
    state = OpenBins(lengths, capacity, bins)
    for p in pieces:
        state.add(p)
    return state.bins


def by_length(pieces: Sequence[int], lengths: Sequence[int]) -> list[int]:
    return sorted(pieces, key=lambda p: (-lengths[p], p))


def fill(b: Sequence[int], lengths: Sequence[int]) -> int:
    return sum(lengths[p] for p in b)


def fitness(bins: Bins, lengths: Sequence[int], capacity: int) -> tuple[int, float]:
    """Higher is better: fewer bins, then fuller ones beside emptier ones."""
    return -len(bins), sum((fill(b, lengths) / capacity) ** 2 for b in bins)


def crossover(mother: Bins, father: Bins, lengths: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of ``father``; bins of ``mother`` that hold one of their pieces are opened, and the pieces so
    displaced are put back by best fit, longest first."""
    full = sorted(father, key=lambda b: (-fill(b, lengths), b[0]))
    pool = full[: max(1, len(full) // 2)]
    injected = [list(b) for b in rng.sample(pool, max(1, len(pool) // 2))]
    taken = {p for b in injected for p in b}
    kept, displaced = [], []
    for b in mother:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [p for p in b if p not in taken]
    return best_fit(by_length(displaced, lengths), lengths, capacity, injected + kept)


def mutated(bins: Bins, lengths: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Open the emptiest bins and a few others, and put their pieces back by best fit."""
    ranked = sorted(bins, key=lambda b: (fill(b, lengths), b[0]))
    count = min(len(ranked), max(2, len(ranked) // 20))
    opened = set(range(count)) | set(rng.sample(range(len(ranked)), count))
    loose = [p for k in opened for p in ranked[k]]
    return best_fit(by_length(loose, lengths), lengths, capacity, [list(b) for k, b in enumerate(ranked) if k not in opened])


def first_population(lengths: Sequence[int], capacity: int, size: int, rng: random.Random) -> list[Bins]:
    """Best fit decreasing, and the same with lengths shaken by up to a tenth in the order."""
    pieces = range(len(lengths))
    people = [best_fit(by_length(pieces, lengths), lengths, capacity)]
    for _ in range(size - 1):
        shaken = sorted(pieces, key=lambda p: (-lengths[p] * rng.uniform(0.9, 1.1), p))
        people.append(best_fit(shaken, lengths, capacity))
    return people


def evolve(people: list[Bins], lengths: Sequence[int], capacity: int, generations: int, rng: random.Random) -> list[Bins]:
    """Best first. Each generation crosses and mutates; the best survive. Ends early where no bin can be saved."""
    least = -(-sum(lengths) // capacity)

    def rank(bins: Bins):
        return fitness(bins, lengths, capacity)

    people = sorted(people, key=rank, reverse=True)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        father, mother = people[0], people[rng.randrange(1, len(people))] if len(people) > 1 else people[0]
        children = [
            crossover(mother, father, lengths, capacity, rng),
            mutated(crossover(father, mother, lengths, capacity, rng), lengths, capacity, rng),
        ]
        people = sorted(people + children, key=rank, reverse=True)[: len(people)]
    return people
