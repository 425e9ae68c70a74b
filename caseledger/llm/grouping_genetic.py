"""A grouping genetic algorithm for bin packing: one island's population over one set of items."""

from dataclasses import dataclass

import numpy as np


@dataclass
class Packing:
    """Which bin each item lies in, and how full every bin is. Bins are numbered from 0 without gaps."""

    bin_of: np.ndarray
    fills: np.ndarray

    @property
    def cost(self) -> tuple[int, int]:
        """Fewer bins first, then the more uneven filling, which leaves more room in one place."""
        return len(self.fills), -int((self.fills.astype(np.int64) ** 2).sum())


class _Open:
    """Bins by the room they have left; the tightest one that fits is found by one bit scan."""

    def __init__(self, room: np.ndarray, names: np.ndarray):
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        for r, b in zip(room.tolist(), names.tolist(), strict=True):
            self._put(r, b)

    def _put(self, room: int, name: int) -> None:
        if room:
            held = self.by_room.setdefault(room, [])
            if not held:
                self.mask |= 1 << room
            held.append(name)

    def fit(self, size: int) -> int | None:
        fitting = self.mask >> size
        if not fitting:
            return None
        room = size + ((fitting & -fitting).bit_length() - 1)
        held = self.by_room[room]
        name = held.pop()
        if not held:
            self.mask &= ~(1 << room)
        self._put(room - size, name)
        return name


def best_fit(
    sizes: np.ndarray, order: np.ndarray, capacity: int, bin_of: np.ndarray, fills: np.ndarray
) -> Packing:
    """Put the items of `order`, one by one, into the fullest bin that takes them, or a new one."""
    opened = np.flatnonzero(fills < capacity)
    space = _Open(capacity - fills[opened], opened)
    bin_of, used = bin_of.copy(), fills.tolist()
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        b = space.fit(size)
        if b is None:
            b = len(used)
            used.append(0)
            space._put(capacity - size, b)
        used[b] += size
        bin_of[item] = b
    return Packing(bin_of, np.array(used, np.int32))


def fresh_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    """Best fit in decreasing order, the order disturbed by `noise`."""
    key = sizes * (1 + noise * rng.standard_normal(len(sizes))) if noise else sizes
    order = np.argsort(-key, kind="stable")
    return best_fit(sizes, order, capacity, np.full(len(sizes), -1, np.int32), np.empty(0, np.int32))


class _Loose:
    """Items that lie in no bin yet, by size. Sizes that are there are bits of a number, and of its mirror image."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[int]] = {}
        for i in np.argsort(sizes, kind="stable").tolist():
            self.items.setdefault(int(sizes[i]), []).append(i)
        self.mask = sum(1 << s for s in self.items)
        self.mirror = sum(1 << (capacity - s) for s in self.items)

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        if not held:
            self.mask &= ~(1 << size)
            self.mirror &= ~(1 << (self.capacity - size))
        return item

    def pair(self, room: int) -> int:
        """The larger of two sizes that fill the room exactly, 0 where there are none."""
        both = self.mask & (self.mirror >> (self.capacity - room))
        if room % 2 == 0 and both >> (room // 2) & 1 and len(self.items[room // 2]) < 2:
            both &= ~(1 << (room // 2))
        return both.bit_length() - 1 if both else 0

    def next(self, room: int, tries: int) -> int:
        """The size to put into the room: one that fills it, one of a pair or of three that do, or the largest."""
        if self.mask >> room & 1:
            return room
        if largest := self.pair(room):
            return largest
        fitting = self.mask & ((1 << room) - 1)
        first = fitting.bit_length() - 1
        while fitting and tries:
            size = fitting.bit_length() - 1
            if self.pair(room - size):
                return size
            fitting &= ~(1 << size)
            tries -= 1
        return max(first, 0)


def filled_packing(sizes: np.ndarray, capacity: int, tries: int = 24) -> Packing:
    """Bin by bin: the largest item left, then items that fill the room exactly where there are such."""
    loose = _Loose(sizes, capacity)
    bin_of, fills = np.full(len(sizes), -1, np.int32), []
    while loose.mask:
        room = capacity
        size = loose.mask.bit_length() - 1
        while size > 0:
            # The third of three may have been the same item as the second; then the largest that fits goes in.
            bin_of[loose.take(size)] = len(fills)
            room -= size
            size = loose.next(room, tries) if room and loose.mask else 0
        fills.append(capacity - room)
    return Packing(bin_of, np.array(fills, np.int32))


def _without(p: Packing, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Take whole bins out: the new bin numbers, their fills and the items left without a bin."""
    stays = np.ones(len(p.fills), bool)
    stays[gone] = False
    number = np.where(stays, np.cumsum(stays) - 1, -1).astype(np.int32)
    placed = p.bin_of >= 0
    bin_of = np.where(placed, number[p.bin_of], -1).astype(np.int32)
    return bin_of, p.fills[stays], np.flatnonzero(bin_of < 0)


def crossover(
    a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator, share: float
) -> Packing:
    """Inject some well-filled bins of b whole into a.

    Bins of a that hold an injected item go; their other items are displaced and put back by
    best fit, largest first.
    """
    good = np.flatnonzero(b.fills >= np.quantile(b.fills, 0.5))
    picked = rng.choice(good, min(len(good), max(1, round(share * len(b.fills)))), replace=False)
    injected = np.flatnonzero(np.isin(b.bin_of, picked))
    bin_of, fills, loose = _without(a, np.unique(a.bin_of[injected]))
    names = np.full(len(b.fills), -1, np.int32)
    names[picked] = len(fills) + np.arange(len(picked))
    bin_of[injected] = names[b.bin_of[injected]]
    fills = np.concatenate([fills, b.fills[picked]])
    loose = loose[bin_of[loose] < 0]
    return best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], capacity, bin_of, fills)


def mutated(p: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator, share: float) -> Packing:
    """Dissolve the emptiest bins and some others, and put their items back in a disturbed order."""
    count = max(1, round(share * len(p.fills)))
    gone = np.unique(np.concatenate([np.argsort(p.fills, kind="stable")[:count], rng.integers(0, len(p.fills), count)]))
    bin_of, fills, loose = _without(p, gone)
    key = sizes[loose] * (1 + 0.1 * rng.standard_normal(len(loose)))
    return best_fit(sizes, loose[np.argsort(-key, kind="stable")], capacity, bin_of, fills)


def evolve(
    sizes: np.ndarray,
    capacity: int,
    *,
    seed: int,
    immigrants: list[np.ndarray],
    population: int = 5,
    generations: int = 20,
    share: float = 0.02,
) -> Packing:
    """The best packing after some generations. Immigrants are elites as item-to-bin numbers.

    Parents are chosen by tournament, a child takes the place of the worst when it is better.
    Ends early when no packing can have fewer bins. Same input and seed, same result.
    """
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people = []
    for bin_of in immigrants:
        numbers = np.unique(bin_of, return_inverse=True)[1].reshape(-1).astype(np.int32)
        people.append(Packing(numbers, np.bincount(numbers, weights=sizes).astype(np.int32)))
    if not people:
        people += [fresh_packing(sizes, capacity, rng, 0.0), filled_packing(sizes, capacity)]
    while len(people) < population:
        people.append(fresh_packing(sizes, capacity, rng, 0.03 * len(people)))
    people.sort(key=lambda p: p.cost)
    for _ in range(generations):
        if len(people[0].fills) <= least:
            break
        one, two, three, four = rng.integers(0, population, 4)
        a, b = people[min(one, two)], people[min(three, four)]
        children = [mutated(a, sizes, capacity, rng, share)]
        if a is not b:
            children += [
                crossover(a, b, sizes, capacity, rng, share),
                crossover(b, a, sizes, capacity, rng, share),
            ]
        for child in children:
            if child.cost < people[-1].cost:
                people[-1] = child
                people.sort(key=lambda p: p.cost)
    return people[0]
