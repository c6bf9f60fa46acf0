"""Filling containers of fixed capacity with items that are not split unless they exceed it.

Sizes are whole numbers up to the capacity, so the whole instance is its histogram: at
most ``capacity`` numbers, whatever the number of items.  The histogram is filled by bin
completion: around the largest item left, the undominated fillings are enumerated, least
waste and fewest items first, each one only when the search asks for it; a filling is taken
as often as the counts allow, and fewer times on the way back.  A branch ends when its waste
exceeds what the wanted number of containers affords, or when what is left was tried before.
The wanted number starts at the lower bound and rises until the search succeeds or meets the
best-fit solution, the incumbent.  The search looks at a stated number of fillings; where
that is not enough, the incumbent stays and the gap to the bound is reported.

The plan says which ranks within each size go to which container.  Items get their rank from
a range partition on size and item, so the assignment depends on the items alone, and nothing
but the histogram (per partition) and the plan passes through the driver.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism

#: Fillings the search looks at in all, and those (at least) after which it begins anew.
MOST_NODES, RESTART = 500_000, 1_000

Plan = list[tuple[int, tuple[int, ...]]]


class Filled(NamedTuple):
    """A plan, the lower bound (raised where the search proved it), and the fillings looked at."""

    plan: Plan
    bound: int
    nodes: int

    @property
    def containers(self) -> int:
        return sum(t for t, _ in self.plan)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers no solution can go below: by total size, and by items that exclude each other."""
    size = np.array(sorted(counts), np.int64)
    if not len(size):
        return 0
    n = np.array([counts[int(s)] for s in size], np.int64)
    best = int(-(-(size * n).sum() // capacity))
    many, sums = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size * n)))
    half = int(np.searchsorted(size, capacity // 2, side="right"))
    for i, k in enumerate(size[:half]):
        high = int(np.searchsorted(size, capacity - k, side="right"))
        large, mid = int(many[-1] - many[high]), int(many[high] - many[half])
        room = capacity * mid - int(sums[high] - sums[half])
        small = int(sums[half] - sums[i])
        best = max(best, large + mid + max(0, -(-(small - room) // capacity)))
    large = int(many[-1] - many[half])
    return max(best, large)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram; containers of equal content are filled together."""
    rooms: list[int] = []
    held: dict[int, list[list]] = {}  # room -> [times, content] of containers with that room

    def put(room: int, times: int, content: tuple[int, ...]) -> None:
        if room not in held:
            rooms.insert(bisect_left(rooms, room), room)
            held[room] = []
        held[room].append([times, content])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                per = min(capacity // s, n)
                put(capacity - s * per, n // per, (s,) * per)
                n -= n // per * per
                continue
            room = rooms[k]
            times, content = held[room].pop()
            fits = min(room // s, n)  # best fit goes on with the container it has begun
            whole = min(times, n // fits)
            if whole < times:
                held[room].append([times - whole, content])
            elif not held[room]:
                del held[room], rooms[k]
            put(room - s * fits, whole, content + (s,) * fits)
            n -= whole * fits
    return [(times, content) for group in held.values() for times, content in group]


class _Left:
    """Counts of the sizes left, the set of sizes left, and a mark of both."""

    def __init__(self, counts: dict[int, int], capacity: int):
        rng = random.Random(1)
        self.n = [0] * (capacity + 1)
        self.keys = [rng.getrandbits(120) for _ in range(capacity + 1)]
        self.there, self.mark = 0, 0
        for s, k in counts.items():
            self.take(s, -k)

    def take(self, s: int, k: int) -> None:
        self.n[s] -= k
        self.mark -= k * self.keys[s]
        if self.n[s]:
            self.there |= 1 << s
        else:
            self.there &= ~(1 << s)

    def largest(self, room: int) -> int:
        """Largest size left of at most ``room``, 0 if there is none."""
        return max(0, (self.there & ((2 << room) - 1)).bit_length() - 1) if room > 0 else 0

    def sizes(self, low: int, high: int) -> list[int]:
        """Sizes left from ``low`` to ``high``."""
        out, bits = [], (self.there >> low) & ((1 << (high - low + 1)) - 1) if high >= low else 0
        while bits:
            b = bits & -bits
            out.append(low + b.bit_length() - 1)
            bits ^= b
        return out


def _exact(left: _Left, total: int, rng: random.Random | None = None) -> Iterator[tuple[int, ...]]:
    """Multisets of sizes left with exactly this total, fewest items first, largest first; pairs in any order with ``rng``."""
    if total == 0:
        yield ()
        return
    n = left.n
    if n[total]:
        yield (total,)
    pairs = ((x, total - x) for x in reversed(left.sizes((total + 1) // 2, total - 1)) if n[total - x] > (2 * x == total))
    if rng:
        pairs = list(pairs)
        rng.shuffle(pairs)
    yield from pairs
    # three and more: the sums that the sizes up to each size can reach guide the way
    sizes = left.sizes(1, total - 2)
    if not sizes:
        return
    mask = (1 << (total + 1)) - 1
    reach = [1]
    for s in sizes:
        r = reach[-1]
        many, k = min(n[s], total // s), 1
        while many > 0:
            k = min(k, many)
            r |= (r << (s * k)) & mask
            many -= k
            k *= 2
        reach.append(r)
    if not (reach[-1] >> total) & 1:
        return

    def grow(i: int, rest: int, items: int) -> Iterator[tuple[int, ...]]:
        if items == 0 or rest == 0:
            if items == rest:
                yield ()
            return
        for j in range(i, 0, -1):
            s = sizes[j - 1]
            if s * items < rest:
                return  # sizes only get smaller
            for k in range(min(n[s], rest // s, items), 0, -1):
                if (reach[j - 1] >> (rest - s * k)) & 1:
                    for more in grow(j - 1, rest - s * k, items - k):
                        yield (s,) * k + more

    for items in range(3, total // sizes[0] + 1):
        yield from grow(len(sizes), total, items)


def fillings(left: _Left, room: int, most_waste: int, rng: random.Random | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated fillings ``(waste, sizes)`` of ``room`` from the sizes left, least waste and fewest items first.

    A filling is dominated if an item still fits, or if one or two of its items can give way
    to one larger item left that fits."""
    for waste in range(0, min(room, most_waste) + 1):
        if not left.largest(room - waste):  # nothing fits any more
            if not left.largest(room) and room <= most_waste:
                yield room, ()
            return
        for f in _exact(left, room - waste, rng):
            if not _dominated(left, f, waste):
                yield waste, f


def _dominated(left: _Left, f: tuple[int, ...], waste: int) -> bool:
    uses = Counter(f)

    def free(low: int, high: int) -> bool:
        return any(left.n[s] > uses[s] for s in left.sizes(low, high))

    if waste and free(1, waste):
        return True
    kinds = sorted(uses, reverse=True)
    if waste and any(free(x + 1, x + waste) for x in kinds):
        return True
    return any((x != y or uses[x] > 1) and free(x + y, x + y + waste) for i, x in enumerate(kinds) for y in kinds[i:])


class _Level:
    """A largest item, the waste still afforded, fillings to come, and the one taken: content, counts and times."""

    __slots__ = ("content", "slack", "times", "to_come", "top", "uses")

    def __init__(self, left: _Left, capacity: int, slack: int, rng: random.Random | None):
        self.top, self.slack = left.largest(capacity), slack
        left.take(self.top, 1)  # the item the fillings are around
        self.to_come = fillings(left, capacity - self.top, slack, rng)
        self.content, self.uses, self.times = (), (), 0

    def next(self, left: _Left, capacity: int) -> bool:
        """Take the filling once less, or the next one as often as the counts allow."""
        if self.times:
            self._take(left, -1)
            self.times -= 1
            if self.times:
                self._take(left, 1)
                return True
        got = next(self.to_come, None)
        if got is None:
            left.take(self.top, -1)
            return False
        waste, f = got
        self.content = (self.top, *f)
        self.uses = tuple(Counter(self.content).items())
        self.times = min((left.n[s] + (s == self.top)) // k for s, k in self.uses)
        if waste:
            self.times = min(self.times, self.slack // waste)
        self._take(left, 1)
        return True

    def _take(self, left: _Left, sign: int) -> None:
        for s, k in self.uses:
            left.take(s, sign * (k * self.times - (s == self.top)))


def _search(counts: dict[int, int], capacity: int, wanted: int, most_nodes: int) -> tuple[Plan | None, bool, int]:
    """A plan with ``wanted`` containers or None, whether the search went through, and the fillings looked at.

    It begins anew, with pairs in another order, each time it has looked at a part of the
    fillings; what has failed once is remembered throughout."""
    slack = wanted * capacity - sum(s * n for s, n in counts.items())
    failed: dict[int, int] = {}
    nodes, part = 0, max(1, min(most_nodes, max(RESTART, 4 * len(counts))))
    for attempt in range(max(1, most_nodes // part)):
        left = _Left(counts, capacity)
        rng = random.Random(attempt) if attempt else None
        levels = [_Level(left, capacity, slack, rng)]
        until = nodes + part
        while levels and nodes < until:
            level = levels[-1]
            if not level.next(left, capacity):
                levels.pop()
                failed[left.mark] = max(level.slack, failed.get(left.mark, -1))
                continue
            nodes += 1
            if not left.there:
                return [(lv.times, lv.content) for lv in levels], True, nodes
            room = level.slack - (capacity - sum(level.content)) * level.times
            if failed.get(left.mark, -1) < room:
                levels.append(_Level(left, capacity, room, rng))
        if not levels:
            return None, True, nodes
    return None, False, nodes


def fill_histogram(counts: dict[int, int], capacity: int, most_nodes: int = MOST_NODES) -> Filled:
    """Containers as ``(times, sizes)``; the sizes of all containers together are the histogram."""
    counts = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("a size is not between 1 and the capacity")
    if not counts:
        return Filled([], 0, 0)
    incumbent = best_fit(counts, capacity)
    fewest = sum(t for t, _ in incumbent)
    bound = lower_bound(counts, capacity)
    total, proved = 0, True
    for wanted in range(bound, max(bound + 1, fewest)):
        plan, through, nodes = _search(counts, capacity, wanted, max(1, (most_nodes - total) // 2))
        total += nodes
        if plan is not None:
            return Filled(plan, bound, total)
        proved = proved and through
        if proved and wanted < fewest:
            bound = wanted + 1
        if total >= most_nodes:
            break
    return Filled(incumbent, bound, total)


def plan_table(plan: Plan) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Of each size: first ranks, first containers and items per container of its stretches of ranks."""
    table: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    used: Counter = Counter()
    container = 0
    for times, sizes in plan:
        for s, k in Counter(sizes).items():
            ranks, firsts, per = table[s]
            ranks.append(used[s])
            firsts.append(container)
            per.append(k)
            used[s] += times * k
        container += times
    return dict(table)


def _pieces(items: DataFrame, capacity: int, item: str, size: str) -> DataFrame:
    """``item, part, size``: items above the capacity in parts of the capacity and a rest."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("part"), F.least(n - i * capacity, F.lit(capacity).cast("long")).alias("size")))
    return items.select(F.col(item).alias("item"), F.explode(pieces).alias("p")).select("item", "p.part", "p.size")


def fill_containers(items: DataFrame, capacity: int, item: str = "doc_id", size: str = "n_tokens", most_nodes: int = MOST_NODES) -> DataFrame:
    """``item, part, n_tokens, container`` for every item.

    Defined results: an item above the capacity is cut into parts of the capacity and a
    rest, numbered from 0; an item of size 0 or null takes no room and goes to container 0;
    ties in size are given out in the order of the item, however the rows are laid out;
    repeated rows are items of their own; an empty table gives no rows.  Containers are
    numbered from 0.
    """
    spark = items.sparkSession
    pieces = cut_lineage(_pieces(items, capacity, item, size))  # sampled for the ranges, then cut by them
    ordered = pieces.repartitionByRange(parallelism(spark), "size", "item", "part").sortWithinPartitions("size", "item", "part")
    parts = cut_lineage(ordered.withColumn("pid", F.spark_partition_id()))
    cells = sorted((int(r[0]), int(r[1]), int(r[2])) for r in parts.where("size > 0").groupBy("size", "pid").agg(F.count("*")).collect())  # at most capacity + partitions
    counts: Counter = Counter()
    offsets: dict[tuple[int, int], int] = {}
    for s, pid, n in cells:
        offsets[s, pid] = counts[s]
        counts[s] += n
    handle = spark.sparkContext.broadcast((offsets, plan_table(fill_histogram(counts, capacity, most_nodes).plan)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, table = handle.value
        plan = {s: tuple(np.asarray(x, np.int64) for x in v) for s, v in table.items()}
        seen: Counter = Counter()
        for b in batches:
            sizes, pids = b.column(2).to_numpy(), b.column(3).to_numpy()
            out = np.zeros(len(sizes), np.int64)
            cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(pids) != 0)) + 1
            for at in np.split(np.arange(len(sizes)), cuts):
                if len(at) and sizes[at[0]]:
                    cell = int(sizes[at[0]]), int(pids[at[0]])
                    ranks = offsets[cell] + seen[cell] + np.arange(len(at))
                    seen[cell] += len(at)
                    starts, firsts, per = plan[cell[0]]
                    k = np.searchsorted(starts, ranks, side="right") - 1
                    out[at] = firsts[k] + (ranks - starts[k]) // per[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], names=["item", "part", "size", "container"])

    kind = parts.schema["item"].dataType.simpleString()
    placed = parts.mapInArrow(place, f"item {kind}, part int, size long, container long")
    return placed.select(F.col("item").alias(item), "part", F.col("size").alias(size), "container")


def fill_report(items: DataFrame, capacity: int, item: str = "doc_id", size: str = "n_tokens", most_nodes: int = MOST_NODES) -> DataFrame:
    """``n_containers, bound, gap, n_items, filled, waste``: one row, also for an empty table."""
    rows = _pieces(items, capacity, item, size).where("size > 0").groupBy("size").agg(F.count("*")).collect()  # at most capacity
    counts = {int(r[0]): int(r[1]) for r in rows}
    got = fill_histogram(counts, capacity, most_nodes)
    filled = sum(s * n for s, n in counts.items())
    row = (got.containers, got.bound, got.containers - got.bound, sum(counts.values()), filled, got.containers * capacity - filled)
    return items.sparkSession.createDataFrame([row], "n_containers long, bound long, gap long, n_items long, filled long, waste long")
