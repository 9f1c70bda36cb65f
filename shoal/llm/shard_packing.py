"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows that belong together (equal texts, in the query) form a group, which stays whole.
Groups are counted by size class, so the packing works on a table whose length is bounded by
the number of classes: sizes to ``DIGITS`` significant bits, some 4,096 for each doubling.
Classes are packed from the largest down; each group enters the fullest bin that still takes
it, found in a balanced tree ordered by remaining room. Groups then take the planned bins by
joining on their rank in their class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.spread import ranked, settled

#: Significant bits of a size class.
DIGITS = 12
OVERHEAD = 16


@dataclass
class _Node:
    key: tuple[int, int]
    rank: int
    left: _Node | None = None
    right: _Node | None = None


@dataclass
class RoomTree:
    """A balanced search tree (a treap) of (room, bin): insert, delete, least room of at least so much."""

    root: _Node | None = None
    _draw: int = field(default=88172645463325252)

    def _random(self) -> int:
        x = self._draw
        x ^= (x << 13) & (2**64 - 1)
        x ^= x >> 7
        x ^= (x << 17) & (2**64 - 1)
        self._draw = x
        return x

    def insert(self, room: int, bin_: int) -> None:
        less, more = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(less, _Node((room, bin_), self._random())), more)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room >= size (smallest number first)."""
        less, more = self._split(self.root, (size, -1))
        if more is None:
            self.root = less
            return None
        node = more
        while node.left:
            node = node.left
        _, rest = self._split(more, (node.key[0], node.key[1] + 1))
        self.root = self._join(less, rest)
        return node.key

    def _split(self, node: _Node | None, key: tuple[int, int]):
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self._split(node.right, key)
            return node, more
        less, node.left = self._split(node.left, key)
        return less, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b


def best_fit_decreasing(
    classes: list[tuple[int, int]], capacity: int, bins: int | None = None
) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Packs (size, count) classes, largest first, into bins of ``capacity``.

    Returns runs (size, first rank, end rank, bin) and the number of bins; with ``bins``
    given, None if they don't suffice. A bin just filled is still the tightest that fits,
    so it takes as many of a class at once as it can.
    """
    tree, runs, used = RoomTree(), [], 0
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            return None
        rank = 0
        while rank < count:
            room, at = tree.pop_tightest(size) or (capacity, -1)
            if at < 0:
                if bins is not None and used == bins:
                    return None
                at, used = used, used + 1
            n = min(count - rank, room // size)
            runs.append((size, rank, rank + n, at))
            rank += n
            if room > n * size:
                tree.insert(room - n * size, at)
    return runs, used


def near_equal(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Packs into exactly ``bins`` shards with sizes near equal.

    Groups above a fair share get a shard each. For the rest the least capacity that packs
    into the shards left is searched for by halving (the packing itself is best fit
    decreasing). Groups too small to matter go last and even out what is left.
    """
    own, at = [], 0
    left = sorted((c for c in classes if c[1]), reverse=True)
    total = sum(s * n for s, n in left)
    while left and bins - at > 1 and left[0][0] * (bins - at) >= total:
        size, count = left[0]
        n = min(count, bins - at - 1, max(1, total // max(1, size)))
        n = next(k for k in range(1, n + 1) if k == n or size * (bins - at - k) < total - k * size)
        own += [(size, i, i + 1, at + i) for i in range(n)]
        at, total = at + n, total - n * size
        left = ([(size, count - n)] if count > n else []) + left[1:]
    taken = {}
    for size, _, end, _ in own:
        taken[size] = max(taken.get(size, 0), end)
    n = bins - at
    if not left:
        return own
    low, high = max(left[0][0], -(-total // n)), left[0][0] + -(-total // n)
    best = best_fit_decreasing(left, high, n)
    while best is None:
        low, high = high, 2 * high
        best = best_fit_decreasing(left, high, n)
    while low < high and high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        if (plan := best_fit_decreasing(left, middle, n)) is None:
            low = middle + 1
        else:
            best, high = plan, middle
    return own + [(s, a + taken.get(s, 0), b + taken.get(s, 0), at + i) for s, a, b, i in best[0]]


def size_class(size: F.Column, digits: int = DIGITS) -> F.Column:
    """The size rounded up to so many significant bits; smaller sizes stay as they are."""
    bits = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) + 1 - digits, F.lit(0)).cast("int")
    step = F.expr("1L") if digits >= 63 else F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return F.ceil(size / step).cast("long") * step


def packed_shards(items: DataFrame, bins: int, group_cols: list[str], capacity: int | None = None) -> DataFrame:
    """Adds shard and slot to ``items``, which has a long ``size`` and non-null group columns.

    All rows of a group get one shard. With ``capacity`` shards hold that much at most (a
    larger group is an error) and as few as best fit needs are opened; without, ``bins``
    shards of near equal size. ``slot`` is gapless from 0 in each shard. ``items`` is read
    several times; a group may hold any part of its rows.
    """
    spark = items.sparkSession
    groups = items.groupBy(*group_cols).agg(F.sum("size").alias("group_size"))
    groups = settled(groups.withColumn("size_class", F.greatest(size_class(F.col("group_size")), F.lit(1))))
    found = groups.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()
    classes = [(r["size_class"], r["n"]) for r in found]
    if capacity is None:
        plan = near_equal(classes, bins)
    elif (fitted := best_fit_decreasing(classes, capacity)) is None:
        raise ValueError(f"a group is larger than a shard of {capacity}")
    else:
        plan = fitted[0]
    schema = "size_class long, first_rank long, end_rank long, shard int"
    runs = spark.createDataFrame([tuple(map(int, r)) for r in plan], schema)
    placed = ranked(groups, ["size_class"], group_cols, "rank", sum(n for _, n in classes))
    placed = placed.join(runs, "size_class").where("rank >= first_rank and rank < end_rank")
    return items.join(placed.select(*group_cols, "shard"), group_cols)


def shard_documents(docs: DataFrame, bins: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Law ``bytes``: shard sizes near equal, equal texts together. A null text is an empty one.
    Every row is placed, repeated rows and null ids too; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(F.encode(text, "utf-8")).alias("text_md5"),
    )
    rows = settled(rows)
    packed = packed_shards(rows, bins, ["text_md5"])
    return ranked(packed, ["shard"], ["doc_id", "text_md5"], "slot", rows.count()).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
