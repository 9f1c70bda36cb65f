"""SuperMinHash near-duplicate detection: signatures, banding, exact verification, components.

A signature slot keeps, over a document's distinct shingles, the least of step + fraction,
where each shingle visits the slots in the order of its own permutation. The ranks of one
shingle in different slots are thus correlated (no two are equal), which lowers the
estimate's variance, and once every slot of a document has a value below step j, no later
step can change it: long documents stop after the first steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import vectext
from shoal.llm.spread import in_arrow, key_order, one_of_each, settled, text_key
from shoal.operators.components import connected_components, union_find

_STEP = 40  # bits of the fraction in a slot's value
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Members of a bucket whose signatures are compared with each other; a larger one is one family.
BUCKET_MEMBERS = 512
#: Members of a family whose full sets are compared in one task, at most about twice as many,
#: and the sets' bytes.
FAMILY_BLOCK, FAMILY_BYTES = 128, 1 << 23
#: Component edges up to this number are finished by one task.
ALONE = 1_000_000
#: Shared elements that are laid out at a time in a comparison.
SLICE = 8192


@dataclass(frozen=True)
class NearDuplicates:
    """Words a shingle; 100 * intersection >= percent * union links; bands of rows slots each.

    A link at exactly the threshold t is missed in all bands with probability
    (1 - t^rows)^bands: 3e-8 here at 0.8. Bucket mates whose estimate lies more than ``slack``
    below the threshold (over five standard deviations) don't count as candidates. Sets are
    told apart by two fingerprints, of which the first has ``print_bits`` bits.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    slack: float = 0.18
    print_bits: int = 64

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lowered), and each row's bounds.

    With fewer words than a shingle the whole sequence is one; without words the set is empty.
    """
    data, offsets = vectext.utf8(column)
    data = vectext.LOWER[data]
    starts, ends, bounds = vectext.word_spans(data, offsets)
    hashes = vectext.RunHash(vectext.word_hashes(data, starts, ends))
    out, sizes = [], np.zeros(len(offsets), np.int64)
    first = np.arange(max(0, len(starts) - words + 1))
    runs = hashes.runs(first, first + words)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= words:
            s = np.sort(runs[a : b - words + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            s = hashes.runs(np.array([a]), np.array([b]))[: b > a]
        out.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def signatures(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash values (rows x slots, uint64: step in the high bits, fraction below)."""
    rows = len(bounds) - 1
    values = np.full(rows * slots, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    order = None
    for j in range(slots):
        draw = vectext.mixed(elements + np.uint64((int(_GOLD) * (j + 1)) % 2**64))
        other = j + ((draw >> np.uint64(48)) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = other
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
                here = np.arange(len(elements))
                zeroth = (vectext.mixed(elements + _GOLD) >> np.uint64(48)) % np.uint64(slots)
                order[here, 0] = zeroth
                order[here, zeroth.astype(np.int64)] = 0
            slot = order[here, other].astype(np.int64)
            order[here, other] = order[here, j]
            order[here, j] = slot
        value = (np.uint64(j) << np.uint64(_STEP)) | (vectext.mixed(draw) >> np.uint64(64 - _STEP))
        np.minimum.at(values, row * slots + slot, value)
        going = values.reshape(rows, slots).max(axis=1, initial=0) >= (np.uint64(j + 1) << np.uint64(_STEP))
        keep = going[row]
        if not keep.any():
            break
        if not keep.all():
            elements, row = elements[keep], row[keep]
            if order is not None:
                order = order[keep]
                here = np.arange(len(elements))
    return values.reshape(rows, slots)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _described(column: pa.Array, how: NearDuplicates):
    """Set sizes, two set fingerprints, one byte a slot, and band hashes of each text."""
    elements, bounds = shingle_sets(column, how.shingle)
    n = np.diff(bounds)
    prints = vectext.mixed(_sums(vectext.mixed(elements), bounds) + n.astype(np.uint64)) >> np.uint64(64 - how.print_bits)
    check = vectext.mixed(_sums(vectext.mixed(elements ^ _GOLD), bounds))
    values = signatures(elements, bounds, how.slots)
    tags = vectext.mixed(values).astype(np.uint8)
    weights = vectext.powers(how.rows + 1)[1:]
    bands = (values.reshape(len(n), how.bands, how.rows) * weights).sum(axis=2, dtype=np.uint64)
    bands = vectext.mixed(bands + np.arange(how.bands, dtype=np.uint64) * _GOLD)
    return n, prints, check, tags, bands


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())])


def _longs(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def described(texts: DataFrame, how: NearDuplicates) -> DataFrame:
    """Replaces text, the last column, by n, node, check, tags and bands.

    node and check are the set's fingerprints; node is 0 of an empty set.
    """
    rest = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectext.blocks(batches, len(rest)):
            n, prints, check, tags, bands = _described(b.column(len(rest)), how)
            node = np.where(n > 0, prints.view(np.int64), 0)
            arrays = [*b.columns[:-1], pa.array(n), pa.array(node), pa.array(check.view(np.int64)), _binary(tags), _longs(bands)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n", "node", "check", "tags", "bands"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return in_arrow(texts, run, f"{kept}, n long, node long, check long, tags binary, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows equal in the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(keys)]
        changed = np.zeros(b.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        changed[0] = last is not None and tuple(c[0] for c in columns) != last
        cuts = [0, *np.flatnonzero(changed).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and changed[a]:
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(b.slice(a, z - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _estimates(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of tag rows that agree in at least that part."""
    need = int(np.ceil(least * a.shape[1]))
    found = []
    for i in range(0, len(a), 32):
        x, y = np.nonzero((a[i : i + 32, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16) >= need)
        found.append((x + i, y))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


_PAIRS = "a long, c long"


def _pair_batch(a: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, c), np.maximum(a, c)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "c"])


def _likely(how: NearDuplicates):
    """Of each bucket, its members that are likely linked, as stars: at most one pair a member."""
    least = how.percent / 100 - how.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1):
            node, n = t.column(1).to_numpy(), t.column(2).to_numpy()
            if len(node) < 2:
                continue
            tags = _matrix(t.column(3))
            x, y = _estimates(tags, tags, least)
            ok = (x < y) & _alike(n[x], n[y], how.percent)
            if ok.any():
                nodes, roots = union_find(node[x[ok]], node[y[ok]])
                yield _pair_batch(nodes[nodes != roots], roots[nodes != roots])

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, exactly.

    Sets become rows of 0 and 1 over their common elements, a slice of those at a time, and
    the sizes are matrix products.
    """
    sizes = np.array([len(x) for x in [*a, *b]])
    elements, at, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(elements), -1)
    place[shared] = np.arange(len(shared))
    column, row = place[at], np.repeat(np.arange(len(sizes)), sizes)
    column, row = column[column >= 0], row[column >= 0]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(shared), SLICE):
        x, z = np.searchsorted(column, (low, low + SLICE))
        hot = np.zeros((len(sizes), min(SLICE, len(shared) - low)), np.float32)
        hot[row[x:z], column[x:z] - low] = 1
        # Sums of at most SLICE ones: exact in single precision.
        out += (hot[: len(a)] @ hot[len(a) :].T).astype(np.int64)
    return out


def _compared(how: NearDuplicates, inside: bool):
    """Links of a group's side 1 with its side 0 (and, if ``inside``, with itself), as stars.

    All pairs of the two blocks are decided on their full sets. Of the links, a star around
    the smallest node of each component in the group is returned: at most one row a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            side, node, component = (t.column(i).to_numpy() for i in (3, 4, 5))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(6)]
            left = np.arange(len(side)) if inside else np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1)
            if len(left) < 1 + inside or not len(right):
                continue
            n = np.array([len(x) for x in sets])
            both = _intersections([sets[i] for i in left], [sets[i] for i in right])
            linked = 100 * both >= how.percent * (n[left][:, None] + n[right][None, :] - both)
            linked &= component[left][:, None] != component[right][None, :]
            x, y = np.nonzero(linked)
            if len(x):
                nodes, roots = union_find(node[left[x]], node[right[y]])
                yield _pair_batch(nodes[nodes != roots], roots[nodes != roots])

    return run


def near_duplicates(docs: DataFrame, how: NearDuplicates | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one node from the start. Each bucket's likely pairs join
    nodes to families: every candidate pair lies in one family. Families
    are then settled on full sets in blocks, exactly. First each block by itself and against
    the family's first block; then, where that leaves a family in several components, all
    members outside its main component against all members. A family that holds together is
    thus settled in work that grows with its size, and pairs are never written out as rows:
    a block returns stars.

    Every row is a document of its own, whatever ids rows share. component_id is the smallest
    id of the component; a null id counts as larger than any other and stays null. Of each
    component one row is kept: that with the smallest id, of several with that id the one with
    the least hash of its text, of rows alike in both any one. A null or wordless text has the
    empty set, is linked with nothing and kept. An empty table gives no rows.
    """
    shown = lambda key, absent: F.when(~F.col(absent), F.col(key))
    return _classified(docs, how or NearDuplicates(), id_col, text_col).select(
        shown("k", "absent").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        shown("least.k", "least.absent").alias("component_id"),
        (F.col("r") == F.col("least.r")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, how: NearDuplicates | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept row of each component, columns as they are."""
    names, key = docs.columns, ["_shoal_absent", "_shoal_k", "_shoal_h"]
    found = _classified(docs, how or NearDuplicates(), id_col, text_col).where("n > 0")
    stays = F.col("r") == F.col("least.r")
    # Rows alike in id and text are in the same component.
    by = [F.col(c).alias(k) for c, k in zip(("absent", "k", "h"), key, strict=True)]
    told = found.groupBy(*by).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("m"))
    told = settled(told.where("not stays or m > 1"))
    absent, order = key_order(id_col)
    keyed = docs.withColumns({key[0]: absent, key[1]: order, key[2]: text_key(F.col(text_col))})
    left = keyed.join(told.where("not stays").select(*key), key, "left_anti").select(*keyed.columns)
    again = told.where("stays")
    return (left if again.isEmpty() else one_of_each(left, again, key)).select(*names)


def _distinct_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with one node for each set, and each node's first row (node, at).

    Where sets share a fingerprint but not the other, they get nodes of their own: equal sets
    are thus told by 128 bits.
    """
    for _ in range(8):
        least = F.min(F.struct("absent", "k", "h", "r")).alias("at")
        by = rows.where("n > 0").groupBy("node").agg(least, F.min("check").alias("low"), F.max("check").alias("high"))
        firsts = settled(by)
        odd = firsts.where("low <> high")
        if odd.isEmpty():
            return rows, firsts.select("node", "at")
        node = F.when(F.col("low").isNull() | (F.col("check") == F.col("low")), F.col("node")).otherwise(F.xxhash64("node", "check"))
        rows = settled(rows.join(odd.select("node", "low"), "node", "left").withColumn("node", node).drop("low"))
    raise RuntimeError("fingerprints did not settle")


def _classified(docs: DataFrame, how: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``docs``: r (its number), absent and k (its id), h (its text's hash), n, and
    ``least``, those of its component's first row."""
    absent, order = key_order(id_col)
    text = F.col(text_col).cast("string")
    texts = docs.select(absent.alias("absent"), order.alias("k"), text_key(text).alias("h"), text.alias("text"))
    # Settled at once: a row keeps its number.
    rows = texts.select(F.monotonically_increasing_id().alias("r"), *texts.columns)
    rows, firsts = _distinct_nodes(settled(described(rows, how)))

    full = rows.where("n > 0")
    nodes = full.join(firsts.select("node", "at.r"), ["node", "r"])
    slots = nodes.select("node", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    members = settled(slots.join(shared.where("low <> high"), "band").select("band", "size", "low", "node"))
    wanted = members.select("node").distinct()
    known = settled(nodes.join(wanted, "node").select("node", "absent", "k", "h", "n", "tags"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectext.blocks(batches, 1):
            elements, bounds = shingle_sets(b.column(1), how.shingle)
            ends = pa.py_buffer((bounds * 8).astype(np.int32))
            blobs = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(elements.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), blobs], names=["node", "elements"])

    # Rows alike in id and text have the same set; one is kept.
    mine = ["absent", "k", "h"]
    sets = in_arrow(texts.join(known.select(*mine, "node"), mine).select("node", "text"), gathered, "node long, elements binary")
    sets = settled(sets.dropDuplicates(["node"]))

    tagged = known.select("node", "n", "tags")
    buckets = members.where(F.col("size") <= BUCKET_MEMBERS).join(tagged, "node").select("band", "node", "n", "tags")
    buckets = buckets.repartition("band").sortWithinPartitions("band", "node")
    likely = in_arrow(buckets, _likely(how), _PAIRS).distinct()
    large = members.where(F.col("size") > BUCKET_MEMBERS).select(F.col("node").alias("a"), F.col("low").alias("c"))
    families = connected_components(likely.union(large.distinct()), "a", "c", settled, ALONE)
    families = settled(families.withColumnRenamed("component", "family").join(known.select("node", "n"), "node"))

    blocks_of = lambda members, elements: F.ceil(F.greatest(members / FAMILY_BLOCK, elements * 8 / FAMILY_BYTES)).cast("long")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).where("size > 1")
    spread = families.drop("n").join(sizes.select("family", blocks_of(F.col("size"), F.col("n")).alias("lines")), "family")
    spread = spread.withColumn("line", F.pmod(F.xxhash64("node"), "lines"))
    zero = F.lit(0).cast("long")
    own = spread.select("family", "line", zero.alias("column"), F.lit(1).alias("side"), "node", F.col("node").alias("component"))
    pivot = spread.where("line = 0 and lines > 1").withColumn("line", F.explode(F.expr("sequence(1L, lines - 1)")))
    pivot = pivot.select("family", "line", zero.alias("column"), F.lit(0).alias("side"), "node", F.col("node").alias("component"))

    def compared(rows: DataFrame, inside: bool) -> DataFrame:
        rows = rows.join(sets, "node").select("family", "line", "column", "side", "node", "component", "elements")
        rows = rows.repartition("family", "line", "column").sortWithinPartitions("family", "line", "column", "side")
        return in_arrow(rows, _compared(how, inside), _PAIRS)

    links = settled(compared(own.union(pivot), True))
    labels = connected_components(links, "a", "c", settled, ALONE)
    where = families.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    where = settled(where.select("family", "node", "n", "component"))
    by = where.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    split = by.groupBy("family").agg(
        F.max_by(F.struct("component", "m", "n"), F.struct("m", "component")).alias("main"), F.sum("m").alias("m"), F.sum("n").alias("n")
    )
    split = split.select(
        "family",
        F.col("main.component").alias("main"),
        (F.col("main.m") < F.col("m")).alias("several"),
        blocks_of(F.col("m"), F.col("n")).alias("columns"),
        blocks_of(F.col("m") - F.col("main.m"), F.col("n") - F.col("main.n")).alias("lines"),
    )
    # One block has met all of itself already.
    spread = where.drop("n").join(split.where("several and columns > 1"), "family")
    line, column = F.pmod(F.xxhash64("node"), "lines"), F.pmod(F.xxhash64("node"), "columns")
    strays = spread.where("component <> main").withColumn("line", line).withColumn("column", F.explode(F.expr("sequence(0L, columns - 1)")))
    others = spread.withColumn("column", column).withColumn("line", F.explode(F.expr("sequence(0L, lines - 1)")))
    meet = strays.select("family", "line", "column", F.lit(0).alias("side"), "node", "component").union(
        others.select("family", "line", "column", F.lit(1).alias("side"), "node", "component")
    )
    more = compared(meet, False)
    final = connected_components(links.union(more), "a", "c", settled, ALONE)

    smallest = settled(firsts.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # Computed by itself, so that the join below can be split where a component is large.
    lowest = settled(smallest.groupBy("component").agg(F.min("at").alias("least")))
    classes = smallest.join(lowest, "component").select("node", "least")
    columns = ["r", "absent", "k", "h", "n"]
    linked = full.join(classes, "node").select(*columns, "least")
    alone = rows.where("n = 0").select(*columns, F.struct("absent", "k", "h", "r").alias("least"))
    return linked.union(alone)
