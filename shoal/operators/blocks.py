"""The eps self-join where nothing can be pruned: all pairs, block against block.

Both sides are dealt over pairs of blocks. A task holds one block and the other's rows stream
by; a matrix product tells which pairs may be closer than eps, with a bound on its rounding,
and only those get their distance summed in dimension order, the bits of ``distance``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Numbers in a tile of products; coordinates of pairs and bytes of rows given out at once, about.
TILE, PAIRS, OUT_BYTES = 1 << 22, 1 << 22, 1 << 24
#: Partitions at most.
PARTS = 4_096


class _Block:
    """The rows of one block: a table without vectors, and the vectors."""

    def __init__(self, rows: pa.Table, vecs: np.ndarray, eps: float, selves: bool):
        self.rows, self.vecs, self.eps, self.selves = rows, vecs, eps, selves
        self.columns = np.ascontiguousarray(vecs.T)
        # About a point of the block, so that places far from the origin don't cost precision.
        self.centre = vecs[0].copy()
        moved, squares, self.most = self._moved(vecs)
        self.left = np.ascontiguousarray(np.column_stack((-2 * moved, squares, np.ones(len(vecs)))).T)
        ids = rows["a_id"].to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]

    def _moved(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Vectors about the centre, their squares (NaN, hence nothing sure, where too large) and the largest square."""
        with np.errstate(over="ignore", invalid="ignore"):
            moved = vecs - self.centre
            squares = np.einsum("ij,ij->i", moved, moved)
        odd = ~(squares < 1e300)
        moved[odd], squares[odd] = 0, np.nan
        return moved, squares, float(np.max(squares, where=~odd, initial=0.0))

    def tiles(self, ids: np.ndarray, vecs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, sure, open): which pairs of the rows from start on and the block's are closer
        than eps, and which may be."""
        dims = vecs.shape[1]
        step = max(1, TILE // len(self.vecs))
        for start in range(0, len(vecs), step):
            moved, squares, most = self._moved(vecs[start : start + step])
            found = np.column_stack((moved, np.ones(len(moved)), squares)) @ self.left
            slack = (dims + 16) * 2.0**-50 * (self.most + most + self.eps * self.eps) + 1e-300
            if not self.selves:
                own = ids[start : start + step]
                at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
                same = np.flatnonzero(self.ids[at] == own)
                found[same, self.order[at[same]]] = np.inf
            sure = found < self.eps * self.eps - slack
            yield start, sure, ~(sure | (found > self.eps * self.eps + slack))

    def distances(self, vecs: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mine))
        with np.errstate(over="ignore"):
            for column, other in zip(self.columns, vecs.T, strict=True):
                gap = column[mine] - other[theirs]
                total += gap * gap
        return np.sqrt(total)

    def pairs(self, rows: pa.Table, vecs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of the block, rows given, distance) of the pairs closer than eps, in parts."""
        wide = self.rows.nbytes / self.rows.num_rows + rows.nbytes / rows.num_rows
        step = max(1, int(min(PAIRS / vecs.shape[1], OUT_BYTES / (wide + 8))))
        for start, sure, open_ in self.tiles(rows["b_id"].to_numpy(), vecs):
            theirs, mine = np.nonzero(sure | open_)
            for i in range(0, len(mine), step):
                a, b = mine[i : i + step], theirs[i : i + step] + start
                far = self.distances(vecs, a, b)
                near = far < self.eps
                if near.any():
                    yield a[near], b[near], far[near]

    def sums(self, rows: pa.Table, vecs: np.ndarray) -> np.ndarray:
        """For each row of the block, the weights of the rows given that are closer than eps."""
        weights = rows["b_weight"].to_numpy()
        total = np.zeros(len(self.vecs), dtype=np.int64)
        step = max(1, PAIRS // vecs.shape[1])
        for start, sure, open_ in self.tiles(rows["b_id"].to_numpy(), vecs):
            here = weights[start : start + len(sure)]
            if here.min() == here.max():
                total += np.count_nonzero(sure, axis=0) * here[0]
            else:
                for w in np.unique(here):
                    total += np.count_nonzero(sure[here == w], axis=0) * w
            theirs, mine = np.nonzero(open_)
            for i in range(0, len(mine), step):
                a, b = mine[i : i + step], theirs[i : i + step] + start
                near = self.distances(vecs, a, b) < self.eps
                np.add.at(total, a[near], weights[b[near]])
        return total


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _met(batches: Iterator[pa.RecordBatch], keys: list[str], dims: int, eps: float, selves: bool) -> Iterator[tuple[_Block, pa.Table | None, np.ndarray | None]]:
    """Each block with the rows that stream by; the block alone at its end."""
    key, parts, block = None, [], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        vecs = _vectors(rows["_vec"], dims)
        runs = np.column_stack([rows[k].to_numpy() for k in (*keys, "_side")])
        rows = rows.drop_columns(["_vec"])
        cuts = np.flatnonzero((runs[1:] != runs[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(runs)], strict=True):
            *at, side = runs[start].tolist()
            if at != key:
                if block:
                    yield block, None, None
                key, parts, block = at, [], None
            part = rows.slice(start, end - start), vecs[start:end]
            if not side:
                parts.append(part)
                continue
            if parts:
                block = _Block(pa.concat_tables([r for r, _ in parts]), np.concatenate([v for _, v in parts]), eps, selves)
                parts = []
            if block:
                yield block, *part
    if block:
        yield block, None, None


def _dealt(a: DataFrame, b: DataFrame, dims: int, blocks: int, by: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Rows of ``a`` (a_*, side 0) and ``b`` (b_*, side 1) by pairs of blocks, a pair's together and side 0 first."""
    keys = ["_i", "_j", *[f"_by{k}" for k in range(len(by))]]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def side(df: DataFrame, x: str, number: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(f"{x}_id"), F.lit(blocks)).cast("int")
        same: list[Column] = [F.col(f"{x}_{c}").cast("long").alias(f"_by{k}") for k, c in enumerate(by)]
        rest = [c for c in df.columns if c != f"{x}_vec"]
        df = df.where(F.size(f"{x}_vec") == dims)
        return df.select(*rest, F.col(f"{x}_vec").alias("_vec"), *same, F.lit(number).alias("_side"), block.alias(own), every.alias(other))

    rows = side(a, "a", 0, "_i", "_j").unionByName(side(b, "b", 1, "_j", "_i"), allowMissingColumns=True)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTS, blocks * blocks))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "_side"), keys


def block_pairs(a: DataFrame, b: DataFrame, dims: int, eps: float, blocks: int, by: tuple[str, ...] = (), selves: bool = False) -> DataFrame:
    """(a_*, b_* without vectors, distance) of all pairs closer than eps, of different ids unless ``selves``."""
    rows, keys = _dealt(a, b, dims, blocks, by)
    mine, theirs = ([c for c in df.columns if not c.endswith("_vec")] for df in (a, b))
    schema = T.StructType([T.StructField(f.name, f.dataType) for n, df in ((mine, a), (theirs, b)) for f in df.select(*n).schema] + [T.StructField("distance", T.DoubleType())])
    form = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, given, vecs in _met(batches, keys, dims, eps, selves):
            for at, of, far in block.pairs(given, vecs) if given else ():
                left, right = block.rows.select(mine).take(at), given.select(theirs).take(of)
                columns = [c.combine_chunks() for c in (*left.columns, *right.columns)]
                yield from pa.Table.from_arrays([*columns, pa.array(far)], names=schema.names).cast(form).to_batches()

    return rows.mapInArrow(found, schema)


def block_sums(a: DataFrame, b: DataFrame, dims: int, eps: float, blocks: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(a_by..., a_id, weight): sums of b_weight over rows of other ids closer than eps, a row a pair of blocks."""
    rows, keys = _dealt(a, b, dims, blocks, by)
    names = [*[f"a_{c}" for c in by], "a_id"]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in a.select(*names).schema], T.StructField("weight", T.LongType())])
    form = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for block, given, vecs in _met(batches, keys, dims, eps, False):
            if given:
                total = total + block.sums(given, vecs)
                continue
            some = np.flatnonzero(total)
            columns = [c.combine_chunks() for c in block.rows.select(names).take(some).columns]
            yield from pa.Table.from_arrays([*columns, pa.array(total[some])], names=schema.names).cast(form).to_batches()
            total = 0

    return rows.mapInArrow(found, schema)
