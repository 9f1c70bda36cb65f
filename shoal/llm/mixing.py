"""Mixing sources to target weights with fixed-length blocks.

Each source's words, in a fixed order of its documents, form one stream that is cut into
blocks of ``block`` words. The mix is a list of slots over output shards. Shards draw their
sources' slot counts from a multinomial over what the sources still have to give, so the
totals are exact and each shard is a random draw. Slot j of a source holds block
permutation(j mod blocks) of pass j div blocks: one pass takes each block once, and no
source gives more than two passes. Permutations are keyed Feistel networks, computed from
the index alone. Documents' parts and slots then meet in a join on (source, block).

On the driver are only the sources' sizes and the shard table (sources times shards rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import vectext
from shoal.llm.spread import in_arrow, in_pandas, ranked, row_hash, running_start, settled, text_key

BLOCK_WORDS = 256
SHARDS = 64
#: Sources up to this number are joined by broadcast; more by an ordinary join.
BROADCAST_SOURCES = 50_000
#: Slots made from one row of the shard table at a time.
RUN = 20_000


@dataclass(frozen=True)
class Mixture:
    """Weights repeat over the sources in code point order, null last."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    block: int = BLOCK_WORDS
    shards: int = SHARDS
    seed: int = 7

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0 or not 0 <= self.share <= self.most:
            raise ValueError("weights must be positive and share between 0 and most")
        if self.block < 1 or self.shards < 1:
            raise ValueError("block and shards must be positive")


def targets(sizes: list[int], mixture: Mixture) -> list[float]:
    """Each source's words in the mix: shares by weight, none above ``most`` times its size."""
    weight = [mixture.weights[i % len(mixture.weights)] for i in range(len(sizes))]
    left, free = mixture.share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while free:
        total = sum(weight[i] for i in free)
        share = {i: left * weight[i] / total for i in sorted(free)}
        over = [i for i in share if share[i] > mixture.most * sizes[i]]
        for i in over or share:
            out[i] = mixture.most * sizes[i] if over else share[i]
            left -= out[i]
            free.discard(i)
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: Feistel rounds, walked into range."""
    bits = np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            turn = vectext.mixed(right + vectext.mixed(k * np.uint64(8) + np.uint64(r + 1)))
            left, right = right, left ^ (turn & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _keys(source: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    return vectext.mixed((source.astype(np.uint64) << np.uint64(20)) + turn.astype(np.uint64) + np.uint64(seed << 44))


def source_plan(sizes: list[int], mixture: Mixture) -> pd.DataFrame:
    """Per source: its target, its number of slots, and the words that the last slot leaves out."""
    rows = []
    for i, (size, target) in enumerate(zip(sizes, targets(sizes, mixture), strict=True)):
        n, words = -(-size // mixture.block), min(round(target), int(mixture.most * size))
        turns, rest = divmod(words, size) if size else (0, 0)
        slots, cut = turns * n, 0
        if rest:
            every = np.arange(1)
            key = _keys(every + i, every + turns, mixture.seed)
            k = -(-rest // mixture.block)
            short = mixture.block * n - size
            if short:
                found = _place(n - 1, n, key, k)
                held = k * mixture.block - short * found
                if held < rest:
                    k += 1
                    held += mixture.block
            else:
                held = k * mixture.block
            slots, cut = slots + k, held - rest
        rows.append((i, size, target, n, slots, cut))
    return pd.DataFrame(rows, columns=["src", "source_size", "target", "blocks", "slots", "cut"])


def _place(block: int, n: int, key: np.ndarray, upto: int) -> bool:
    """Whether ``block`` has a place under ``upto`` in the permutation, by walking it backwards."""
    half = (int(np.ceil(np.log2(max(n, 2)))) + 1) // 2
    mask, at = (1 << half) - 1, block
    while True:
        left, right = at >> half, at & mask
        for r in (3, 2, 1, 0):
            turn = vectext.mixed(
                np.array([left], np.uint64) + vectext.mixed(key * np.uint64(8) + np.uint64(r + 1))
            )
            left, right = right ^ (int(turn[0]) & mask), left
        at = (left << half) | right
        if at < n:
            return at < upto


def shard_table(plan: pd.DataFrame, mixture: Mixture) -> pd.DataFrame:
    """Slot counts drawn shard by shard: (src, shard, first slot, number of slots).

    Shards differ by one slot at most."""
    left = plan["slots"].to_numpy(np.int64).copy()
    rng = np.random.default_rng(mixture.seed)
    total = int(left.sum())
    taken, out = np.zeros(len(left), np.int64), []
    for shard in range(mixture.shards):
        draw = np.zeros(len(left), np.int64)
        want = total * (shard + 1) // mixture.shards - total * shard // mixture.shards
        while want:
            room = left - draw
            more = np.minimum(rng.multinomial(want, room / room.sum()), room)
            draw, want = draw + more, want - int(more.sum())
        for i in np.flatnonzero(draw):
            out.append((int(i), shard, int(taken[i]), int(draw[i])))
        taken, left = taken + draw, left - draw
    return pd.DataFrame(out, columns=["src", "shard", "first", "n"]).astype("int64")


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, text_hash): words counted in each whole text; null has none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectext.blocks(batches, 2):
            n = pa.array(vectext.word_counts(b.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, b.column(3)], names=names)

    names = ["doc_id", "source", "size", "text_hash"]
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).alias("text"),
        text_key(F.col(text_col)).alias("text_hash"),
    )
    return in_arrow(texts, counted, "doc_id long, source string, size long, text_hash binary")


@dataclass(frozen=True)
class Mixed:
    """documents: doc_id, source, size, text_hash, src, start, source_size, target.
    slots: src, shard, slot, turn, block, take. parts: src, start, turn, shard, slot, low, high
    (the words low to high of the document that starts there, taken for that slot)."""

    documents: DataFrame
    slots: DataFrame
    parts: DataFrame


def mix(sizes: DataFrame, mixture: Mixture) -> Mixed:
    """Plans the mix over ``sizes`` (doc_id, source, size, text_hash), which is read a few times.

    Each row is a document of its own. Null sources are one source, the last. Documents
    without words take no part but stay in ``documents``. An empty table gives empty results.
    """
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = source_plan([r["size"] for r in found], mixture)
    named = "key string, src long, source_size long, target double"
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    rows = [
        ("" if r["source"] is None else "=" + r["source"], int(p.src), int(p.source_size), float(p.target))
        for r, p in zip(found, plan.itertuples(), strict=True)
    ]
    table = spark.createDataFrame(rows, named)
    table = F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table
    known = sizes.withColumn("key", key).join(table, "key").drop("key")
    documents = settled(running_start(known, ["src"], ["doc_id", "text_hash"], "size", "start", sum(r["rows"] for r in found)))

    by_src = plan.set_index("src")
    shards = shard_table(plan, mixture)
    runs = [
        (*map(int, r[:4]), *(int(by_src.at[r.src, c]) for c in ("source_size", "blocks", "slots", "cut")))
        for r in shards.itertuples(index=False)
    ]
    named = "src long, shard long, first long, n long, source_size long, blocks long, slots long, cut long"
    runs = spark.createDataFrame(runs, named)
    runs = runs.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)"))).repartition("src", "at")
    slots = runs.withColumn("slot", F.explode(F.expr(f"sequence(first + at, first + least(at + {RUN}, n) - 1)")))
    block, seed = mixture.block, mixture.seed

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            src, slot, n = (b[c].to_numpy(np.int64) for c in ("src", "slot", "blocks"))
            turn = slot // n
            at = permuted(slot % n, n, _keys(src, turn, seed))
            take = np.minimum(block, b["source_size"].to_numpy(np.int64) - at * block)
            take = take - np.where(slot == b["slots"].to_numpy() - 1, b["cut"].to_numpy(np.int64), 0)
            yield pd.DataFrame(
                {"src": src, "shard": b["shard"], "slot": slot, "turn": turn, "block": at, "take": take}
            )

    named = "src long, shard long, slot long, turn long, block long, take long"
    slots = in_pandas(slots.select("src", "shard", "slot", "source_size", "blocks", "slots", "cut"), placed, named)
    pieces = (
        documents.where("size > 0")
        .select("src", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
        .withColumn("low", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
        .withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    )
    # Both sides grow with the corpus; the slots' estimated size is that of the shard table.
    parts = (
        pieces.hint("merge").join(slots, ["src", "block"])
        .withColumn("high", F.least("high", "take"))
        .where("high > low")
        .withColumn("base", F.col("block") * block - F.col("start"))
        .select("src", "start", "turn", "shard", "slot", (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"))
    )
    return Mixed(documents, slots, parts)


def taken_words(docs: DataFrame, mixture: Mixture | None = None, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, taken, shards, first_shard.

    The last two are the number of output shards that take words of it, and the first of them
    (null if none does). Every row is a document of its own, repeated ones and those without an
    id too; null texts have no words. An empty table gives no rows.
    """
    mixed = mix(settled(word_sizes(docs, id_col, text_col, source_col)), mixture or Mixture())
    # A few parts a document and shard; summed by both first, no set is gathered.
    words = F.sum(F.col("high") - F.col("low")).alias("taken")
    by_shard = mixed.parts.groupBy("src", "start", "shard").agg(words)
    taken = by_shard.groupBy("src", "start").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("shards"), F.min("shard").alias("first_shard"))
    names = ["doc_id", "source", "size", "source_size", "target"]
    zero = F.lit(0).cast("long")
    full = mixed.documents.where("size > 0").join(taken, ["src", "start"], "left")
    full = full.select(*names, *[F.coalesce(c, zero).alias(c) for c in ("taken", "shards")], "first_shard")
    none = mixed.documents.where("size = 0").select(*names, zero.alias("taken"), zero.alias("shards"), F.lit(None).cast("long").alias("first_shard"))
    return full.unionByName(none)


def mixed_blocks(mixed: Mixed, mixture: Mixture) -> DataFrame:
    """The mix as written out: (shard, place, src, turn, block, take, pieces).

    ``place`` is gapless from 0 in a shard, in an order that mixes the sources; ``pieces`` are
    the runs of words that fill the block: (start of the document in its source, low, high).
    """
    pieces = mixed.parts.groupBy("src", "shard", "slot").agg(F.sort_array(F.collect_list(F.struct("start", "low", "high"))).alias("pieces"))
    blocks = mixed.slots.where("take > 0").join(pieces, ["src", "shard", "slot"])
    mixing = blocks.withColumn("_order", F.xxhash64("src", "slot", F.lit(mixture.seed)))
    return ranked(mixing, ["shard"], ["_order", "src", "slot"], "place").drop("_order", "slot")


def _ties(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """``rows`` (``names`` and the keys ``by``) with ``_shoal_tie``: their places in their keys, from 0.

    Rows alike in all columns are one with a count until they have their places, so that they
    can be dealt out by them, however many they are.
    """
    alike = rows.withColumn("_alike", row_hash(rows, names)).groupBy(*by, "_alike")
    alike = settled(alike.agg(F.first(F.struct(*names)).alias("_row"), F.count(F.lit(1)).alias("_rows")))
    placed = running_start(alike, by, ["_alike"], "_rows", "_first")
    return placed.select("_row.*", *by, F.explode(F.expr("sequence(_first, _first + _rows - 1)")).alias("_shoal_tie"))


def mixed_documents(docs: DataFrame, mixture: Mixture | None = None, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    Each pass in which the mix takes words of a document gives one row whose text is those
    words, from the first taken to the last of each run, with the white space between them;
    a document taken whole keeps its text byte for byte. Each row is a document of its own;
    of rows alike in id, source and text each has a number, by which it finds its own place
    in the plan. ``n_chars``, where there is such a column, is counted anew.
    """
    names = docs.columns
    mixed = mix(settled(word_sizes(docs, id_col, text_col, source_col)), mixture or Mixture())
    spans = mixed.parts.groupBy("src", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_shoal_spans"))
    by = ["_shoal_id", "_shoal_source", "_shoal_hash"]
    keys = mixed.documents.where("size > 0").select(
        F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias(by[0]),
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")).alias(by[1]),
        F.col("text_hash").alias(by[2]),
        "src",
        "start",
    )
    keyed = docs.withColumns(
        {
            "_shoal_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")),
            "_shoal_source": F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))),
            "_shoal_hash": text_key(F.col(text_col)),
        }
    )
    again = settled(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*by))
    if not again.isEmpty():
        plan = ranked(keys.join(again, by, "left_semi"), by, ["start"], "_shoal_tie")
        keys = keys.join(again, by, "left_anti").withColumn("_shoal_tie", F.lit(0).cast("long")).unionByName(plan)
        alone = keyed.join(again, by, "left_anti").withColumn("_shoal_tie", F.lit(0).cast("long"))
        keyed = alone.unionByName(_ties(keyed.join(again, by, "left_semi"), names, by))
        by = [*by, "_shoal_tie"]
    taken = keys.join(spans, ["src", "start"]).select(*by, "_shoal_spans")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.blocks(batches, at):
            data, offsets = vectext.utf8(batch.column(at))
            starts, ends, bounds = vectext.word_spans(data, offsets)
            texts = []
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["low"]:
                        runs[-1][1] = s["high"]
                    else:
                        runs.append([s["low"], s["high"]])
                a, z = bounds[i], bounds[i + 1]
                if runs == [[0, z - a]]:
                    texts.append(batch.column(at)[i].as_py())
                else:
                    texts.append(" ".join(data[starts[a + x] : ends[a + y - 1]].tobytes().decode() for x, y in runs))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = keyed.join(taken, by).select(*names, "_shoal_spans")
    out = in_arrow(joined, run, docs.schema)
    if "n_chars" in names and text_col != "n_chars":
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
