"""Best-fit packing of token documents into fixed-length sequences, planned on lengths.

The plan works on counts, not documents: the pieces' length histogram has at most
``seq_len`` rows whatever the corpus, best-fit-decreasing runs over it on the driver, and
gives at most a few slots' runs for each length. Documents take the planned slots by joining
on their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.byte_bpe import byte_bpe
from shoal.llm.spread import in_arrow, ranked, settled

SEQ_LEN = 2048
END_ID = 0


def cut_lengths(total: int, seq_len: int) -> list[int]:
    """Lengths of the pieces of a document: the short one first, the rest whole sequences."""
    if total <= seq_len:
        return [total]
    first = total % seq_len
    return [first] * (first > 0) + [seq_len] * (total // seq_len)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the ids if asked for.

    A null text is an empty one: a single piece, the end id. Every row is a document of its
    own, also when rows repeat; a null id stays null.
    """
    end = int(end_id).to_bytes(4, "little")

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            held = 0
            for i, doc in enumerate(ids):
                tokens = bpe.encode(batch.column(1)[i].as_py() or "") + end
                start = 0
                for piece, n in enumerate(cut_lengths(len(tokens) // 4, seq_len)):
                    part = tokens[4 * start : 4 * (start + n)]
                    out.append((doc, piece, start, n, zlib.crc32(part), part if with_ids else None))
                    start += n
                    held += len(part) if with_ids else 64
                if held > 8_000_000:
                    yield packed(out)
                    out, held = [], 0
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(texts, tokenized, schema)


def plan_slots(histogram: dict[int, int], seq_len: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit-decreasing over counts.

    Returns runs (length, first rank, end rank, first sequence, items a sequence, offset) and
    the number of sequences. Pieces of one length are alike, so best fit fills the tightest
    sequence that takes the length with as many of them as fit, then goes on to the next;
    sequences with equal room are handled together. Each length adds at most a few runs.
    """
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, how many)
    rooms: list[int] = []  # sorted keys of the above
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= seq_len:
            raise ValueError(f"a piece of {length} tokens doesn't fit into sequences of {seq_len}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            else:
                room, first = seq_len, sequences
                count = -(-left // (seq_len // length))
                sequences += count
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, seq_len - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                runs.append((length, rank, rank + left, first + full, left, seq_len - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    return runs, sequences


def best_fit(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    ``pieces`` is read twice: for the histogram and for the places. The histogram (at most
    ``seq_len`` rows) is collected; the plan, a few runs for each of those lengths, is
    broadcast: both are bounded by ``seq_len`` alone.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_slots(counts, seq_len)
    schema = "length long, first_rank long, end_rank long, first_sequence long, each long, used long"
    plan = spark.createDataFrame(runs, schema)
    places = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", sum(counts.values()))
    held = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    nth = F.col("rank") - F.col("first_rank")
    return (
        places.join(F.broadcast(plan), "length")
        .where(held)
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div each"))
        .withColumn("offset", F.col("used") + F.pmod(nth, F.col("each")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Documents (doc_id, text) to packed pieces.

    Tokenized once; the pieces (numbers only) are checkpointed and read for histogram and
    places. Rows with null text pack as the end id alone; an empty table gives no rows.
    """
    return best_fit(settled(token_pieces(docs, tokenizer_path, seq_len=seq_len, end_id=end_id)), seq_len)
