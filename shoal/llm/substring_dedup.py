"""Substring deduplication by level-wise doubling of repeated windows.

Only windows whose half-length windows repeat can repeat themselves, so lengths double:
windows of ``base`` words that occur twice are extended to 2 * base, those that occur twice
to 4 * base, and so on to ``window`` words or until no candidate survives. The first level
needs no window at every word: each full window is represented by the least-hashed base
window inside it (equal windows pick the same one), about two in every ``window - base + 2``
words.

Each level is one exchange of (hash, document, position) rows. A task first settles by itself
what repeats among its own documents and sends two rows at most for each window that it
remembers (in the last level, only places earlier than those sent before), so a passage that
a third of all documents holds costs some rows a task. Levels before the last compare 64-bit
hashes and only choose candidates; the last, which decides, compares 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm import vectext
from shoal.llm.spread import in_arrow, key_order, numbered, one_of_each, settled, sweep, text_key

LAST = 2**63 - 1
#: Windows that a task remembers having sent.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class RepeatWindows:
    """Windows of ``window`` words; levels start at ``base`` words, window / base a power of two."""

    window: int = 20
    base: int = 10

    def __post_init__(self):
        levels = self.window // self.base if self.base > 0 else 0
        if levels < 2 or self.window % self.base or levels & (levels - 1):
            raise ValueError("window must be base times a power of two, at least twice")

    @property
    def lengths(self) -> list[int]:
        """The lengths after the base."""
        out, n = [], 2 * self.base
        while n <= self.window:
            out.append(n)
            n *= 2
        return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in each run of ``width`` values."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        if not len(a):
            return at[:0]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


class _Block:
    """Words and window hashes of one block of texts (rows of k, text)."""

    def __init__(self, batch: pa.RecordBatch, how: RepeatWindows):
        self.how = how
        self.k = batch.column(0).to_numpy()
        data, self.offsets = vectext.utf8(batch.column(1))
        starts, ends, self.bounds = vectext.word_spans(data, self.offsets)
        self.total = len(starts)
        self._words = data, starts, ends
        self.row = np.repeat(np.arange(len(self.k)), np.diff(self.bounds))
        self.start = self.bounds[:-1][self.row]
        left = self.bounds[1:][self.row] - np.arange(self.total)
        self.windows = np.flatnonzero(left >= how.window)

    def hashes(self, table: int = 0) -> vectext.RunHash:
        return vectext.RunHash(vectext.word_hashes(*self._words, table))

    def anchors(self, hashes: vectext.RunHash) -> np.ndarray:
        """The base window that stands for each full window, by first word."""
        n = max(0, self.total - self.how.base + 1)
        first = np.arange(n)
        at = sliding_argmin(hashes.runs(first, first + self.how.base), self.how.window - self.how.base + 1)
        return at[self.windows] if len(self.windows) else self.windows

    def places(self, words: np.ndarray) -> np.ndarray:
        """Positions inside their documents."""
        return (words - self.start[words]).astype(np.int32)

    def marked(self, flags: pa.Array) -> np.ndarray:
        """A mask of words from each row's list of blobs of positions."""
        mask = np.zeros(self.total + 1, bool)
        for i in range(len(self.k)):
            if flags[i].is_valid:
                for blob in flags[i].as_py():
                    at = np.frombuffer(blob, np.int32)
                    at = at[at < self.bounds[i + 1] - self.bounds[i]]
                    mask[self.bounds[i] + at] = True
        return mask[:-1]


#: A row to compare has a window's hash h, x (more of its hash above 32 bits of position) and the
#: document k; one of known positions has them in found instead, and a hash of k.
_NAMES = ["h", "x", "k", "found"]
_ROWS = "h long, x long, k long, found binary"
_LOW = np.uint64(0xFFFFFFFF)


def _blobs(k: np.ndarray, pos: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(k, blob of positions) of k-grouped input."""
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    ends = pa.py_buffer((np.append(cut, len(k)) * 4).astype(np.int32))
    found = pa.Array.from_buffers(pa.binary(), len(cut), [None, ends, pa.py_buffer(pos.astype(np.int32).tobytes())])
    return pa.array(k[cut]), found


def _half(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


class _Sender:
    """What a task knows of its windows by itself, and the rows to compare with other tasks'.

    It remembers windows sent before in a table with one place for each hash's low bits; a
    window that falls out of it is merely sent again. A place that is not sent is known to
    repeat: two others of its window were sent (in the last level, an earlier one).
    """

    def __init__(self, last: bool, remembered: int = REMEMBERED):
        self.last, self.mask = last, np.uint64(remembered - 1)
        self.h, self.g = np.zeros(remembered, np.uint64), np.zeros(remembered, np.uint32)
        self.sent = np.zeros(remembered, np.int8)
        self.k, self.pos = np.zeros(remembered, np.int64), np.zeros(remembered, np.int32)

    def rows(self, h: np.ndarray, g: np.ndarray, k: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows to send, and rows of known positions. The places of a document come together, in order."""
        order = _by_window(h, g, k, pos)
        h, g, k, pos = h[order], g[order], k[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.append(first, len(h)))
        at = (h[first] & self.mask).astype(np.int64)
        met = (self.sent[at] > 0) & (self.h[at] == h[first]) & (self.g[at] == g[first])
        if self.last:
            later = met & ((k[first] > self.k[at]) | ((k[first] == self.k[at]) & (pos[first] > self.pos[at])))
            send = new & ~later[group]
            fresh = ~later
            count = np.ones(len(first), np.int8)
        else:
            before = np.where(met, self.sent[at], 0)
            send = np.arange(len(h)) - first[group] < (2 - before)[group]
            fresh = np.ones(len(first), bool)
            count = np.minimum(2, before + size).astype(np.int8)
        put, one = at[fresh], first[fresh]
        self.h[put], self.g[put], self.sent[put], self.k[put], self.pos[put] = h[one], g[one], count[fresh], k[one], pos[one]
        more = g[send].astype(np.uint64) << np.uint64(32) if self.last else np.uint64(0)
        yield _packed(h[send], more | pos[send].astype(np.uint64), k[send], None)
        # In the order given, so that a document's places are together.
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        kept = back[~send[back]]
        key, found = _blobs(k[kept], pos[kept])
        key = key.to_numpy()
        yield _packed(vectext.mixed(key.view(np.uint64)), np.zeros(len(key), np.uint64), key, found)


def _by_window(h: np.ndarray, g: np.ndarray, k: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The order by (h, g, k, pos)."""
    if (k[1:] >= k[:-1]).all():
        order = np.argsort(h, kind="stable")
        one, other = order[1:], order[:-1]
        if not ((h[one] == h[other]) & (g[one] != g[other])).any():
            return order
    return np.lexsort((pos, k, g, h))


def _packed(h: np.ndarray, x: np.ndarray, k: np.ndarray, found: pa.Array | None) -> pa.RecordBatch:
    found = pa.nulls(len(h), pa.binary()) if found is None else found
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), pa.array(k), found], names=_NAMES)


def _first_level(how: RepeatWindows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(False)
        for batch in vectext.blocks(batches, 1):
            b = _Block(batch, how)
            hashes = b.hashes()
            at = np.unique(b.anchors(hashes))
            h = hashes.runs(at, at + how.base)
            yield from sender.rows(h, _half(h), b.k[b.row[at]], b.places(at))

    return run


def _next_level(how: RepeatWindows, length: int):
    """Windows of ``length`` words whose halves survived; the first time, those whose anchor did."""
    last = length == how.window

    def candidates(b: _Block, hashes: vectext.RunHash, alive: np.ndarray) -> np.ndarray:
        if length > 2 * how.base:
            at = np.arange(max(0, b.total - length // 2))
            at = at[alive[at] & alive[at + length // 2]]
            return at[b.bounds[1:][b.row[at]] - at >= length]
        hit = b.windows[alive[b.anchors(hashes)]]
        if last:
            return hit
        near = np.zeros(b.total + 1, np.int64)
        np.add.at(near, hit, 1)
        np.add.at(near, np.minimum(hit + how.window - length + 1, b.total), -1)
        return np.flatnonzero(np.cumsum(near[:-1]) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(last)
        for batch in vectext.blocks(batches, 1):
            b = _Block(batch, how)
            hashes = b.hashes()
            at = candidates(b, hashes, b.marked(batch.column(2)))
            h = hashes.runs(at, at + length)
            g = b.hashes(1).runs(at, at + length) if last and len(at) else h
            yield from sender.rows(h, _half(g), b.k[b.row[at]], b.places(at))

    return run


def _compared(last: bool):
    """Sorted rows of a level to (k, found): places whose hash repeats (last: that come later)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last hash so far that may still turn out to repeat
        first = None  # the last hash and its first place
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(3).is_valid()
            whole = batch.filter(known)
            if whole.num_rows:
                yield pa.RecordBatch.from_arrays([whole.column(2), whole.column(3)], names=["k", "found"])
            part = ~known.to_numpy(zero_copy_only=False)
            h, x, k = (batch.column(i).to_numpy()[part] for i in range(3))
            x = x.view(np.uint64)
            g, pos = x >> np.uint64(32), (x & _LOW).astype(np.int32)
            if last:
                if not len(h):
                    continue
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                at = np.flatnonzero(new)[np.cumsum(new) - 1]
                fk, fp = k[at], pos[at]
                if first is not None and first[:2] == (h[0], g[0]):
                    same = (h == h[0]) & (g == g[0])
                    fk[same], fp[same] = first[2], first[3]
                first = h[-1], g[-1], fk[-1], fp[-1]
                hit = (k != fk) | (pos != fp)
                k, pos = k[hit], pos[hit]
            else:
                if held is not None:
                    h, k, pos = (np.concatenate(x) for x in zip(held, (h, k, pos), strict=True))
                if not len(h):
                    continue
                same = h[1:] == h[:-1]
                hit = np.zeros(len(h), bool)
                hit[1:] |= same
                hit[:-1] |= same
                held = h[-1:], k[-1:], pos[-1:]
                k, pos = k[hit], pos[hit]
            order = np.lexsort((pos, k))
            yield pa.RecordBatch.from_arrays(list(_blobs(k[order], pos[order])), names=["k", "found"])

    return run


def _by_document(rows: DataFrame, last: bool) -> DataFrame:
    """A level's outcome as (k, found): a list of position blobs for each document."""
    dealt = rows.repartition("h").sortWithinPartitions("h", F.shiftrightunsigned("x", 32), "k", "x")
    found = in_arrow(dealt, _compared(last), "k long, found binary")
    return found.groupBy("k").agg(F.collect_list("found").alias("found"))


def repeated_windows(texts: DataFrame, how: RepeatWindows) -> DataFrame:
    """(k, found) for (k, text), k unique: the first words of windows that also start earlier.

    The levels end where nothing repeats any more.
    """
    found = settled(_by_document(in_arrow(texts, _first_level(how), _ROWS), False))
    for length in how.lengths:
        # The exchange of the level before is done with.
        sweep(texts.sparkSession)
        if found.isEmpty():
            break
        last = length == how.window
        alive = texts.join(found, "k").select("k", "text", "found")
        found = _by_document(in_arrow(alive, _next_level(how, length), _ROWS), last)
        found = found if last else settled(found)
    return found


def _covered(b: _Block, found: pa.Array, window: int) -> np.ndarray:
    """Words under the windows found; a window doesn't reach beyond its document."""
    steps = np.zeros(b.total + window + 1, np.int64)
    at = np.flatnonzero(b.marked(found))
    steps[at] += 1
    end = np.minimum(at + window, b.bounds[1:][b.row[at]]) if len(at) else at
    np.add.at(steps, end, -1)
    return np.cumsum(steps)[: b.total] > 0


def _cutter(b: _Block, gone: np.ndarray):
    """A function that gives row i's text without the words ``gone`` and the white space after each."""
    data, starts, _ = b._words
    at = np.flatnonzero(gone)
    upto = np.append(starts[1:], len(data))[at]
    edges = np.zeros(len(data) + 1, np.int32)
    edges[starts[at]] += 1
    edges[np.minimum(upto, b.offsets[b.row[at] + 1])] -= 1
    keep = np.cumsum(edges)[:-1] == 0

    def text(i: int) -> str:
        mine = slice(b.offsets[i], b.offsets[i + 1])
        return data[mine][keep[mine]].tobytes().decode()

    return text


def deduplicated(
    docs: DataFrame, how: RepeatWindows | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text (if asked for).

    A word goes if any window over it starts earlier too (smaller doc_id, or same document
    and earlier start), judged on the input. ``kept_text`` is the text without those words
    and the white space after each, untouched if none goes; ``kept_sha256`` is of the kept
    words joined by one space. A null text has no words (``kept_text`` stays null).

    Every row is a document of its own. A null doc_id counts as larger than any other; rows
    that share one come in the order of their texts' hashes, and of rows alike in both any is
    the first, so that the others lose all their words, if they have a window at all. An empty
    table gives no rows.
    """
    how = how or RepeatWindows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.blocks(batches, 1):
            b = _Block(batch, how)
            gone = _covered(b, batch.column(2), how.window)
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[b.bounds[1:]] - sums[b.bounds[:-1]]
            cut = _cutter(b, gone) if with_text else lambda i: None
            digests, kept = [], []
            for i, lost in enumerate(removed.tolist()):
                text = batch.column(1)[i].as_py()
                raw = (text or "").encode()
                words = raw.split()
                if lost:
                    stay = ~gone[b.bounds[i] : b.bounds[i + 1]]
                    words = list(compress(words, stay.tolist()))
                    text = cut(i)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                kept.append(text)
            arrays = [batch.column(0), pa.array(np.diff(b.bounds)), pa.array(removed), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.string())][: 1 + len(names)], names=["k", *names])

    names = ["n_words", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by, again = _told_apart(rows, "doc_id", "text")
    if again is not None:
        one = rows.withColumns(by).join(again.drop("rows"), list(by), "left_semi").dropDuplicates(list(by))
        rows = rows.withColumns(by).join(again, list(by), "left_anti").unionByName(one).select("doc_id", "text")
    keyed = _numbered(rows.withColumns(by), by, "k")
    texts = keyed.select("k", "text")
    joined = texts.join(repeated_windows(texts, how), "k", "left").select("k", "text", "found")
    out = in_arrow(joined, run, "k long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    if len(by) == 1:
        # The number is the id, but for a null one.
        null = F.col("k") == (F.lit(LAST) if rows.where("doc_id is null").limit(1).count() else F.lit(None))
        return out.select(F.when(~F.coalesce(null, F.lit(False)), F.col("k")).alias("doc_id"), *names)
    named = keyed.select("k", "doc_id", *([text_key(F.col("text")).alias("_shoal_h")] if again is not None else []))
    if again is None:
        return out.join(named, "k").select("doc_id", *names)
    same = named["doc_id"].eqNullSafe(F.when(~F.col("_shoal_absent"), F.col("_shoal_k"))) & (named["_shoal_h"] == again["_shoal_h"])
    copies = named.join(again, same, "left").select("k", "doc_id", F.coalesce("rows", F.lit(1).cast("long")).alias("rows"))
    out = out.join(copies, "k").withColumn("_copy", F.explode(F.expr("sequence(1L, rows)")))
    whole = (F.col("_copy") > 1) & (F.col("n_words") >= how.window)
    none = {"n_removed": F.col("n_words"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept_text": F.lit("")}
    return out.select("doc_id", "n_words", *[F.when(whole, none[n]).otherwise(F.col(n)).alias(n) for n in names[1:]])


def _told_apart(rows: DataFrame, id_col: str, text_col: str) -> tuple[dict, DataFrame | None]:
    """Columns that tell rows apart, in the order of documents: by id, then by the text's hash.

    One number if no two rows share an id. Also those of rows alike in id and text, with how
    many they are ("rows"), if there are any.
    """
    absent, order = key_order(id_col)
    by = {"_shoal_absent": absent, "_shoal_k": order, "_shoal_h": text_key(F.col(text_col))}
    texts = rows.select(*[c.alias(n) for n, c in by.items()]).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    shared = texts.groupBy(*list(by)[:2]).agg(F.count(F.lit(1)).alias("texts"), F.max("rows").alias("rows"))
    texts_of_id, alike, null, largest = shared.agg(F.max("texts"), F.max("rows"), F.max("_shoal_absent"), F.max("_shoal_k")).first()
    if (texts_of_id or 0) <= 1 and (alike or 0) <= 1 and not (null and largest == LAST):
        return {"_shoal_k": F.when(absent, F.lit(LAST).cast("long")).otherwise(order)}, None
    return by, settled(texts.where("rows > 1")) if alike > 1 else None


def _numbered(rows: DataFrame, by: dict, name: str) -> DataFrame:
    """``rows`` with ``name``, a number for each value of the columns ``by``, in their order."""
    if len(by) == 1:
        return rows.withColumnsRenamed(dict.fromkeys(by, name))
    number = settled(numbered(rows, list(by), "_shoal_n"))
    return rows.join(number, list(by)).drop(*by).withColumnRenamed("_shoal_n", name)


def without_repeats(docs: DataFrame, how: RepeatWindows | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of its texts, all other columns as they are.

    Untouched texts stay byte for byte. A document that loses all its words goes; one that
    had none stays. ``n_chars``, where there is such a column, is counted anew.

    Every row is a document of its own. Earlier is what has the smaller id (null is the
    largest); rows that share one come in the order of their texts' hashes, and of rows alike
    in both any is the first, so that the others lose all, if they have a window at all.
    """
    how = how or RepeatWindows()
    names = docs.columns
    by, again = _told_apart(docs, id_col, text_col)
    keyed = docs.withColumns(by)
    if again is not None:
        # Those too short for a window stay.
        words = F.size(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
        long = settled(keyed.join(again.drop("rows"), list(by), "left_semi").where(words >= how.window).select(*by).distinct())
        keyed = one_of_each(keyed, long, list(by))
    keyed = _numbered(keyed, by, "_shoal_k")
    texts = keyed.select(F.col("_shoal_k").alias("k"), F.col(text_col).cast("string").alias("text"))
    found = repeated_windows(texts, how).withColumnsRenamed({"k": "_shoal_k", "found": "_shoal_found"})
    joined = keyed.join(found, "_shoal_k", "left")
    columns = [*names, "_shoal_found"]
    at, flags = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectext.blocks(batches, at):
            texts = batch.column(at)
            k = pa.array(np.zeros(batch.num_rows, np.int64))
            b = _Block(pa.RecordBatch.from_arrays([k, texts], names=["k", "text"]), how)
            gone = _covered(b, batch.column(flags), how.window)
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed, n = sums[b.bounds[1:]] - sums[b.bounds[:-1]], np.diff(b.bounds)
            cut = _cutter(b, gone)
            kept = [cut(i) if lost else texts[i].as_py() for i, lost in enumerate(removed.tolist())]
            columns = list(batch.columns[:flags])
            columns[at] = pa.array(kept, pa.string())
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out.filter(pa.array((removed == 0) | (removed < n)))

    out = in_arrow(joined.select(*columns), run, docs.schema)
    if "n_chars" in names and text_col != "n_chars":
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
