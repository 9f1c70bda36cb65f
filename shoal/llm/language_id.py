"""Language identification by Bayesian fusion of independent evidence.

The posterior of a language is, in logs: the text's likelihood under hashed character
n-grams (tempered, since neighbouring n-grams are not independent), the likelihoods of the
declared markup language and of the address suffix, and the prior of the host, which is
smoothed towards its domain's and that towards all records'. Likelihoods and priors are soft
counts of the text-only posteriors, summed by grouped aggregation; each record's own count
is taken out of its host's and domain's, lest it vouch for itself. Soft counts are whole
numbers of UNITs, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.chartext import Characters, text_blocks
from shoal.llm.spread import in_arrow, settled

UNDETERMINED = "und"
#: What soft counts are whole multiples of.
UNIT = 2.0**-24


@dataclass(frozen=True)
class LanguageTraining:
    """``rows`` bounds the labelled sample (the rows with the least hash of their id), and so the
    number of languages; ``languages`` keeps the most frequent of them only, if given."""

    rows: int = 20_000
    languages: int | None = None
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    smoothing: float = 0.5


@dataclass(frozen=True)
class Fusion:
    """``effective``: n-grams at most that a text counts for; ``host``/``tag``: smoothing weights."""

    effective: float = 60.0
    host: float = 5.0
    tag: float = 5.0
    least: float = 0.5


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    sizes: tuple[int, ...]
    bits: int
    table: np.ndarray  # 2^bits x languages: log probabilities


def fit(docs: DataFrame, how: LanguageTraining | None = None, id_col="doc_id", text_col="text", label_col="lang") -> LanguageModel:
    """Counts n-grams of a bounded sample of rows with a label; every label found is a language.

    Null ids and labels are left out; null texts are empty; rows that repeat an id and a label
    count each. Without labelled rows, as in an empty table, there are no languages, and every
    record is undetermined.
    """
    how = how or LanguageTraining()
    ids = docs.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("string").alias("lang")).dropna()
    chosen = ids.orderBy(F.xxhash64("k", F.lit(23)), "k", "lang").limit(how.rows)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # At most ``rows`` rows of an id and a label.
    sample = texts.join(F.broadcast(chosen.distinct()), ["k", "lang"]).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in text_blocks(batch, 0):
                c = Characters(b.column(0).to_pylist(), letters_only=True)
                langs = np.array(b.column(1).to_pylist(), object)
                for n in how.sizes:
                    h, inside = c.grams(n, how.bits)
                    for lang in set(langs.tolist()):
                        mine = inside & (langs == lang)[c.row[: len(h)]]
                        totals.setdefault(lang, np.zeros(1 << how.bits, np.int64))
                        totals[lang] += np.bincount(h[mine], minlength=1 << how.bits)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    sums = in_arrow(sample, counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages x 2^bits rows.
    found = sums.toPandas()
    by = found.groupby("lang")["n"].sum().sort_values(ascending=False)
    languages = tuple(sorted(by.index[: how.languages]))
    table = np.full((1 << how.bits, len(languages)), how.smoothing)
    for i, lang in enumerate(languages):
        part = found[found["lang"] == lang]
        table[part["bucket"], i] += part["n"]
    table = np.log(table / table.sum(axis=0)) if languages else table
    return LanguageModel(languages, how.sizes, how.bits, table.astype(np.float32))


def text_evidence(records: DataFrame, model: LanguageModel, fusion: Fusion, text_col: str = "text") -> DataFrame:
    """Replaces the text by ``evidence`` (a log likelihood for each language), ``soft`` (the
    posterior from it alone in UNITs; zeros without letters) and ``letters``."""
    shared = records.sparkSession.sparkContext.broadcast(model.table)
    sizes, bits, count = model.sizes, model.bits, len(model.languages)
    rest = [c for c in records.columns if c != text_col]
    place = records.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for b in text_blocks(batch, place):
                c = Characters(b.column(place).to_pylist(), letters_only=True)
                total, grams = np.zeros((b.num_rows, count)), np.zeros(b.num_rows)
                for n in sizes:
                    h, inside = c.grams(n, bits)
                    at = np.flatnonzero(inside)
                    grams += np.bincount(c.row[at], minlength=b.num_rows)
                    for i in range(count):
                        total[:, i] += np.bincount(c.row[at], table[h[at], i], b.num_rows)
                scale = np.minimum(1.0, fusion.effective / np.maximum(grams, 1)) * (c.letters > 0)
                total = (total - total.max(axis=1, keepdims=True, initial=-np.inf)) * scale[:, None] if count else total
                soft = _normal(total) * (c.letters > 0)[:, None]
                others = [b.column(i) for i in range(b.num_columns) if i != place]
                arrays = [*others, _lists(total), _lists(np.rint(soft / UNIT).astype(np.int64)), pa.array(c.letters.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "evidence", "soft", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != text_col)
    return in_arrow(records, run, f"{schema}, evidence array<double>, soft array<long>, letters long")


def _lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))


def _normal(logs: np.ndarray) -> np.ndarray:
    parts = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf))
    return parts / parts.sum(axis=1, keepdims=True)


def fuse(evidence, soft, host, domain, declared, suffix, total, fusion: Fusion) -> np.ndarray:
    """Posteriors (records x languages) from log likelihoods, own soft counts and group sums.

    ``host`` to ``suffix`` are the groups' sums, own counts included, or NaN where a record
    has no such field; ``total`` is the sum over all records.
    """
    n = evidence.shape[1]
    prior = np.broadcast_to((total + 1.0) / (total.sum() + n), evidence.shape)
    for group in (domain, host):
        others = np.maximum(np.where(np.isnan(group), 0.0, group - soft), 0.0)
        prior = (others + fusion.host * prior) / (others.sum(axis=1, keepdims=True) + fusion.host)
    logs = evidence + np.log(prior)
    for group in (declared, suffix):
        others = np.maximum(np.where(np.isnan(group), 0.0, group - soft), 0.0)
        share = (others.sum(axis=1, keepdims=True) + 1.0) / (total.sum() + 2.0)
        told = np.log((others + fusion.tag * share) / (np.maximum(total - soft, 0.0) + fusion.tag))
        logs = logs + np.where(np.isnan(group), 0.0, told)
    return _normal(logs)


def fused(records: DataFrame, model: LanguageModel, fusion: Fusion | None = None) -> DataFrame:
    """(id, text, declared, suffix, host, domain) to the id, lang, probability, text_lang, accepted and the evidence's fields.

    Null fields give no evidence; so do texts without letters. ``lang`` is ``und`` and the
    record not accepted if no language reaches ``least`` or the text has no letters. Rows are
    kept as they come, repeated ones too (each counts).
    """
    fusion = fusion or Fusion()
    n = len(model.languages)
    fields = ["id", "declared", "suffix", "host", "domain"]
    if not n:
        none = [F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("probability"), F.lit(UNDETERMINED).alias("text_lang"), F.lit(False).alias("accepted")]
        return records.select("id", *none, *fields[1:])
    read = settled(text_evidence(records.select(*fields, "text"), model, fusion))

    def sums(key: str | None) -> DataFrame:
        some = read.where(F.col(key).isNotNull()).groupBy(key) if key else read.groupBy()
        return some.agg(F.array(*[F.coalesce(F.sum(F.col("soft")[i]), F.lit(0)) for i in range(n)]).alias(f"{key}_sum"))

    total = np.array(sums(None).first()[0]) * UNIT
    rows = read
    for key in ("host", "domain", "declared", "suffix"):
        # A record without the field looks for a key of its own, which no group has.
        alone = F.concat(F.lit(" "), F.hash("id", "evidence").cast("string"))
        # Sums are computed by themselves, so that the join can be split where a group is large.
        found = settled(sums(key).withColumnRenamed(key, "_group"))
        rows = rows.join(found, F.coalesce(F.col(key), alone) == F.col("_group"), "left").drop("_group")
    groups = [f"{key}_sum" for key in ("host", "domain", "declared", "suffix")]
    languages = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            letters = b.column(len(fields)).to_numpy()
            evidence, soft, *given = (_rows(c, n) for c in b.columns[len(fields) + 1 :])
            soft = soft * UNIT
            final = fuse(evidence, soft, *(x * UNIT for x in given), total, fusion)
            top = final.max(axis=1)
            ok = (letters > 0) & (top >= fusion.least)
            lang = languages[np.where(ok, final.argmax(axis=1), n)]
            read = languages[np.where(letters > 0, soft.argmax(axis=1), n)]
            added = [pa.array(lang, pa.string()), pa.array(top), pa.array(read, pa.string()), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([b.column(0), *added, *b.columns[1 : len(fields)]], names=names)

    names = ["id", "lang", "probability", "text_lang", "accepted", *fields[1:]]
    kind = records.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang string, probability double, text_lang string, accepted boolean, "
    schema += "declared string, suffix string, host string, domain string"
    return in_arrow(rows.select(*fields, "letters", "evidence", "soft", *groups), run, schema)


def _rows(lists: pa.Array, n: int) -> np.ndarray:
    """A list column of ``n`` numbers a row as a matrix, NaN where a list is null."""
    out = np.full((len(lists), n), np.nan)
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    out[there] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")


def page_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Web pages to records: visible text, the markup's language, the host's suffix, host and domain.

    A null page is an empty text; what a null or odd address or page doesn't tell is null. Pages
    are read whole; repeated rows stay. An empty table gives no rows.
    """

    def visible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch, 5):
                texts = [html.unescape(_HIDDEN.sub(" ", t or "")) for t in b.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(texts, pa.string())], names=names)

    names = ["id", "declared", "suffix", "host", "domain", "text"]
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    blank = lambda c: F.when(c != "", c)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        blank(declared).alias("declared"),
        blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
        blank(host).alias("host"),
        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        F.col(html_col).cast("string").alias("text"),
    )
    return in_arrow(rows, visible, "id long, declared string, suffix string, host string, domain string, text string")


def document_records(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Documents to records: the source stands for the host; there is no markup and no address."""
    none = F.lit(None).cast("string")
    source = F.col(source_col).cast("string").alias("host")
    return docs.select(F.col(id_col).alias("id"), none.alias("declared"), none.alias("suffix"), source, none.alias("domain"), F.col(text_col).cast("string").alias("text"))
