"""Shards, packed sequences and the mix against SQL and slot-by-slot versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from shoal.llm import mixing, registry, sequence_packing, shard_packing, spread

WORD = re.compile("[^\x20\x09-\x0d]+")
MASK = (1 << 64) - 1


def rows(n=260, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    texts += [None, "", "x " * 3000, *[texts[3]] * 20, *[f"n{i}" for i in range(20)]]
    ids = [*range(len(texts) - 4), 5, 5, None, None]
    return [(k, t, None if i % 9 == 0 else f"s{i % 5}") for i, (k, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(4).cache()


def tables(**frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return lambda sql: con.execute(sql).fetchall()


def test_shards_by_sql(docs):
    frame = pd.DataFrame([(k if k is not None else -1, t, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, _ in rows()], columns=["doc_id", "text", "size", "crc"])
    found = shard_packing.shard_documents(docs, 6).toPandas().fillna({"doc_id": -1}).astype({"doc_id": "int64"})[["doc_id", "size", "text_crc32", "law", "shard", "slot"]]
    sql = tables(given=frame, found=found)
    same = "SELECT doc_id, size, {} FROM {}"
    a, b = same.format("crc", "given"), same.format("text_crc32", "found")
    assert sql(f"({a} EXCEPT ALL {b}) UNION ALL ({b} EXCEPT ALL {a})") == []
    assert sql("SELECT shard FROM found GROUP BY shard HAVING min(slot) <> 0 OR max(slot) <> count(*) - 1 OR count(DISTINCT slot) <> count(*)") == []
    assert sql("SELECT text_crc32 FROM found GROUP BY text_crc32 HAVING count(DISTINCT shard) > 1") == []
    # All but the shard of the one very long text are near equal.
    sizes = sorted(x for (x,) in sql("SELECT sum(size) FROM found GROUP BY shard"))
    assert len(sizes) == 6 and sizes[-2] <= 1.02 * sizes[0]


def test_sequences_by_sql(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_file())
    want = Counter()
    for k, t, _ in rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        at = 0
        for piece, n in enumerate(sequence_packing.cut_lengths(len(ids), 128)):
            want[k, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
        assert at == len(ids)
    found = sequence_packing.pack_documents(docs, registry.tokenizer_file(), seq_len=128).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sql = tables(found=pd.DataFrame([r.asDict() for r in found]))
    gaps = 'SELECT sequence_id, "offset" - coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM found'
    assert sql(f"SELECT * FROM ({gaps}) WHERE gap <> 0") == []
    assert sql("SELECT sequence_id FROM found GROUP BY sequence_id HAVING sum(length) > 128") == []
    used, least = sql("SELECT count(DISTINCT sequence_id), ceil(sum(length) / 128.0) FROM found")[0]
    assert used <= 1.03 * least + 1


def test_a_text_of_special_tokens(spark):
    text = "<|endoftext|>" * 100_000
    found = sequence_packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), registry.tokenizer_file())
    assert found.agg({"length": "sum"}).first()[0] == 100_001


def mixed_value(h):
    h ^= h >> 30
    h = (h * 0xBF58476D1CE4E5B9) & MASK
    h ^= h >> 27
    h = (h * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def place_by_hand(index, n, key):
    half = (max(1, (max(n, 2) - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = index >> half, index & mask
        for r in range(4):
            turn = mixed_value((right + mixed_value((key * 8 + r + 1) & MASK)) & MASK)
            left, right = right, left ^ (turn & mask)
        index = (left << half) | right
        if index < n:
            return index


def mix_by_hand(documents, slots, mixture):
    """Words taken of each (src, start), and of each by shard, slot by slot."""
    streams, sizes = defaultdict(dict), Counter()
    for d in documents:
        for i in range(d["size"]):
            streams[d["src"]][d["start"] + i] = d["start"]
        sizes[d["src"]] += d["size"]
    taken, by_shard = Counter(), Counter()
    for s in slots:
        n = -(-sizes[s["src"]] // mixture.block)
        turn = s["slot"] // n
        key = mixed_value(((s["src"] << 20) + turn + (mixture.seed << 44)) & MASK)
        block = place_by_hand(s["slot"] % n, n, key)
        assert (block, turn) == (s["block"], s["turn"])
        for at in range(block * mixture.block, block * mixture.block + s["take"]):
            taken[s["src"], streams[s["src"]][at]] += 1
            by_shard[s["src"], streams[s["src"]][at], s["shard"]] += 1
    return taken, by_shard


def targets_by_hand(sizes, mixture):
    """Proportional shares, the excess over each source's most dealt out again."""
    weights = [mixture.weights[i % len(mixture.weights)] for i in range(len(sizes))]
    full = set()
    while True:
        left = mixture.share * sum(sizes) - sum(mixture.most * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > mixture.most * sizes[i]}
        if not over:
            return [mixture.most * s if i in full else left * weights[i] / total for i, s in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("mixture", [mixing.Mixture(block=16, shards=5), mixing.Mixture(weights=(1.0, 9.0), share=0.3, block=32, shards=3), mixing.Mixture(block=16, share=2.0)])
def test_the_mix_slot_by_slot(docs, mixture):
    mixed = mixing.mix(spread.settled(mixing.word_sizes(docs, "doc_id", "text", "source")), mixture)
    documents, slots, parts = mixed.documents.collect(), mixed.slots.collect(), mixed.parts.collect()
    # The documents of a source fill it without gaps, and are the rows given.
    assert Counter((d["doc_id"], d["source"], d["size"]) for d in documents) == Counter((k, s, len(WORD.findall(t or ""))) for k, t, s in rows())
    for src in {d["src"] for d in documents}:
        at = 0
        for d in sorted((d for d in documents if d["src"] == src), key=lambda d: (d["start"], d["size"])):
            assert d["start"] == at
            at += d["size"]
    # Each source's slots are numbered without gaps, over shards of the same size.
    by = defaultdict(list)
    for s in slots:
        by[s["src"]].append(s["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    shards = Counter(s["shard"] for s in slots)
    assert len(shards) == mixture.shards and max(shards.values()) - min(shards.values()) <= 1
    taken, by_shard = mix_by_hand(documents, slots, mixture)
    found = Counter()
    for p in parts:
        found[p["src"], p["start"], p["shard"]] += p["high"] - p["low"]
    assert found == by_shard
    order = sorted({s for _, _, s in rows()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(t or "")) for _, t, x in rows() if x == s) for s in order]
    goals = targets_by_hand(sizes, mixture)
    for src, goal in enumerate(goals):
        assert abs(sum(n for (x, _), n in taken.items() if x == src) - goal) <= 0.5 + 1e-6
    result = mixing.taken_words(docs, mixture).collect()
    assert Counter((r["source"], r["size"], r["taken"], r["shards"], r["first_shard"]) for r in result) == Counter(
        (d["source"], d["size"], taken[d["src"], d["start"]] if d["size"] else 0, len(mine), min(mine, default=None))
        for d in documents
        for mine in [[k for (a, b, k) in by_shard if (a, b) == (d["src"], d["start"]) and d["size"]]]
    )
    for r in result:
        assert r["target"] == pytest.approx(goals[order.index(r["source"])])


def test_blocks_of_the_mix(docs):
    mixture = mixing.Mixture(block=16, shards=4)
    mixed = mixing.mix(spread.settled(mixing.word_sizes(docs, "doc_id", "text", "source")), mixture)
    blocks = mixing.mixed_blocks(mixed, mixture).collect()
    by = defaultdict(list)
    for b in blocks:
        by[b["shard"]].append(b["place"])
        assert sum(p["high"] - p["low"] for p in b["pieces"]) == b["take"] <= 16
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sum(b["take"] for b in blocks) == sum(r["taken"] for r in mixing.taken_words(docs, mixture).collect())
    # Neighbours in a shard come from several sources.
    order = [b["src"] for b in sorted(blocks, key=lambda b: (b["shard"], b["place"]))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) > len(order) / 3


def test_slices_grow_with_the_rows(spark, monkeypatch):
    assert spread.slices(10) == spread.slices(128_000_000) == 128 and spread.slices(10**10) == 10_000
    monkeypatch.setattr(spread, "SLICE_ROWS", 1)
    monkeypatch.setattr(spread, "SLICES", 1)
    df = spark.range(300).selectExpr("id % 2 AS k", "id AS v")
    found = defaultdict(list)
    for r in spread.ranked(df, ["k"], ["v"], "place").collect():
        found[r["k"]].append(r["place"])
    assert all(sorted(x) == list(range(150)) for x in found.values())
