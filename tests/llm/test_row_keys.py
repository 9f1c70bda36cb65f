"""Operators and stages of the pipeline on rows that repeat an id or have none."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from shoal.llm import mixing, substring_dedup, superminhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    return lambda n, letters="abdehinorst": " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))


def rows_of(*pairs):
    return [(k, t, "en", "s", len(t or "")) for k, t in pairs]


def after(spark, stage, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return Counter((r["doc_id"], r["text"]) for r in STAGES[stage](spark, docs, "").collect())


def test_language_id_judges_each_row(spark, words):
    good = [(k, words(20)) for k in (1, 1, 2, None, None, 3)]
    bad = [(1, "12 -- 34"), (None, "56 !!"), (None, None), (4, "7")]
    assert after(spark, "language_id", rows_of(*good, *bad)) == Counter(good)


def test_near_duplicates_judge_each_row(spark, words):
    a, b, c, d, e = (words(40) for _ in range(5))
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (2, c), (None, a), (None, d), (None, d), (None, e), (5, e), (6, "?"), (6, "")]
    want = [(1, a), (1, b), (2, c), (None, d), (5, e), (6, "?"), (6, "")]
    assert after(spark, "near_duplicates", rows_of(*rows)) == Counter(want)


def test_one_row_stays_of_near_copies_with_the_same_id(spark, words):
    a = words(60)
    found = after(spark, "near_duplicates", rows_of((1, a), (1, a + " x"), (None, a + " y"), (None, a + " z")))
    assert list(found.values()) == [1] and next(iter(found))[0] == 1


def test_passages_are_cut_row_by_row(spark, words):
    p, q = words(30), words(30)
    a, b, c, d, e, f = (words(40) for _ in range(6))
    whole, short = words(50), words(5)
    rows = [(1, a), (1, f"{b} {p}"), (2, f"{p} {c}"), (None, d), (None, f"{q} {e}"), (7, f"{f} {q}"), (3, whole), (3, whole), (4, short), (4, short)]
    want = [(1, a), (1, f"{b} {p}"), (2, c), (None, d), (None, e), (7, f"{f} {q}"), (3, whole), (4, short), (4, short)]
    assert after(spark, "substring_dedup", rows_of(*rows)) == Counter(want)


def test_a_passage_of_two_rows_with_the_same_id_stays_once(spark, words):
    for k in (1, None):
        p, a, b = words(30), words(40), words(40)
        found = after(spark, "substring_dedup", rows_of((k, f"{a} {p}"), (k, f"{b} {p}")))
        assert sorted(len(t.split()) for _, t in found) == [40, 70]


def test_the_mix_of_repeated_rows_reaches_its_targets(spark, words):
    rows = [(k, words(30), "en", f"s{k % 3}", 0) for k in range(40)]
    one, none = words(25), words(25)
    rows += [(7, one, "en" if i % 2 else "fr", "s1", i % 4) for i in range(60)] + [(None, none, "en", None, 0)] * 20
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for mixture in (mixing.Mixture(block=16), mixing.Mixture(block=16, share=0.4)):
        sizes, taken = Counter(), Counter()
        for r in rows:
            sizes[r[3]] += len(r[1].split())
        found = mixing.mixed_documents(docs, mixture).collect()
        for r in found:
            taken[r["source"]] += len(r["text"].split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        for source, target in zip(order, mixing.targets([sizes[s] for s in order], mixture), strict=True):
            assert abs(taken[source] - target) <= 0.5 + 1e-9
    whole = mixing.mixed_documents(docs, mixing.Mixture(weights=(1.0,), share=2.0)).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in whole) == Counter([r[:4] for r in rows] * 2)


LAST = 2**63 - 1


def cut_row_by_row(rows, window=20):
    """Each row's (id, words kept) by brute force; rows in the order of ids, null last."""
    seen, out = set(), []
    for k, text in rows:
        w = text.split()
        gone = set()
        for i in range(len(w) - window + 1):
            if tuple(w[i : i + window]) in seen:
                gone.update(range(i, i + window))
            seen.add(tuple(w[i : i + window]))
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


def test_rows_that_share_an_id_lose_only_their_own_words(spark, words):
    a, b, c, d, p = (words(40) for _ in range(5))
    rows = [(1, a), (7, a), (7, c), (LAST, d), (None, a), (None, b), (None, f"{p} {d}"), (None, words(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(docs).collect())
    assert found == cut_row_by_row(rows)


def test_one_null_id_is_the_last(spark, words):
    a, b = words(40), words(40)
    for rows in ([(None, a), (5, f"{a} {b}")], [(None, a), (LAST, a)]):
        found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {None: 40, rows[1][0]: 0}


def test_rows_alike_lose_all_but_one(spark, words):
    a, short = words(25), words(5)
    rows = [(3, a)] * 4 + [(3, short)] * 3 + [(None, a)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.deduplicated(docs).collect())
    assert found == Counter({(3, 25, 0, a): 1, (3, 25, 25, ""): 3, (3, 5, 0, short): 3, (None, 25, 25, ""): 2})


def test_windows_are_remembered_within_a_task(spark, words, monkeypatch):
    """Rows in one partition and blocks of one text: later blocks send nothing for a known window."""
    p = words(30)
    rows = [(i, f"{words(10)} {p}") for i in range(60)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(docs).collect())
    assert found == cut_row_by_row(sorted(rows))


def test_a_sender_sends_few_rows_of_a_window():
    import numpy as np

    for last in (False, True):
        sender, sent, known = substring_dedup._Sender(last, 8), [], []
        order = list(range(40))
        random.Random(1).shuffle(order)
        for k in order:
            h = np.array([77, 1000 + k], np.uint64)
            for b in sender.rows(h, h.astype(np.uint32), np.array([k, k]), np.array([3, 9], np.int32)):
                for row in b.to_pylist():
                    if row["found"] is not None:
                        known.append(row["k"])
                    elif row["h"] == 77:
                        sent.append(row["k"])
        assert sorted(sent + known) == list(range(40))
        # The last level sends new minima only; a slot may be taken over by another window.
        assert len(sent) < 30
        if last:
            assert 0 in sent


def test_levels_end_where_nothing_repeats(spark, words):
    docs = spark.createDataFrame([(i, words(50)) for i in range(8)], "k long, text string")
    assert substring_dedup.repeated_windows(docs, substring_dedup.RepeatWindows()).count() == 0


def test_each_component_keeps_one_row(spark, words):
    texts = [words(30) for _ in range(20)]
    rows = [(None, t) for t in texts for _ in range(2)] + [(LAST, texts[0]), (4, texts[1]), (4, texts[1]), (4, texts[2]), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = superminhash.near_duplicates(docs).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == 22
    assert Counter(r["component_id"] for r in found if r["n_shingles"]) == Counter({None: 34, LAST: 3, 4: 7})
    assert Counter(r["doc_id"] for r in found if r["kept"]) == Counter({None: 19, LAST: 1, 4: 2})


def test_sets_that_share_a_fingerprint_stay_apart(spark, words):
    rows = [(i, words(30)) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs, superminhash.NearDuplicates(print_bits=4)).collect()}
    assert found == {k: k - 100 if k >= 100 else k for k, _ in rows}


def test_families_in_blocks_of_few_bytes(spark, words, monkeypatch):
    monkeypatch.setattr(superminhash, "FAMILY_BYTES", 4096)
    base = words(200).split()
    rows = [(i, " ".join([*base[:100], f"x{i}", *base[100:]])) for i in range(20)] + [(50, words(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs).collect()}
    assert found == {k: 0 if k < 50 else 50 for k, _ in rows}
