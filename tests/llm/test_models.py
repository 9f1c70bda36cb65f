"""Language identification and toxicity against plain versions of the same sums."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from shoal.llm import language_id, toxicity
from shoal.llm.chartext import _ODD

MASK = (1 << 64) - 1


def bucket(points, n, bits):
    h = n
    for p, odd in zip(points, _ODD, strict=False):
        h = (h + p * int(odd)) & MASK
    h ^= h >> 29
    return ((h * 0xBF58476D1CE4E5B9) & MASK) >> (64 - bits)


def grams(text, sizes, bits, letters_only):
    chars = [c if not letters_only or c.isalpha() else " " for c in f" {(text or '').lower()} "]
    return [bucket([ord(c) for c in chars[i : i + n]], n, bits) for n in sizes for i in range(len(chars) - n + 1)]


def normal(logs):
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [p / sum(parts) for p in parts]


def fused_by_hand(docs, records, how, fusion):
    """Each record's (id, lang, probability): counts, evidence, groups and fusion in plain Python."""
    languages = sorted({lang for _, _, lang in docs})
    counts = {lang: Counter() for lang in languages}
    for _, text, lang in docs:
        counts[lang].update(grams(text, how.sizes, how.bits, True))
    total = {lang: sum(c.values()) + how.smoothing * 2**how.bits for lang, c in counts.items()}
    evidence, soft, letters = [], [], []
    for _, text, *_ in records:
        found = grams(text, how.sizes, how.bits, True)
        logs = [sum(math.log((counts[lang][g] + how.smoothing) / total[lang]) for g in found) for lang in languages]
        letters.append(sum(c.isalpha() for c in (text or "").lower()))
        scale = min(1.0, fusion.effective / max(len(found), 1)) if letters[-1] else 0.0
        evidence.append([(x - max(logs)) * scale for x in logs])
        soft.append([round(p * 2**24) / 2**24 for p in normal(evidence[-1])] if letters[-1] else [0.0] * len(languages))
    sums = defaultdict(lambda: [0.0] * len(languages))
    for r, s in zip(records, soft, strict=True):
        for place in (2, 3, 4, 5):
            if r[place] is not None:
                sums[place, r[place]] = [a + b for a, b in zip(sums[place, r[place]], s, strict=True)]
    every = [sum(s[i] for s in soft) for i in range(len(languages))]
    out = []
    for r, e, s, n in zip(records, evidence, soft, letters, strict=True):
        prior = [(x + 1.0) / (sum(every) + len(languages)) for x in every]
        for place in (5, 4):
            others = [max(0.0, a - b) for a, b in zip(sums[place, r[place]], s, strict=True)] if r[place] is not None else [0.0] * len(s)
            prior = [(o + fusion.host * p) / (sum(others) + fusion.host) for o, p in zip(others, prior, strict=True)]
        logs = [x + math.log(p) for x, p in zip(e, prior, strict=True)]
        for place in (2, 3):
            if r[place] is not None:
                others = [max(0.0, a - b) for a, b in zip(sums[place, r[place]], s, strict=True)]
                share = (sum(others) + 1.0) / (sum(every) + 2.0)
                logs = [x + math.log((o + fusion.tag * share) / (max(0.0, a - b) + fusion.tag)) for x, o, a, b in zip(logs, others, every, s, strict=True)]
        p = normal(logs)
        ok = n > 0 and max(p) >= fusion.least
        out.append((r[0], languages[p.index(max(p))] if ok else "und", round(max(p), 5)))
    return out


RECORDS = "id long, text string, declared string, suffix string, host string, domain string"


def test_fusion_by_hand(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "thing", "was"], "fr": ["les", "été", "dans", "est"], "de": ["und", "über", "das", "ist"]}
    langs = list(words)
    docs = [(3 * i + j, " ".join(rng.choices(words[lang], k=rng.randint(3, 20))), lang) for i in range(15) for j, lang in enumerate(langs)]
    records = []
    for i in range(60):
        lang = langs[i % 3]
        text = " ".join(rng.choices(words[lang] + words["en"], k=rng.randint(0, 6)))
        records.append((i, text, rng.choice([lang, "xx", None]), rng.choice(["com", "fr", None]), rng.choice(["h1", f"h-{lang}", None]), rng.choice(["d1", f"d-{lang}", None])))
    records += [(60, None, "fr", None, "h1", None), (61, "12 34", None, None, None, None), (5, "the the", "en", "com", "h1", "d1"), (5, "the the", "en", "com", "h1", "d1")]
    how, fusion = language_id.LanguageTraining(bits=12), language_id.Fusion()
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), how)
    assert model.languages == ("de", "en", "fr")
    want = Counter(fused_by_hand(docs, records, how, fusion))
    for parts in (1, 4):
        found = language_id.fused(spark.createDataFrame(records, RECORDS).repartition(parts), model, fusion).collect()
        assert Counter((r["id"], r["lang"], round(r["probability"], 5)) for r in found) == want


def test_the_result_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["les", "the", "und", "été"], k=8)), rng.choice(["a", "b"])) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    records = spark.createDataFrame([(i, t, None, "com", f"h{i % 3}", "d") for i, t, _ in docs], RECORDS)
    model = language_id.fit(df)
    one, other = (sorted(map(repr, language_id.fused(records.repartition(n), model).collect())) for n in (1, 7))
    assert one == other


def test_every_label_is_a_language(spark):
    docs = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert len(language_id.fit(df).languages) == 90
    assert len(language_id.fit(df, language_id.LanguageTraining(languages=7)).languages) == 7


def test_languages_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "the thing", "en", "c"), (2, "été dans", "fr", "c"), (None, "x", "en", "c"), (3, None, "en", "c")], "doc_id long, text string, lang string, id string")
    model = language_id.fit(docs)
    pages = spark.createDataFrame([(1, "http://a.fr/", "<p>" + "été " * 300_000, "c"), (2, None, None, "c"), (2, "no url", "", "c")], "page_id long, url string, html string, lang string")
    found = language_id.fused(language_id.page_records(pages), model).collect()
    assert sorted((r["id"], r["lang"]) for r in found) == [(1, "fr"), (2, "und"), (2, "und")]
    assert language_id.fused(language_id.page_records(pages.limit(0)), model).count() == 0
    assert language_id.fit(docs.limit(0)).languages == ()


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(1, "some text", None, "s", 9), (2, "12 --", None, "s", 5), (3, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").collect()] == [1]


def toxic_tables(spark, n=400):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdehilnorst", k=rng.randint(2, 7))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 40))
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["moronic", "scumbag"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    return docs, labels


def toxicity_by_hand(docs, labels, how):
    """Scores of all texts: sets, counts, ratios and a regression by Newton's method."""
    text = dict(docs)
    sets = {i: frozenset(grams(t, how.sizes, how.bits, False)) for i, t in text.items()}
    sample = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5]
    bad, good = (sum(y == kind for _, y in sample) for kind in (1, 0))
    p, q = Counter(), Counter()
    for i, y in sample:
        (p if y else q).update(sets[i])
    chi = {}
    for f in set(p) | set(q):
        a, b = p[f], q[f]
        spread = (a + b) * (bad + good - a - b)
        if a + b >= 3:
            chi[f] = (a * (good - b) - b * (bad - a)) ** 2 * (bad + good) / (spread * bad * good) if spread else 0.0
    features = sorted(sorted(chi, key=lambda f: (-chi[f], f))[: how.features])
    ratio = np.array([math.log((p[f] + how.smoothing) / (bad + 2 * how.smoothing)) - math.log((q[f] + how.smoothing) / (good + 2 * how.smoothing)) for f in features])
    x = np.array([[f in sets[i] for f in features] for i, _ in sample], float) * ratio
    y = np.array([y for _, y in sample], float)
    cost = np.where(y == 1, how.toxic_weight, 1.0)
    x = np.hstack((x, np.ones((len(y), 1))))
    rigid = np.diag([how.penalty] * len(features) + [0.0])
    w = np.append(np.zeros(len(features)), math.log((bad + 1) / (good + 1)))
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x.T * (cost * p * (1 - p))) @ x + rigid, x.T @ (cost * (p - y)) + rigid @ w)
    return {i: 1 / (1 + math.exp(-(sum(w[k] * ratio[k] for k, f in enumerate(features) if f in s) + w[-1]))) for i, s in sets.items()}


def test_toxicity_by_hand(spark):
    docs, labels = toxic_tables(spark, 200)
    how = toxicity.ToxicityTraining(features=60, bits=14, rounds=400, precise=1e-7)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), how)
    want = toxicity_by_hand(docs, labels, how)
    for r in toxicity.scored(d, model).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-4)


def test_the_regression_finds_the_least_loss():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 12))
    a = a.T @ a + np.eye(12)
    b = rng.standard_normal(12)
    x = toxicity.minimised(lambda x: (x @ a @ x / 2 - b @ x, a @ x - b), np.zeros(12), 200, 1e-9)
    assert np.allclose(a @ x, b, atol=1e-6)


def test_toxicity_of_odd_tables(spark):
    docs, labels = toxic_tables(spark)
    long = "fine words " * 200_000 + "scumbag moronic"
    docs += [(1000, None), (1001, ""), (None, "fine"), (7, docs[7][1]), (1002, long)]
    labels += [(5, None, None), (None, 1, 1), (7, 1, 0), (7, 1, 1)]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, marks)
    rows = toxicity.scored(d, model).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1000] == by[1001]
    assert toxicity.scored(d.limit(0), model).count() == 0
    for some in ((d.limit(0), marks), (d, marks.limit(0)), (d, marks.where("toxic = 1"))):
        bare = toxicity.fit(*some)
        assert not len(bare.features) and toxicity.scored(d, bare).count() == len(docs)
