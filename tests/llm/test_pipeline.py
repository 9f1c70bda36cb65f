"""The corpus pipeline, stage by stage, against brute force."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from shoal.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(90)] for lang, letters in (("en", "abdehinorst"), ("fr", "éèaeuxilmnot"))}
    rows = []
    for i in range(120):
        lang = "fr" if i % 4 == 0 else "en"
        rows.append((" ".join(rng.choices(words[lang], k=rng.randint(3, 120))), lang))
    passage = " ".join(rng.choices(words["en"], k=60))
    rows += [(f"{rows[i][0]} {passage} {rows[i + 1][0]}", "en") for i in (1, 5, 9)]
    rows += [rows[2], rows[2], (rows[40][0] + " once", rows[40][1]), (None, "en"), ("", "fr"), ("12 -- 34 !!", "en"), (" ".join(rng.choices(words["en"], k=5000)), "en")]
    return [(i, t, lang, None if i % 11 == 0 else f"s{i % 3}", len(t or ""), 1) for i, (t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark, texts, tmp_path_factory):
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "p")
        stage(spark, docs, "").write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def content(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "substring_dedup", "mixing", "best_fit_packing"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_documents_without_letters_go(stages):
    before, after = content(stages["documents"]), content(stages["language_id"])
    assert after == {k: t for k, t in before.items() if any(c.isalpha() for c in t or "")}


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = content(stages["language_id"]), content(stages["near_duplicates"])
    sets = {}
    for k, t in before.items():
        w = WORD.findall(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    assert after == {k: before[k] for k in sets if label[k] == k}
    assert len(after) < len(before)


def test_repeated_passages_are_cut(stages):
    before, after = content(stages["near_duplicates"]), content(stages["substring_dedup"])
    seen, want = set(), {}
    for k in sorted(before):
        w = WORD.findall(before[k])
        gone = set()
        for i in range(len(w) - 19):
            s = tuple(w[i : i + 20])
            if s in seen:
                gone.update(range(i, i + 20))
            seen.add(s)
        if len(gone) < len(w):
            want[k] = [x for i, x in enumerate(w) if i not in gone]
    assert {k: WORD.findall(t) for k, t in after.items()} == want
    assert any(after[k] != before[k] for k in after)


def test_the_mix_reaches_its_targets(stages):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in stages["substring_dedup"].collect():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in stages["mixing"].collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for source, target in zip(order, mixing.targets([sizes[s] for s in order], mixing.Mixture()), strict=True):
        assert abs(taken[source] - target) <= 0.5 + 1e-9


def test_every_mixed_document_is_packed(stages):
    rows = stages["best_fit_packing"].collect()
    assert sum(r["piece"] == 0 for r in rows) == stages["mixing"].count()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        found.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False)) and sum(n for _, n in found) <= 2048


def test_empty_documents_run_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
