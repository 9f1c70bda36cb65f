"""Recall and work of the two vector searches, where they have to prune."""

import time

import numpy as np
import pytest

from shoal.llm import collision_ann, norm_topk, vectors


def unit(n, seed=3, d=64):
    rows = np.random.default_rng(seed).standard_normal((n, d))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def alike(n, groups=100, seed=6):
    rng = np.random.default_rng(seed)
    rows = unit(groups)[rng.integers(0, groups, n)] + 0.04 * rng.standard_normal((n, 64))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def searched_block(rows, how=None, top=21, every=40, seeds=256):
    """Recall, and the index after answering, with bounds from some seed rows."""
    known = np.zeros(len(rows), bool)
    known[:: len(rows) // seeds] = True
    index = collision_ann.CollisionIndex(np.arange(len(rows)), rows, known, top, how or collision_ann.CollisionHashing())
    queries = rows[::every]
    bounds = np.sort(queries @ rows[known].T, axis=1)[:, -top] - 1e-9
    at, ids, score = index(queries, bounds)
    products = queries @ rows.T
    want = np.argsort(-products, axis=1)[:, :top]
    assert np.allclose(score, products[at, ids])
    return np.mean([np.isin(want[q], ids[at == q]).mean() for q in range(len(queries))]), index


@pytest.mark.parametrize("sigma", [0.2, 0.5, 1.0])
def test_recall_where_lengths_differ(sigma):
    lengths = np.random.default_rng(4).lognormal(0, sigma, (3000, 1))
    assert searched_block(unit(3000) * lengths)[0] >= 0.9


def test_one_long_vector_does_not_lower_recall():
    rows = unit(3000)
    rows[5] *= 3
    assert searched_block(rows)[0] >= 0.9


def test_under_a_quarter_of_the_rows_is_verified():
    lengths = np.random.default_rng(4).lognormal(0, 0.5, (12_000, 1))
    for rows in (unit(12_000) * lengths, alike(12_000)):
        recall, index = searched_block(rows, every=200)
        assert recall >= 0.9
        assert index.verified < 0.25 * index.asked


def test_no_array_entry_is_counted_twice():
    rows = unit(4000)
    _, index = searched_block(rows, every=100)
    assert 0 < index.touched <= index.how.functions * index.asked
    # Alike vectors are found in narrow windows.
    _, near = searched_block(alike(4000), every=100)
    assert near.touched < 0.7 * index.touched


@pytest.mark.parametrize("width", [0.01, 0.3])
def test_steps_narrow_and_wide_count_the_entries_in_the_window(width):
    rows = unit(2000)
    index = collision_ann.SortedProjections(rows, 1.0, collision_ann.CollisionHashing(functions=90, threshold=60))
    counts, centre = np.zeros(2000, np.int64), index.centre(rows[7])
    first = last = index.places(centre)
    total = 0
    for half in (width, 1.5 * width, 4 * width):
        low, high = index.places(centre - half), index.places(centre + half)
        total += index.widened(counts, low, first, last, high)
        first, last = low, high
        inside = (np.abs(index.value - np.repeat(centre, 2000)) <= half).reshape(90, 2000)
        assert counts.tolist() == np.bincount(index.vector[inside.ravel()], minlength=2000).tolist()
    assert total == counts.sum()


def test_counting_takes_less_time_than_walking_all_entries():
    """Half of all entries at once: one sweep over small ranks, not a walk."""
    rows = unit(12_000)
    index = collision_ann.SortedProjections(rows, 1.0, collision_ann.CollisionHashing())
    low, middle, high = (index.first + x for x in (3000, 6000, 9000))
    counts = np.zeros(12_000, np.int64)

    def walked():
        entries = [index.vector[a:z] for a, z in zip(low.tolist(), high.tolist(), strict=True)]
        return np.bincount(np.concatenate(entries), minlength=12_000)

    def seconds(f):
        took = []
        for _ in range(9):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    quick, slow = seconds(lambda: index.widened(counts, low, middle, middle, high)), seconds(walked)
    assert counts.tolist() == walked().tolist()
    assert quick < 0.8 * slow


def test_the_windows_find_what_the_seeds_do_not_hold():
    rows = alike(6000)
    recall, index = searched_block(rows, seeds=40, every=100)
    assert recall >= 0.9 and index.verified > index.asked * 40 / 6000


def test_parts_cover_all_rows_and_stay_narrow():
    lengths = np.sort(np.random.default_rng(5).lognormal(0, 1, 5000))[::-1]
    parts = collision_ann.parts_of(lengths, 1.15, 50)
    assert [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and (parts[0].start, parts[-1].stop) == (0, 5000)
    assert all(p.stop - p.start == 50 or lengths[p.start] <= 1.15 * lengths[p.stop - 1] for p in parts[:-1])


def test_parameters_are_checked():
    for bad in ({"threshold": 0}, {"threshold": 97}, {"likely": 1.0}, {"growth": 1.0}):
        with pytest.raises(ValueError, match="out of range"):
            collision_ann.CollisionHashing(**bad)


@pytest.mark.parametrize("sigma", [0.0, 0.3, 0.8])
def test_exact_top_over_buckets(sigma):
    rng = np.random.default_rng(7)
    rows = np.floor(256 * unit(5000) * rng.lognormal(0, sigma, (5000, 1))).astype(np.int64)
    rows[100:140] = rows[3]
    index = norm_topk.NormBuckets(np.arange(5000), rows, 6, bucket=200)
    queries = rows[::100]
    at, ids, score = index(queries, np.full(len(queries), np.nan))
    products = queries @ rows.T
    for q in range(len(queries)):
        want = sorted(zip((-products[q]).tolist(), range(5000), strict=True))[:6]
        assert [(-s, i) for i, s in zip(ids[at == q].tolist(), score[at == q].tolist(), strict=True)] == [(s, i) for s, i in want]
    share = index.computed / index.possible
    assert share < (1.0 if sigma == 0.3 else 0.3) if sigma else share <= 1.0


def test_coordinates_prune_where_cosines_are_high():
    rows = np.floor(4096 * alike(6000)).astype(np.int64)
    index = norm_topk.NormBuckets(np.arange(6000), rows, 6)
    queries = rows[::300]
    bounds = np.sort(queries @ rows.T, axis=1)[:, -6].astype(float)
    at, ids, _ = index(queries, bounds)
    want = np.argsort(-(queries @ rows.T), axis=1, kind="stable")[:, :6]
    assert all(set(want[q].tolist()) == set(ids[at == q].tolist()) for q in range(len(queries)))
    assert index.computed < 0.5 * index.possible


def test_layout_sends_queries_only_to_blocks_long_enough():
    plan = vectors.layout([(0, 10, 0.0), (5, 30, 0.25), (9, 2, 0.45), (-3, 500, -0.14)], 20)
    assert sorted(r for r, _, _ in plan.table) == [-3, 0, 5, 9]
    assert list(plan.limits) == sorted(plan.limits, reverse=True)
    assert plan.ends[-1] == sum(n for _, n in {(first, n) for _, first, n in plan.table})
    reach = plan.reach(np.array([-np.inf, -0.14, 0.01, 0.3, 0.46]))
    assert reach[0] == reach[1] == plan.ends[-1] and list(reach) == sorted(reach, reverse=True) and reach[-1] == 0 and reach[3] >= 1


def test_lengths_of_any_size(spark):
    rows = [[3.0, 4.0], [3e200, 4e200], [3e-200, 4e-200], [0.0, 0.0], [-1e308, 1e308]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    found = [r["log"] for r in vectors.with_log_length(df, "log").orderBy("i").collect()]
    want = vectors.log_lengths(np.array(rows)).tolist()
    assert found[3] is None and want[3] == -np.inf
    assert np.allclose([found[i] for i in (0, 1, 2, 4)], [want[i] for i in (0, 1, 2, 4)], rtol=1e-12)
