"""Clustering against fixtures with known answers and against brute force."""

import functools
import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoal.operators import assign, blocks as by_blocks, cluster, neighbors, partitioned
from shoal.operators.components import connected_components
from shoal.params import ClusterParams
from shoal.plans import boxes
from shoal.session import settled
from shoal.sources.points import POINT, InvalidPoints

F1 = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (5, 5), (5, 6), (6, 5), (6, 6), (10, 0), (0.5, 0.5)]
F2 = [-1.3, -1.2, -1.1, -0.9, 0.0, 0.9, 1.1, 1.2, 1.3]
F3 = [0.05, 0.6, 1.15]


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in (v if isinstance(v, (tuple, list)) else [v])]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, POINT)


def labels(result):
    return {r["id"]: r["cluster_id"] for r in result.collect()}


def brute(vectors, eps, min_pts):
    points = [tuple(map(float, v)) if isinstance(v, (tuple, list)) else (float(v),) for v in vectors]
    n = len(points)

    def far(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += (x - y) * (x - y)
        return math.sqrt(total)

    near = [[j for j in range(n) if j != i and far(points[i], points[j]) < eps] for i in range(n)]
    core = [len(x) >= min_pts for x in near]
    label, k = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = k
                        todo.append(j)
            k += 1
    return {i: label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(n)}


@pytest.mark.parametrize(
    ("min_pts", "eps", "clusters"),
    [(3, 1.1, {0: {0, 1, 2, 3, 10, 4}}), (3, 1.0, {0: {10, 0, 1, 2, 3}}), (2, 1.5, {0: {0, 1, 2, 3, 4, 10}, 1: {5, 6, 7, 8}})],
)
def test_blobs(spark, min_pts, eps, clusters):
    found = labels(cluster.cluster_points(frame(spark, F1), ClusterParams(eps, min_pts)))
    assert found == {i: next((k for k, m in clusters.items() if i in m), -1) for i in range(len(F1))}


def given_boxes(spark, *cuts):
    return spark.createDataFrame([(i, [c], 0) for i, c in enumerate(cuts)], boxes.BOXES)


def test_ambiguous_border_across_a_cut(spark):
    points, params = frame(spark, F2), ClusterParams(1.0, 3)
    expected = {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 9), 1)}
    assert labels(cluster.cluster_points(points, params)) == expected
    assert labels(partitioned.cluster_by_partitions(points, params, given_boxes(spark, (-5.0, 0.0), (0.0, 5.0)))) == expected


def test_cluster_whose_points_all_have_copies(spark):
    cut = given_boxes(spark, (-5.0, 0.0), (0.0, 1.2), (1.2, 5.0))
    assert labels(partitioned.cluster_by_partitions(frame(spark, F3), ClusterParams(1.0, 2), cut)) == {0: 0, 1: 0, 2: 0}


def test_boxes_must_tile(spark):
    with pytest.raises(ValueError, match="tile"):
        partitioned.cluster_by_partitions(frame(spark, F3), ClusterParams(1.0, 2), given_boxes(spark, (-5.0, 0.0)))


def test_coincident_points_are_neighbours(spark):
    found = labels(cluster.cluster_points(frame(spark, [(1, 1)] * 3 + [(9, 9)]), ClusterParams(0.5, 2)))
    assert found == {0: 0, 1: 0, 2: 0, 3: -1}


def test_degenerate_inputs(spark):
    params = ClusterParams(1.0, 1)
    assert labels(cluster.cluster_points(frame(spark, []), params)) == {}
    assert labels(partitioned.cluster_by_partitions(frame(spark, []), params)) == {}
    assert labels(cluster.cluster_points(frame(spark, [3.0]), params)) == {0: -1}
    constant = [(i / 10, 7.0) for i in range(30)]
    assert set(labels(partitioned.cluster_by_partitions(frame(spark, constant), ClusterParams(0.2, 1, 8, 5))).values()) == {0}
    # Ids beyond 32 bits.
    assert labels(cluster.cluster_points(frame(spark, [1.0, 1.1], first=2**40), params)) == {2**40: 0, 2**40 + 1: 0}


@pytest.mark.parametrize("vectors", [[(1, 2), (1,)], [(math.nan, 1)], [(math.inf, 1)]])
def test_invalid_points_are_refused(spark, vectors):
    with pytest.raises(InvalidPoints):
        cluster.cluster_points(frame(spark, vectors), ClusterParams(1.0, 1))


def test_duplicate_and_null_ids_are_refused(spark):
    for rows in ([(1, [1.0]), (1, [2.0])], [(None, [1.0])], [(1, None)]):
        with pytest.raises(InvalidPoints):
            cluster.cluster_points(spark.createDataFrame(rows, POINT), ClusterParams(1.0, 1))


def test_nan_rows_can_pass_as_noise(spark):
    found = labels(cluster.cluster_points(frame(spark, [0.0, 0.1, math.nan]), ClusterParams(1.0, 1), nan_as_noise=True))
    assert found == {0: 0, 1: 0, 2: -1}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.integers(1, 3).flatmap(lambda d: st.lists(st.tuples(*[st.integers(0, 12).map(lambda x: x / 4)] * d), min_size=1, max_size=40)),
    st.sampled_from([0.3, 0.5, 0.75]),
    st.integers(1, 4),
)
def test_matches_brute_force(spark, vectors, eps, min_pts):
    expected = brute(vectors, eps, min_pts)
    points = frame(spark, vectors)
    assert labels(cluster.cluster_points(points, ClusterParams(eps, min_pts))) == expected
    assert labels(partitioned.cluster_by_partitions(points.repartition(3), ClusterParams(eps, min_pts, 6, 8))) == expected


def test_many_dimensions(spark):
    vectors = [tuple(float((i * k) % 7) / 7 for k in range(1, 21)) for i in range(40)]
    assert labels(cluster.cluster_points(frame(spark, vectors), ClusterParams(0.9, 2))) == brute(vectors, 0.9, 2)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def narrow(n=60, d=32, far=0):
    """Points of many dimensions, none of them wide; some in a crowd far away."""
    rng = random.Random(n)
    rows = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(n)]
    rows = [[x / math.sqrt(sum(y * y for y in r)) for x in r] for r in rows]
    return [tuple(x + (0.9 if far and i % 2 else 0) for x in r) for i, r in enumerate(rows)]


def test_neighbour_join_is_an_equi_join(spark):
    for vectors, dims in ((F1, 2), (narrow(), 32), (narrow(far=1), 32)):
        points = frame(spark, vectors)
        for plan in (planned(neighbors.eps_neighbors(points, dims, 1.0)), planned(neighbors.pair_distance(points, dims, 1.0))):
            assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


def test_pivots_prune_where_no_dimension_is_wide(spark):
    points = frame(spark, narrow(far=1))
    grid = neighbors.grid_of(points, 32, 1.2)
    assert not grid.dims and grid.pivots and grid.blocks == 1
    assert neighbors.grid_of(frame(spark, narrow()), 32, 1.2).pivots == ()


@pytest.mark.parametrize("far", [0, 1])
def test_narrow_points_of_many_dimensions(spark, monkeypatch, far):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 16)
    vectors = narrow(far=far)
    points = frame(spark, vectors)
    assert neighbors.grid_of(points, 32, 1.25).blocks == (1 if far else 4)
    assert labels(cluster.cluster_points(points, ClusterParams(1.25, 3))) == brute(vectors, 1.25, 3)
    found = {(r["id"], r["neighbor"]) for r in neighbors.eps_neighbors(points, 32, 1.25).collect()}
    assert found == {(i, j) for i, a in enumerate(vectors) for j, b in enumerate(vectors) if i != j and math.dist(a, b) < 1.25}


def test_crowds_are_core_without_distances(spark):
    rng = random.Random(1)
    vectors = [(rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for _ in range(80)] + [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(80)]
    # Far out cells say nothing, and places may be met by rounding alone.
    vectors += [(2.0**60 + 1024 * i, 0.0) for i in range(12)] + [(5.0, 5.0)] * 9
    for min_pts in (1, 4, 8):
        assert labels(cluster.cluster_points(frame(spark, vectors), ClusterParams(0.4, min_pts))) == brute(vectors, 0.4, min_pts)


def test_a_missing_cluster_is_an_error(spark):
    local = spark.createDataFrame([(0, 1, "CORE", 0), (1, 1, "CORE", 0)], "pid int, id long, tag string, local_id int")
    clusters = spark.createDataFrame([(0, 0, 0)], "pid int, local_id int, cluster_id int")
    with pytest.raises(Exception, match="no cluster for local cluster 1_0"):
        partitioned.relabelled(local, clusters).collect()
    df = spark.createDataFrame([(7, None)], "component long, cluster_id int")
    with pytest.raises(Exception, match="no cluster for component 7"):
        df.select(cluster.mapped(F.col("cluster_id"), F.col("component"))).collect()


def test_merging_the_boxes_clusters(spark):
    """Local clusters by exact flags, merged and relabelled, are those of the whole."""
    points, params = frame(spark, F2), ClusterParams(1.0, 3)
    assigned = settled(assign.assign_partitions(points, given_boxes(spark, (-5.0, 0.0), (0.0, 5.0)), 1.0))
    local = settled(partitioned.local_clusters(assigned, 1, params, exact=True))
    found = partitioned.relabelled(local, partitioned.cluster_map(local, partitioned.merge_edges(local)))
    assert labels(found) == labels(cluster.cluster_points(points, params))


def test_many_boxes_are_met_by_slices(spark, monkeypatch):
    points = frame(spark, [i / 3 for i in range(90)])
    cuts = given_boxes(spark, *[(float(i), float(i + 1)) for i in range(31)])
    expected = {tuple(r) for r in assign.assign_partitions(points, cuts, 0.4).select("id", "pid", "role").collect()}
    monkeypatch.setattr(assign, "BROADCAST_BOXES", 3)
    assert {tuple(r) for r in assign.assign_partitions(points, cuts, 0.4).select("id", "pid", "role").collect()} == expected


@pytest.mark.parametrize("alone", [0, 1000])
def test_components(spark, alone):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (7, 7)]
    edges = spark.createDataFrame([*chain, (None, 1)], "a long, b long").repartition(5)
    found = {r["node"]: r["component"] for r in connected_components(edges, "a", "b", settled, alone).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), 3: 3, 5: 3, 9: 3, 7: 7}
    assert connected_components(edges.where(F.lit(False)), "a", "b", settled, alone).count() == 0


def test_parameters_are_checked():
    for bad in ({"eps": 0, "min_pts": 1}, {"eps": math.nan, "min_pts": 1}, {"eps": 1, "min_pts": 0}, {"eps": 1, "min_pts": 1, "buckets": 0}):
        with pytest.raises(ValueError):
            ClusterParams(**bad)
    with pytest.raises(ValueError, match="min_pts"):
        ClusterParams.from_mapping({"eps": "3"})
    assert ClusterParams.from_mapping({"eps": "3", "min_pts": "4", "other": "x"}) == ClusterParams(3.0, 4)


@pytest.fixture
def broadcasts(spark):
    """A session that broadcasts whatever it takes for small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_copies_are_broadcast_for_core_points(spark, broadcasts):
    points = frame(spark, F1)
    assert "SortMergeJoin" in planned(neighbors.eps_pairs(points, points, 2, 1.0, neighbors.grid_of(points, 2, 1.0)))
    for vectors, dims in ((F1, 2), (narrow(far=1), 32)):
        plan = planned(cluster.core_points(frame(spark, vectors), dims, ClusterParams(1.0, 3)))
        # The copies come from a Generate; what is broadcast has none below it.
        assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*(?:Project|Filter)?[^\n]*\n?[^\n]*Generate", plan)


def test_neither_cells_nor_places_are_broadcast_for_core_points(spark, broadcasts):
    vectors = F1 * 5 + [(20 + i / 10, 0) for i in range(5)]
    cores = cluster.core_points(frame(spark, vectors), 2, ClusterParams(1.1, 4))
    found = [r["id"] for r in cores.collect()]
    assert sorted(found) == [i for i, v in enumerate(vectors) if sum(math.dist(v, w) < 1.1 for w in vectors) > 4]
    # The plan that ran and the one before it.
    joins = re.findall(r"\w+Join \[[^\n]*", planned(cores))
    assert joins and not [x for x in joins if x.startswith("Broadcast") and re.search(r"vec#|_k0", x)]


def test_core_points_judge_each_place_once(spark):
    vectors = F1 * 5 + [(20 + i / 10, 0) for i in range(5)]
    for min_pts in (4, 5, 24, 30):
        found = {r["id"] for r in cluster.core_points(frame(spark, vectors), 2, ClusterParams(1.1, min_pts)).collect()}
        assert found == {i for i, v in enumerate(vectors) if sum(math.dist(v, w) < 1.1 for w in vectors) > min_pts}


def test_points_that_are_not_finite_have_no_neighbours(spark):
    vectors = [(math.nan, 1)] * 4 + [(math.inf, 1)] * 4 + [(-math.inf, 1)] * 4 + [(0, 1)] * 4
    points = frame(spark, vectors)
    assert {r["id"] for r in cluster.core_points(points, 2, ClusterParams(1.0, 3)).collect()} == {12, 13, 14, 15}


def test_neighbours_are_counted_place_by_place(spark, broadcasts):
    vectors = F1 * 3 + [(math.nan, 1)] * 2
    points = frame(spark, vectors)
    counts = neighbors.neighbor_counts(points, 2, 1.1)
    plan = planned(counts)
    assert "weight" in plan and "SortMergeJoin" in plan
    expected = {i: sum(j != i and math.dist(v, w) < 1.1 for j, w in enumerate(vectors)) for i, v in enumerate(vectors)}
    assert {r["id"]: r["neighbors"] for r in counts.collect()} == expected


def alike(vectors, eps, dims):
    """Pairs closer than eps by sums in dimension order."""
    rows = [tuple(map(float, v)) for v in vectors]
    far = lambda a, b: math.sqrt(functools.reduce(lambda s, p: s + (p[0] - p[1]) * (p[0] - p[1]), zip(a, b, strict=True), 0.0))
    return {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and far(a, b) < eps}


def test_core_points_of_narrow_data_are_counted_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 16)
    # Copies, places far from the origin, distances at eps, and what has no neighbours.
    vectors = [tuple(x + 1e6 for x in v) for v in narrow(n=40) * 2] + [tuple([1e6 + 1.25 * (i == k) for i in range(32)]) for k in range(4)] + [(1e6,) * 32]
    points = frame(spark, [*vectors, (math.nan,) * 32, (math.nan,) * 32])
    plan = planned(cluster.core_points(points, 32, ClusterParams(1.25, 3)))
    assert "MapInArrow" in plan
    pairs = alike(vectors, 1.25, 32)
    for min_pts in (1, 3, 12):
        found = {r["id"] for r in cluster.core_points(points, 32, ClusterParams(1.25, min_pts)).collect()}
        assert found == {i for i in range(len(vectors)) if sum(a == i for a, _ in pairs) >= min_pts}
    # More than a matrix product can hold.
    huge = [(1e200 * (i % 3),) + (0.5 * (i % 5),) * 19 for i in range(20)]
    block = by_blocks.block_pairs(*neighbors._sides(frame(spark, huge), frame(spark, huge), 20), 20, 1.0, 2)
    assert {(r["a_id"], r["b_id"]) for r in block.collect()} == alike(huge, 1.0, 20)


def test_pairs_of_narrow_data_are_found_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 16)
    monkeypatch.setattr(neighbors, "MEMBERS", 2)
    vectors = narrow(n=40) + narrow(n=5) * 7
    points = frame(spark, vectors)
    pairs = neighbors.pair_distance(points, 32, 1.25)
    assert "MapInArrow" in planned(pairs)
    found = {(r["id"], r["neighbor"]): r["distance"] for r in pairs.collect()}
    assert found.keys() == {(i, j) for i, j in alike(vectors, 1.25, 32) if i < j}
    assert all(abs(d - math.dist(vectors[i], vectors[j])) < 1e-8 for (i, j), d in found.items())


def test_pairs_of_points_at_the_same_place(spark, monkeypatch, broadcasts):
    monkeypatch.setattr(neighbors, "MEMBERS", 3)
    vectors = F1 * 8 + [(7, 7)]
    found = neighbors.eps_neighbors(frame(spark, vectors), 2, 1.1)
    assert planned(found).count("explode(") >= 3
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == alike(vectors, 1.1, 2)


def test_blocks_meet_only_inside_their_box(spark):
    vectors = narrow(n=40)
    boxed = frame(spark, vectors).withColumn("pid", (F.col("id") % 3).cast("int"))
    a, b = neighbors._sides(boxed, boxed.withColumn("weight", F.lit(2)), 32)
    expected = {(i, j) for i, j in alike(vectors, 1.25, 32) if i % 3 == j % 3}
    met = by_blocks.block_pairs(a, b, 32, 1.25, 2, ("pid",)).select("a_id", "b_id", "a_pid", "b_pid").collect()
    assert {(r["a_id"], r["b_id"]) for r in met} == expected and all(r["a_pid"] == r["b_pid"] for r in met)
    sums = by_blocks.block_sums(a, b, 32, 1.25, 2, ("pid",)).groupBy("a_id").agg(F.sum("weight").alias("n")).collect()
    assert {r["a_id"]: r["n"] for r in sums} == {i: 2 * sum(x == i for x, _ in expected) for i in {x for x, _ in expected}}
