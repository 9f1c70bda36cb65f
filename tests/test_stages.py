"""Statistics, planner, roles, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from shoal.functions.geometry import role
from shoal.operators import stats
from shoal.params import ClusterParams
from shoal.plans.boxes import plan_leaves, plan_partitions, split_point
from shoal.sources.points import POINT, points_from, read_points, write_result

NONE, OUT, MARGIN, IN = None, "OUTER_MARGIN", "INNER_MARGIN", "INNER_REGION"
ROLES = {-1.01: NONE, -1.0: OUT, -0.5: OUT, 0.0: MARGIN, 0.9: MARGIN, 1.0: IN, 5.0: IN, 9.0: MARGIN, 9.5: MARGIN, 10.0: OUT, 10.9: OUT, 11.0: NONE}


def test_roles(spark):
    df = spark.createDataFrame([([v], [(0.0, 10.0)]) for v in ROLES], "vec array<double>, b array<struct<lower:double,upper:double>>")
    assert {r[0]: r[1] for r in df.select(F.col("vec")[0], role(F.col("vec"), F.col("b"), 1.0)).collect()} == ROLES


@pytest.mark.parametrize(
    ("histograms", "total", "size", "expected"),
    [
        ([[9, 5, 3, 1, 4, 8]], 30, 18, [([(0, 4)], 18), ([(4, 6)], 12)]),
        ([[1, 2, 3, 6, 9, 9]], 30, 16, [([(0, 4)], 12), ([(4, 5)], 5), ([(5, 6)], 13)]),
        ([[10, 10, 2, 10, 10, 8], [9, 8, 8, 8, 8, 9]], 50, 30, [([(0, 3), (0, 6)], 22), ([(3, 6), (0, 6)], 28)]),
        ([[10, 10, 2, 10, 10, 8], [9, 8, 8, 8, 8, 9]], 50, 24, [([(0, 3), (0, 6)], 22), ([(3, 4), (0, 6)], 5), ([(4, 6), (0, 6)], 23)]),
        ([[3, 3, 3, 3]], 12, 12, [([(0, 4)], 12)]),
    ],
)
def test_planner(histograms, total, size, expected):
    assert [(list(x.ranges), x.estimate) for x in plan_leaves(histograms, total, size)] == expected


def test_half_of_an_odd_count_is_rounded_down():
    assert split_point([1] * 7, 0, 7, 5) == 1
    assert split_point([3, 1, 1, 1, 3, 3], 0, 6, 7) == 2


def test_estimates_within_the_range_add_up():
    counts = [7, 9, 1, 4, 30, 2, 2, 9]
    leaves = plan_leaves([counts], sum(counts), 20, within=True)
    assert [x.estimate for x in leaves] == [sum(counts[slice(*x.ranges[0])]) for x in leaves]
    # Of the whole histogram a nested range's part is too small.
    assert [x.estimate for x in plan_leaves([counts], sum(counts), 20)] != [x.estimate for x in leaves]


@pytest.mark.parametrize(("counts", "size"), [([9, 5, 3, 1, 4, 8], 16), ([100, 0, 0, 0], 10), ([80, 0, 0, 3, 3, 4, 5, 5], 10)])
def test_planner_always_ends_and_tiles(counts, size):
    leaves = sorted(x.ranges[0] for x in plan_leaves([counts], sum(counts), size))
    assert leaves[0][0] == 0 and leaves[-1][1] == len(counts)
    assert all(a < b for a, b in leaves) and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:], strict=False))


def test_histogram_keeps_empty_buckets_and_clamps(spark):
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0, 1, 10])], POINT)
    counts = {r["bucket"]: r["n"] for r in stats.histogram(points, 5).collect()}
    assert counts == {0: 3, 1: 0, 2: 0, 3: 0, 4: 1}
    assert stats.histogram(points.limit(0), 5).count() == 0
    assert stats.bounds(points).first()["upper"] == 10 + 1e-6
    assert stats.count_rate(stats.histogram(points, 5), 0, 0, 1) == 0.75


def test_largest_point_has_a_home_where_the_open_end_is_lost(spark):
    points = spark.createDataFrame([(i, [2.0**40 + i]) for i in range(64)], POINT)
    plan = plan_partitions(points, ClusterParams(2.0, 1, 8, 10)).collect()
    assert max(b["upper"] for r in plan for b in r["bounds"]) > 2.0**40 + 63


def test_points_from_columns_and_arrays(spark):
    df = spark.createDataFrame([(1, 2, 3.0, [4.0, 5.0])], "k int, x int, y double, e array<float>")
    assert points_from(df, "k", ["x", "y"]).first()["vec"] == [2.0, 3.0]
    assert points_from(df, "k", "e").first()["vec"] == [4.0, 5.0]


def rows(df):
    return sorted((r["id"], tuple(r["vec"])) for r in df.collect())


def test_text_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1 2.5 3\n\n  2 4 5  \n7\n9000000000 1e3 -1\n")
    (tmp_path / "skip.txt").write_text("5 5 5\n")
    assert rows(read_points(spark, str(tmp_path))) == [(1, (2.5, 3.0)), (2, (4.0, 5.0)), (9000000000, (1000.0, -1.0))]


def test_text_points_without_ids_and_with_header(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x|y\n1|2\n\n3|4\n")
    (tmp_path / "b.csv").write_text("x|y\n5|6\n")
    found = rows(read_points(spark, str(tmp_path), delimiter="|", header=True, with_id=False))
    assert [v for _, v in found] == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)] and [i for i, _ in found] == [0, 1, 2]


@pytest.mark.parametrize("line", ["1 2 x", "1 2 ", "a 2 3"])
def test_bad_tokens_fail(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(line.replace(" ", ",") + "\n")
    with pytest.raises(Exception, match="not a number"):
        read_points(spark, str(tmp_path), delimiter=",").collect()


def test_result_as_text(spark, tmp_path):
    result = spark.createDataFrame([(3, -1, [1.0, 2.5])], "id long, cluster_id int, vec array<double>")
    write_result(result, str(tmp_path / "out"), "tsv")
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "3\t-1\t[1.0, 2.5]"
