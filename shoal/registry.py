"""The clustering queries over the shared tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import assign, cluster, neighbors, partitioned, stats
from shoal.params import ClusterParams
from shoal.plans import boxes
from shoal.session import settled
from shoal.sources import points as source


@dataclass(frozen=True)
class Workload:
    """A table's points: id, coordinate expressions (or one array column), eps and min_pts."""

    table: str
    id: str
    features: tuple[str, ...] | str
    eps: float
    min_pts: int
    dims: int

    def points(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if isinstance(self.features, str):
            return source.points_from(df, self.id, self.features)
        names = [f"v{i}" for i in range(self.dims)]
        df = df.select(self.id, *[F.expr(e).alias(n) for e, n in zip(self.features, names, strict=True)])
        return source.points_from(df, self.id, names)

    @property
    def params(self) -> ClusterParams:
        return ClusterParams(self.eps, self.min_pts, 16, 600)

    # SQL

    @property
    def values(self) -> list[str]:
        """Each coordinate as a double."""
        if isinstance(self.features, str):
            return [f"CAST({self.features}[{i + 1}] AS DOUBLE)" for i in range(self.dims)]
        return [f"CAST({e} AS DOUBLE)" for e in self.features]

    @property
    def pts(self) -> str:
        columns = ", ".join(f"{e} AS v{i}" for i, e in enumerate(self.values))
        return f"pts AS (SELECT CAST({self.id} AS BIGINT) AS id, {columns} FROM {self.table})"

    @property
    def near(self) -> str:
        """Ordered pairs; the band is a slack prefilter."""
        squares = " + ".join(f"(a.v{i} - b.v{i}) * (a.v{i} - b.v{i})" for i in range(self.dims))
        slack = self.eps * 1.0001
        band = f"b.v0 BETWEEN a.v0 - {slack} AND a.v0 + {slack}"
        return (
            f"near AS (SELECT a.id AS id, b.id AS nb, sqrt({squares}) AS dist FROM pts a JOIN pts b "
            f"ON {band} AND a.id <> b.id WHERE sqrt({squares}) < {self.eps})"
        )

    @property
    def cores(self) -> str:
        return f"cores AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {self.min_pts})"

    @property
    def labels(self) -> str:
        """Components by recursion: every core reaches the smallest core id of its component."""
        return (
            "links AS (SELECT n.id, n.nb FROM near n JOIN cores a ON a.id = n.id JOIN cores b ON b.id = n.nb), "
            "reach(id, label) AS (SELECT id, id FROM cores UNION SELECT l.nb, r.label FROM reach r JOIN links l ON l.id = r.id "
            "WHERE r.label < l.nb), "
            "comp AS (SELECT id, min(label) AS component FROM reach GROUP BY id)"
        )

    @property
    def clusters(self) -> str:
        return (
            "named AS (SELECT id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INTEGER) AS cluster_id FROM comp), "
            "edge AS (SELECT n.id, min(c.cluster_id) AS cluster_id FROM near n JOIN named c ON c.id = n.nb "
            "WHERE n.id NOT IN (SELECT id FROM cores) GROUP BY n.id), "
            "result AS (SELECT p.id, coalesce(c.cluster_id, e.cluster_id, -1) AS cluster_id, p.* EXCLUDE (id) "
            "FROM pts p LEFT JOIN named c ON c.id = p.id LEFT JOIN edge e ON e.id = p.id)"
        )

    def sql(self, select: str, *parts: str) -> str:
        return f"WITH RECURSIVE {', '.join(parts)} {select}"


C1 = Workload("part", "p_partkey", ("p_size * 2", "p_retailprice"), 3.0, 8, 2)
C2 = Workload("customer", "c_custkey", ("c_acctbal", "c_nationkey * 1000"), 250.0, 4, 2)
C3 = Workload("events", "event_id", ("value", "user_id"), 1.5, 8, 2)
C4 = Workload("orders", "o_orderkey", ("o_totalprice",), 100.0, 6, 1)
C5 = Workload("embeddings", "vec_id", "embedding", 1.15, 3, 64)
C6 = Workload("supplier", "s_suppkey", ("s_acctbal",), 200.0, 3, 1)
ALL = {"": C1, "_c2": C2, "_c3": C3, "_c4": C4, "_c5": C5, "_c6": C6}

BUCKETS = 16
#: Boxes of the C1 partition queries: pid, then [lower, upper) of each dimension.
BOXES = [(0, (2.0, 51.0), (900.0, 950.0)), (1, (2.0, 51.0), (950.0, 1000.0)), (2, (51.0, 101.0), (900.0, 950.0)), (3, (51.0, 101.0), (950.0, 1000.0))]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _flat(df: DataFrame, dims: int, *names: str) -> DataFrame:
    return df.select(*names, *[F.col("vec")[i].alias(f"v{i}") for i in range(dims)])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the events table."""
    return cluster.cluster_points(C3.points(spark, sf_dir), C3.params)


def fixed_boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, list(sides), 0) for p, *sides in BOXES], boxes.BOXES)


# --- points and statistics


@_query("scan_points", C1.sql("SELECT id, v0, v1 FROM pts", C1.pts))
def scan_points(spark, sf_dir):
    return _flat(C1.points(spark, sf_dir), 2, "id")


@_query("scan_text_points", C1.sql("SELECT id, v0, v1 FROM pts", C1.pts))
def scan_text_points(spark, sf_dir):
    """Points written out as delimited lines and parsed again."""
    points = C1.points(spark, sf_dir)
    line = F.concat_ws("|", F.col("id").cast("string"), *[F.col("vec")[i].cast("string") for i in range(2)])
    return _flat(source.points_of_lines(points.select(F.concat(F.lit("  "), line, F.lit(" ")).alias("value")), "|"), 2, "id")


_LONG = "long AS (SELECT id, 0 AS dim, v0 AS value FROM pts UNION ALL SELECT id, 1 AS dim, v1 AS value FROM pts)"


@_query("unpivot_dims", C1.sql("SELECT id, CAST(dim AS INTEGER) AS dim, value FROM long", C1.pts, _LONG))
def unpivot_dims(spark, sf_dir):
    return stats.unpivot_dims(C1.points(spark, sf_dir))


@_query("dim_counts", C1.sql("SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n FROM long GROUP BY dim", C1.pts, _LONG))
def dim_counts(spark, sf_dir):
    return stats.dim_counts(C1.points(spark, sf_dir))


_EDGES = "edges AS (SELECT dim, min(value) AS lower, max(value) + 1e-6::DOUBLE AS upper FROM long GROUP BY dim)"
for _suffix, _w in (("", C1), ("_c2", C2)):

    @_query(f"bounds{_suffix}", _w.sql("SELECT CAST(dim AS INTEGER) AS dim, lower, upper FROM edges", _w.pts, _LONG, _EDGES))
    def bounds(spark, sf_dir, w=_w):
        return stats.bounds(w.points(spark, sf_dir))


_COUNTS = (
    "placed AS (SELECT l.dim, least(15, CAST(floor((least(greatest(value, lower), upper) - lower) / (upper - lower) * 16.0::DOUBLE) AS BIGINT)) "
    "AS bucket FROM long l JOIN edges e ON e.dim = l.dim), "
    "counts AS (SELECT CAST(e.dim AS INTEGER) AS dim, r.range AS bucket, coalesce(c.n, 0) AS n FROM edges e CROSS JOIN range(0, 16) r "
    "LEFT JOIN (SELECT dim, bucket, count(*) AS n FROM placed GROUP BY dim, bucket) c ON c.dim = e.dim AND c.bucket = r.range)"
)
for _suffix, _w in (("", C1), ("_c3", C3)):

    @_query(f"histogram{_suffix}", _w.sql("SELECT dim, bucket, n FROM counts", _w.pts, _LONG, _EDGES, _COUNTS))
    def histogram(spark, sf_dir, w=_w):
        return stats.histogram(w.points(spark, sf_dir), BUCKETS)


def _counts(spark, sf_dir):
    return stats.histogram(C1.points(spark, sf_dir), BUCKETS)


@_query(
    "histogram_array",
    C1.sql("SELECT dim, CAST(sum(n) AS BIGINT) AS total, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bucket) AS histogram FROM counts GROUP BY dim", C1.pts, _LONG, _EDGES, _COUNTS),
)
def histogram_array(spark, sf_dir):
    return stats.histogram_array(_counts(spark, sf_dir))


@_query("bucket_variance", C1.sql("SELECT dim, round(var_pop(n), 6) AS variance FROM counts GROUP BY dim", C1.pts, _LONG, _EDGES, _COUNTS))
def bucket_variance(spark, sf_dir):
    return stats.bucket_variance(_counts(spark, sf_dir))


@_query(
    "histogram_prefix",
    C1.sql("SELECT dim, bucket, CAST(sum(n) OVER (PARTITION BY dim ORDER BY bucket) AS BIGINT) AS prefix FROM counts", C1.pts, _LONG, _EDGES, _COUNTS),
)
def histogram_prefix(spark, sf_dir):
    return stats.histogram_prefix(_counts(spark, sf_dir))


# --- partitioning

_BOX_SQL = "boxes(pid, lo0, hi0, lo1, hi1) AS (VALUES " + ", ".join(f"({p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for p, (a, b), (c, d) in BOXES) + ")"


def _sides(alias: str) -> str:
    e = f"{C1.eps}::DOUBLE"
    parts = [
        f"CASE WHEN p.v{i} < lo{i} - {e} OR p.v{i} >= hi{i} + {e} THEN 3 WHEN p.v{i} < lo{i} OR p.v{i} >= hi{i} THEN 2 "
        f"WHEN p.v{i} < lo{i} + {e} OR p.v{i} >= hi{i} - {e} THEN 1 ELSE 0 END"
        for i in range(2)
    ]
    return f"greatest({', '.join(parts)}) AS {alias}"


_ASSIGNED = (
    f"met AS (SELECT p.id, p.v0, p.v1, b.pid, {_sides('side')} FROM pts p CROSS JOIN boxes b), "
    "assigned AS (SELECT id, v0, v1, pid, CASE side WHEN 2 THEN 'OUTER_MARGIN' WHEN 1 THEN 'INNER_MARGIN' ELSE 'INNER_REGION' END AS role FROM met WHERE side < 3)"
)


def _assigned(spark, sf_dir):
    return assign.assign_partitions(C1.points(spark, sf_dir), fixed_boxes(spark), C1.eps)


@_query("partition_roles", C1.sql("SELECT id, pid, role FROM assigned", C1.pts, _BOX_SQL, _ASSIGNED))
def partition_roles(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", "pid", "role")


@_query("assign_partitions", C1.sql("SELECT id, v0, v1, pid, role FROM assigned", C1.pts, _BOX_SQL, _ASSIGNED))
def assign_partitions(spark, sf_dir):
    return _flat(_assigned(spark, sf_dir), 2, "id", "pid", "role")


@_query("partition_sizes", C1.sql("SELECT pid, role, count(*) AS n FROM assigned GROUP BY pid, role", C1.pts, _BOX_SQL, _ASSIGNED))
def partition_sizes(spark, sf_dir):
    return assign.partition_sizes(_assigned(spark, sf_dir))


@_query(
    "point_copies",
    C1.sql("SELECT id, count(*) AS copies, min(CASE WHEN role <> 'OUTER_MARGIN' THEN pid END) AS home FROM assigned GROUP BY id", C1.pts, _BOX_SQL, _ASSIGNED),
)
def point_copies(spark, sf_dir):
    return assign.point_copies(_assigned(spark, sf_dir))


def _plan_sql(within: bool) -> str:
    """The plan by recursion: a path of left (0) and right (1) for each box, C1 in two dimensions."""

    def cut(d: int) -> str:
        valley = f"f{d} + list_position(s{d}, list_min(s{d}))"
        third = f"(t{d} - f{d}) // 3"
        half = f"list_filter(range(f{d}, t{d}), lambda i: list_sum(list_slice(h{d}, f{d} + 1, i + 1)) >= n // 2)[1]"
        found = (
            f"CASE WHEN {valley} - 1 >= f{d} + {third} AND {valley} - 1 < t{d} - {third} THEN {valley} "
            f"ELSE coalesce({half}, (f{d} + t{d}) // 2 + 1) END"
        )
        return f"CASE WHEN t{d} - f{d} > 1 AND f{d} < {found} AND {found} < t{d} THEN {found} END AS c{d}"

    def spread(d: int) -> str:
        return f"list_sum(list_transform(s{d}, lambda x: (x - list_avg(s{d})) * (x - list_avg(s{d})))) / len(s{d}) AS v{d}"

    sizes = C1.params
    whole = "list_sum(CASE d WHEN 0 THEN s0 ELSE s1 END)" if within else "list_sum(CASE d WHEN 0 THEN h0 ELSE h1 END)"
    part = "list_sum(CASE d WHEN 0 THEN list_slice(h0, f0 + 1, c) ELSE list_slice(h1, f1 + 1, c) END)"
    left = f"CAST(trunc(CAST({part} AS DOUBLE) / greatest(CAST({whole} AS DOUBLE), 1) * n) AS BIGINT)"
    node = f"SELECT *, list_slice(h0, f0 + 1, t0) AS s0, list_slice(h1, f1 + 1, t1) AS s1 FROM tree, hist WHERE n > {sizes.max_partition_size}"
    cuts = f"SELECT *, {cut(0)}, {cut(1)}, {spread(0)}, {spread(1)} FROM ({node})"
    choice = f"SELECT *, CASE WHEN c0 IS NOT NULL AND (v0 >= v1 OR c1 IS NULL) THEN 0 WHEN c1 IS NOT NULL THEN 1 END AS d FROM ({cuts})"
    split = f"SELECT *, CASE d WHEN 0 THEN c0 ELSE c1 END AS c FROM ({choice}) WHERE d IS NOT NULL"
    ranges = ", ".join(
        f"CASE WHEN d = {d} AND side = '1' THEN c ELSE f{d} END, CASE WHEN d = {d} AND side = '0' THEN c ELSE t{d} END" for d in range(2)
    )
    tree = (
        f"tree(path, f0, t0, f1, t1, n) AS (SELECT '', 0::BIGINT, {sizes.buckets}::BIGINT, 0::BIGINT, {sizes.buckets}::BIGINT, (SELECT count(*) FROM pts) "
        f"UNION ALL SELECT path || side, {ranges}, CASE side WHEN '0' THEN l ELSE n - l END "
        f"FROM (SELECT *, {left} AS l FROM ({split})), (VALUES ('0'), ('1')) AS sides(side))"
    )
    edge = lambda d, k: f"e{d}.lower + (e{d}.upper - e{d}.lower) * {k}{d} / {sizes.buckets}"
    bounds = ", ".join(f"{edge(d, 'f')} AS lower{d}, {edge(d, 't')} AS upper{d}" for d in range(2))
    select = (
        f"SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS pid, n AS estimate, {bounds} FROM tree t "
        "JOIN edges e0 ON e0.dim = 0 JOIN edges e1 ON e1.dim = 1 WHERE NOT EXISTS (SELECT 1 FROM tree u WHERE u.path = t.path || '0')"
    )
    hist = "hist AS (SELECT list(n ORDER BY bucket) FILTER (dim = 0) AS h0, list(n ORDER BY bucket) FILTER (dim = 1) AS h1 FROM counts)"
    return C1.sql(select, C1.pts, _LONG, _EDGES, _COUNTS, hist, tree)


for _name, _within in (("plan_partitions", False), ("plan_partitions_within", True)):

    @_query(_name, _plan_sql(_within))
    def plan_partitions(spark, sf_dir, within=_within):
        plan = boxes.plan_partitions(C1.points(spark, sf_dir), C1.params, within)
        sides = [F.col("bounds")[i][side].alias(f"{side}{i}") for i in range(2) for side in ("lower", "upper")]
        return plan.select("pid", "estimate", *sides)


# --- neighbours and clusters

for _suffix, _w in (("", C5), ("_c6", C6)):

    @_query(f"pair_distance{_suffix}", _w.sql("SELECT id, nb AS neighbor, round(dist, 9) AS distance FROM near WHERE id < nb", _w.pts, _w.near))
    def pair_distance(spark, sf_dir, w=_w):
        return neighbors.pair_distance(w.points(spark, sf_dir), w.dims, w.eps)


for _suffix, _w in ((k, ALL[k]) for k in ("", "_c2", "_c3")):

    @_query(f"eps_neighbors{_suffix}", _w.sql("SELECT id, nb AS neighbor FROM near", _w.pts, _w.near))
    def eps_neighbors(spark, sf_dir, w=_w):
        return neighbors.eps_neighbors(w.points(spark, sf_dir), w.dims, w.eps)


@_query("neighbor_counts", C1.sql("SELECT p.id, count(n.nb) AS neighbors FROM pts p LEFT JOIN near n ON n.id = p.id GROUP BY p.id", C1.pts, C1.near))
def neighbor_counts(spark, sf_dir):
    return neighbors.neighbor_counts(C1.points(spark, sf_dir), C1.dims, C1.eps)


def _tagged(spark, sf_dir, w):
    return cluster.classified(w.points(spark, sf_dir), w.dims, w.params)


for _suffix, _w in ALL.items():

    @_query(f"core_points{_suffix}", _w.sql("SELECT id FROM cores", _w.pts, _w.near, _w.cores))
    def core_points(spark, sf_dir, w=_w):
        return cluster.core_points(w.points(spark, sf_dir), w.dims, w.params)


@_query(
    "border_points",
    C1.sql("SELECT DISTINCT id FROM near WHERE nb IN (SELECT id FROM cores) AND id NOT IN (SELECT id FROM cores)", C1.pts, C1.near, C1.cores),
)
def border_points(spark, sf_dir):
    return _tagged(spark, sf_dir, C1).where(F.col("tag") == cluster.BORDER).select("id")


for _suffix, _w in ((k, ALL[k]) for k in ("", "_c2", "_c3")):

    @_query(
        f"noise_points{_suffix}",
        _w.sql(
            "SELECT id FROM pts WHERE id NOT IN (SELECT id FROM cores) AND id NOT IN (SELECT id FROM near WHERE nb IN (SELECT id FROM cores))", _w.pts, _w.near, _w.cores
        ),
    )
    def noise_points(spark, sf_dir, w=_w):
        return _tagged(spark, sf_dir, w).where(F.col("tag") == cluster.NOISE).select("id")

    @_query(f"core_components{_suffix}", _w.sql("SELECT id, component FROM comp", _w.pts, _w.near, _w.cores, _w.labels))
    def core_components(spark, sf_dir, w=_w):
        return _tagged(spark, sf_dir, w).where(F.col("tag") == cluster.CORE).select("id", "component")

    @_query(f"cluster_points{_suffix}", _w.sql("SELECT id, cluster_id, v0, v1 FROM result", _w.pts, _w.near, _w.cores, _w.labels, _w.clusters))
    def cluster_points(spark, sf_dir, w=_w):
        return _flat(cluster.cluster_points(w.points(spark, sf_dir), w.params), w.dims, "id", "cluster_id")


@_query("cluster_points_partitioned", ORACLES["cluster_points"])
def cluster_points_partitioned(spark, sf_dir):
    return _flat(partitioned.cluster_by_partitions(C1.points(spark, sf_dir), C1.params), C1.dims, "id", "cluster_id")


def _islands(w: Workload) -> str:
    """In one dimension clusters are runs of sorted cores without a gap of eps."""
    return w.sql(
        "SELECT id, cluster_id, v0 FROM result",
        w.pts,
        w.near,
        w.cores,
        f"runs AS (SELECT p.id, CASE WHEN p.v0 - lag(p.v0) OVER o < {w.eps} THEN 0 ELSE 1 END AS fresh, p.v0 FROM pts p JOIN cores c ON c.id = p.id "
        "WINDOW o AS (ORDER BY p.v0, p.id)), "
        "isles AS (SELECT id, sum(fresh) OVER (ORDER BY v0, id ROWS UNBOUNDED PRECEDING) AS isle FROM runs), "
        "comp AS (SELECT id, min(id) OVER (PARTITION BY isle) AS component FROM isles)",
        w.clusters,
    )


for _suffix, _w in (("", C4), ("_c6", C6)):

    @_query(f"cluster_1d{_suffix}", _islands(_w))
    def cluster_1d(spark, sf_dir, w=_w):
        return _flat(cluster.cluster_points(w.points(spark, sf_dir), w.params), 1, "id", "cluster_id")


# --- box by box

_OWN_VIEW = f"SELECT pid, id FROM lnear GROUP BY pid, id HAVING count(*) >= {C1.min_pts}"
_HOME_VIEW = "SELECT a.pid, a.id FROM assigned a JOIN cores c ON c.id = a.id"


def _local_sql(cores: str) -> str:
    return (
        f"lnear AS (SELECT a.pid, a.id, b.id AS nb FROM assigned a JOIN assigned b ON a.pid = b.pid AND a.id <> b.id "
        f"WHERE sqrt((a.v0 - b.v0) * (a.v0 - b.v0) + (a.v1 - b.v1) * (a.v1 - b.v1)) < {C1.eps}), "
        f"lcores AS ({cores}), "
        "llinks AS (SELECT n.pid, n.id, n.nb FROM lnear n JOIN lcores a ON a.pid = n.pid AND a.id = n.id JOIN lcores b ON b.pid = n.pid AND b.id = n.nb), "
        "lreach(pid, id, label) AS (SELECT pid, id, id FROM lcores UNION SELECT r.pid, l.nb, r.label FROM lreach r JOIN llinks l ON l.pid = r.pid AND l.id = r.id WHERE r.label < l.nb), "
        "lcomp AS (SELECT pid, id, min(label) AS component FROM lreach GROUP BY pid, id), "
        "lnamed AS (SELECT pid, id, CAST(dense_rank() OVER (PARTITION BY pid ORDER BY component) - 1 AS INTEGER) AS local_id FROM lcomp), "
        "ledge AS (SELECT n.pid, n.id, min(c.local_id) AS local_id FROM lnear n JOIN lnamed c ON c.pid = n.pid AND c.id = n.nb "
        "LEFT JOIN lcores k ON k.pid = n.pid AND k.id = n.id WHERE k.id IS NULL GROUP BY n.pid, n.id), "
        "local AS (SELECT a.pid, a.id, CASE WHEN c.id IS NOT NULL THEN 'CORE' WHEN e.id IS NOT NULL THEN 'BORDER' ELSE 'NOISE' END AS tag, "
        "coalesce(c.local_id, e.local_id, -1) AS local_id FROM assigned a LEFT JOIN lnamed c ON c.pid = a.pid AND c.id = a.id LEFT JOIN ledge e ON e.pid = a.pid AND e.id = a.id)"
    )


_BOXED = (C1.pts, _BOX_SQL, _ASSIGNED, _local_sql(_OWN_VIEW))
_EXACT = (C1.pts, C1.near, C1.cores, _BOX_SQL, _ASSIGNED, _local_sql(_HOME_VIEW))
_SHARED = "a.id = b.id AND {} WHERE a.tag <> 'NOISE' AND b.tag <> 'NOISE' AND (a.tag = 'CORE' OR b.tag = 'CORE')"
_MERGED = (
    "refs AS (SELECT pid, local_id, min(id) AS first FROM local WHERE tag = 'CORE' GROUP BY pid, local_id), "
    f"ways AS (SELECT DISTINCT a.pid AS pid_a, a.local_id AS local_a, b.pid AS pid_b, b.local_id AS local_b FROM local a JOIN local b ON {_SHARED.format('a.pid <> b.pid')}), "
    "mreach(pid, local_id, label) AS (SELECT pid, local_id, first FROM refs UNION SELECT w.pid_b, w.local_b, r.label FROM mreach r "
    "JOIN ways w ON w.pid_a = r.pid AND w.local_a = r.local_id), "
    "merged AS (SELECT pid, local_id, min(label) AS component FROM mreach GROUP BY pid, local_id), "
    "named AS (SELECT pid, local_id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INTEGER) AS cluster_id FROM merged)"
)


def _local(spark, sf_dir, exact=False):
    return partitioned.local_clusters(_assigned(spark, sf_dir), C1.dims, C1.params, exact)


for _suffix, _parts in (("", _BOXED), ("_exact", _EXACT)):

    @_query(f"local_clusters{_suffix}", C1.sql("SELECT pid, id, tag, local_id FROM local", *_parts))
    def local_clusters(spark, sf_dir, exact=bool(_suffix)):
        return _local(spark, sf_dir, exact)


@_query("copy_pairs", C1.sql(f"SELECT a.id, a.pid AS pid_a, a.local_id AS local_a, b.pid AS pid_b, b.local_id AS local_b FROM local a JOIN local b ON {_SHARED.format('a.pid < b.pid')}", *_EXACT))
def copy_pairs(spark, sf_dir):
    return partitioned.copy_pairs(_local(spark, sf_dir, True))


def _map(local):
    return partitioned.cluster_map(local, partitioned.merge_edges(local))


@_query("cluster_map", C1.sql("SELECT pid, local_id, cluster_id FROM named", *_EXACT, _MERGED))
def cluster_map(spark, sf_dir):
    return _map(settled(_local(spark, sf_dir, True)))


@_query("relabel_points", C1.sql("SELECT l.id, coalesce(min(n.cluster_id), -1) AS cluster_id FROM local l LEFT JOIN named n ON n.pid = l.pid AND n.local_id = l.local_id GROUP BY l.id", *_EXACT, _MERGED))
def relabel_points(spark, sf_dir):
    local = settled(_local(spark, sf_dir, True))
    return partitioned.relabelled(local, _map(local))


@_query("cluster_refs", C1.sql("SELECT DISTINCT pid, local_id FROM local WHERE local_id >= 0", *_BOXED))
def cluster_refs(spark, sf_dir):
    return partitioned.cluster_refs(_local(spark, sf_dir))


@_query(
    "merge_edges",
    C1.sql(
        "SELECT DISTINCT a.pid AS pid_a, a.local_id AS local_a, b.pid AS pid_b, b.local_id AS local_b FROM local a JOIN local b ON a.id = b.id AND a.pid < b.pid "
        "WHERE a.tag <> 'NOISE' AND b.tag <> 'NOISE' AND (a.tag = 'CORE' OR b.tag = 'CORE')",
        *_BOXED,
    ),
)
def merge_edges(spark, sf_dir):
    return partitioned.merge_edges(_local(spark, sf_dir))


@_query("duplicate_ids", "SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return source.duplicate_ids(rows)


# --- derived from the result

_FULL = (C1.pts, C1.near, C1.cores, C1.labels, C1.clusters)


def _result(spark, sf_dir):
    return cluster.cluster_points(C1.points(spark, sf_dir), C1.params)


@_query("cluster_sizes", C1.sql("SELECT cluster_id, count(*) AS n FROM result GROUP BY cluster_id", *_FULL))
def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(_result(spark, sf_dir))


@_query(
    "cluster_centroids",
    C1.sql(
        "SELECT cluster_id, CAST(dim AS INTEGER) AS dim, round(avg(value), 6) AS mean, min(value) AS lower, max(value) AS upper FROM "
        "(SELECT cluster_id, 0 AS dim, v0 AS value FROM result UNION ALL SELECT cluster_id, 1, v1 FROM result) WHERE cluster_id >= 0 GROUP BY cluster_id, dim",
        *_FULL,
    ),
)
def cluster_centroids(spark, sf_dir):
    return cluster.cluster_centroids(_result(spark, sf_dir))


@_query(
    "cluster_boxes",
    C1.sql(
        "SELECT cluster_id, CAST(dim AS INTEGER) AS dim, count(*) AS n, min(value) AS lower, max(value) AS upper FROM "
        "(SELECT cluster_id, 0 AS dim, v0 AS value FROM result UNION ALL SELECT cluster_id, 1, v1 FROM result) WHERE cluster_id >= 0 GROUP BY cluster_id, dim",
        *_FULL,
    ),
)
def cluster_boxes(spark, sf_dir):
    return cluster.cluster_boxes(_result(spark, sf_dir))


@_query("result_lines", C1.sql("SELECT id || chr(9) || cluster_id || chr(9) || '[' || v0 || ', ' || v1 || ']' AS value FROM result", *_FULL))
def result_lines(spark, sf_dir):
    return source.result_lines(_result(spark, sf_dir))


@_query("noise_ratio", C1.sql("SELECT avg(CASE WHEN cluster_id = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS noise_ratio FROM result", *_FULL))
def noise_ratio(spark, sf_dir):
    return cluster.noise_ratio(_result(spark, sf_dir))
