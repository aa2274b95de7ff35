"""Operator 13: centroid clustering filtered by ball trees over each task's vectors, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Components of a vector, their scale, centroids, rounds, and what the seeds of the first centroids begin with.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3:"
#: Vectors of a tree, and of a leaf that is not cut further.
TREE, LEAF = 8192, 64
#: Largest component after scaling: squared distances of 64 of them, twice as far apart, fit a long.
MOST = 1 << 27
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
NODES = "sums binary, counts binary, centres binary, radii binary, starts binary, left_ binary, right_ binary"


def ball_tree(points) -> tuple:
    """``(order, sums, counts, centres, radii, starts, left, right)`` of a metric tree over integer vectors.

    A node is a run of ``order`` with its integer sum, its count and the radius around its mean that holds all its vectors.
    A node of more than ``LEAF`` vectors that are not all equal is cut along the line between two of its far vectors, in the
    middle of the line, or in halves if a side would have less than a sixteenth; a leaf has the children -1.
    """
    import numpy as np

    order = np.arange(len(points))
    sums, counts, centres, radii, starts, left, right = [], [], [], [], [], [], []

    def node(s: int, e: int) -> int:
        p = points[order[s:e]]
        total = p.sum(axis=0)
        centre = total / (e - s)
        far = np.sqrt(((p - centre) ** 2).sum(axis=1))
        for held, value in ((sums, total), (counts, e - s), (centres, centre), (radii, far.max() * (1 + 1e-9)), (starts, s), (left, -1), (right, -1)):
            held.append(value)
        return len(counts) - 1, p, far

    todo = [node(0, len(points))]
    while todo:
        k, p, far = todo.pop()
        n, s = counts[k], starts[k]
        if n <= LEAF or (p == p[0]).all():
            continue
        a = p[far.argmax()]
        b = p[((p - a) ** 2).sum(axis=1).argmax()]
        along = p @ (b - a).astype(np.float64)
        cutting = np.argsort(along, kind="stable")
        order[s : s + n] = order[s : s + n][cutting]
        half = int((along < (along.min() + along.max()) / 2).sum())
        half = half if n // 16 <= half <= n - n // 16 and half else n // 2
        left_, right_ = node(s, s + half), node(s + half, s + n)
        left[k], right[k] = left_[0], right_[0]
        todo += [left_, right_]
    return order, np.array(sums, np.int64), np.array(counts, np.int64), np.array(centres), np.array(radii), np.array(starts, np.int64), np.array(left, np.int64), np.array(right, np.int64)


def filtered(tree: dict, centroids) -> Iterator[tuple]:
    """``(cluster, nodes, rows)``: for each centroid the balls that are its own as a whole, and single vectors of other leaves.

    A ball goes whole to a centroid if no other can be as near to any of its vectors: by the triangle inequality, if the
    nearest point that the ball may have for another is farther than the farthest for this one. All others are cut open;
    vectors of open leaves are compared exactly with the centroids that the leaf leaves over, equal distances going to the
    smaller number.
    """
    import numpy as np

    near = centroids.astype(np.float64)
    k = len(centroids)
    whole, owners, rows, fits = [], [], [], []
    level = np.zeros(1, np.int64)
    while len(level):
        d = np.sqrt(((tree["centres"][level][:, None, :] - near[None]) ** 2).sum(axis=2))
        r = tree["radii"][level][:, None]
        limit = (d + r).min(axis=1, keepdims=True)
        left_over = d - r <= limit * (1 + 1e-9) + 1e-6
        alone = left_over.sum(axis=1) == 1
        whole.append(level[alone])
        owners.append(left_over[alone].argmax(axis=1))
        leaf = ~alone & (tree["left"][level] < 0)
        for at in np.flatnonzero(leaf):
            n = tree["counts"][level[at]]
            rows.append(tree["starts"][level[at]] + np.arange(n))
            fits.append(np.broadcast_to(left_over[at], (n, k)))
        deeper = level[~alone & ~leaf]
        level = np.concatenate([tree["left"][deeper], tree["right"][deeper]])
    whole, owners = np.concatenate(whole), np.concatenate(owners)
    chosen = np.zeros(0, np.int64)
    if rows:
        rows, fits = np.concatenate(rows), np.concatenate(fits)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        chosen = np.full(len(rows), -1)
        for c in range(k):
            some = np.flatnonzero(fits[:, c])
            distance = ((tree["points"][rows[some]] - centroids[c]) ** 2).sum(axis=1)
            nearer = (distance < best[some]) | (chosen[some] < 0)
            best[some[nearer]], chosen[some[nearer]] = distance[nearer], c
    else:
        rows = chosen
    for c in range(k):
        yield c, whole[owners == c], rows[chosen == c]


def _opened(row: dict) -> dict:
    import numpy as np

    n = len(row["counts"]) // 8
    long = {c: np.frombuffer(row[c], np.int64) for c in ("counts", "starts", "left_", "right_")}
    points = np.frombuffer(row["points"], np.int32).reshape(len(row["ids"]), -1).astype(np.int64)
    return {"points": points, "counts": long["counts"], "starts": long["starts"], "left": long["left_"], "right": long["right_"], "sums": np.frombuffer(row["sums"], np.int64).reshape(n, -1), "centres": np.frombuffer(row["centres"]).reshape(n, -1), "radii": np.frombuffer(row["radii"])}


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """``(vec_id, v)`` of vectors with exactly ``dimensions`` finite components; ``v`` holds ``floor(SCALE * x)``."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dimensions) & finite)
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(SCALE)) * c)).alias("v"))


def planted_trees(vectors: DataFrame, size: int = TREE) -> DataFrame:
    """A written table with a row for each ball tree over ``size`` of a partition's vectors, in its own order."""
    import numpy as np
    import pyarrow as pa

    def plant(ids: list, points) -> pa.RecordBatch:
        if np.abs(points).max() > MOST:
            raise ValueError(f"a component is larger than {MOST} after scaling; squared distances would not fit a long")
        order, *nodes = ball_tree(points)
        sums, counts, centres, radii, starts, left, right = (np.ascontiguousarray(x).tobytes() for x in nodes)
        cols = {"ids": [[ids[i] for i in order]], "points": [points[order].astype(np.int32).tobytes()], "sums": [sums], "counts": [counts], "centres": [centres], "radii": [radii], "starts": [starts], "left_": [left], "right_": [right]}
        return pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int64()) if c == "ids" else pa.binary()) for c, v in cols.items()], names=list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for b in batches:
            for s in range(0, b.num_rows, size):
                some = b.slice(s, size)
                ids += some.column(0).to_pylist()
                parts.append(np.asarray(some.column(1).flatten()).reshape(some.num_rows, -1))
                n += some.num_rows
                while n >= size:
                    points = np.concatenate(parts)
                    yield plant(ids[:size], points[:size])
                    ids, parts, n = ids[size:], [points[size:]], n - size
        if n:
            yield plant(ids, np.concatenate(parts))

    return cut(vectors.mapInArrow(run, f"ids array<long>, points binary, {NODES}"))


def moved(trees: DataFrame, centroids: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The centroids after one round: the floor of the mean of their vectors, themselves if they have none.

    A task adds up integer sums of whole balls and of single vectors; only sums by centroid and component are gathered.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(centroids, np.int64)
        sums, counts = np.zeros(points.shape, np.int64), np.zeros(len(points), np.int64)
        for b in batches:
            for row in b.to_pylist():
                tree = _opened(row)
                for c, balls, single in filtered(tree, points):
                    sums[c] += tree["sums"][balls].sum(axis=0) + tree["points"][single].sum(axis=0)
                    counts[c] += tree["counts"][balls].sum() + len(single)
        some = np.flatnonzero(counts)
        width = points.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width)), pa.array(np.tile(np.arange(width), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], width))], names=["c", "i", "s", "n"])

    exact = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).alias(x)
    now = [list(c) for c in centroids]
    for r in trees.mapInArrow(run, "c long, i long, s long, n long").groupBy("c", "i").agg(exact("s"), exact("n")).collect():
        now[r.c][r.i] = int(r.s) // int(r.n)
    return [tuple(c) for c in now]


def assigned(trees: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector of the trees; balls that are one centroid's are not compared with others."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(centroids, np.int64)
        for b in batches:
            for row in b.to_pylist():
                tree = _opened(row)
                cluster = np.zeros(len(row["ids"]), np.int32)
                for c, balls, single in filtered(tree, points):
                    cluster[single] = c
                    for k in balls:
                        cluster[tree["starts"][k] : tree["starts"][k] + tree["counts"][k]] = c
                distance = ((tree["points"] - points[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def ball_clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, size: int = TREE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that is kept.

    Vectors of another length, null ones and such with null or non-finite components are left out, an empty table gives no
    rows, and fewer than ``k`` kept vectors give as many centroids. Equal distances go to the smaller number. The first
    centroids are the vectors with the smallest seeded digests of their ids; rows with one id are ordered by their
    components, a null id comes after all others. Repeated rows count and are returned as often as they stand; other columns
    are ignored. Components beyond 2**27 after scaling end the job: their squared distances would not fit a long. The rounds
    stop when no centroid moves, as all further ones would change nothing.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, dimensions)
    seeded = vectors.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    centroids = [tuple(map(int, r.v)) for r in seeded.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], OUT)
    trees = planted_trees(vectors, size)
    for _ in range(rounds):
        now = moved(trees, centroids)
        if now == centroids:
            break
        centroids = now
    found = cut(assigned(trees, centroids))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    per = spark.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), digest(v)) for c, v in enumerate(centroids)], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), F.col("cluster") == F.col("c")).drop("c")


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster after ten rounds, in exact integers; edge cases as ``ball_clusters``."""
    return ball_clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"
    nearest = lambda r: f"a{r} AS MATERIALIZED (SELECT k.id, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(d := {square}, c := c.c)) AS near FROM kept k, c{r} c GROUP BY k.id)"
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    step = lambda r: (
        f"m{r} AS (SELECT c, list({floor} ORDER BY i) AS v FROM (SELECT near.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),\n"
        f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)"
    )
    kept = f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {DIMENSIONS} AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false))"""
    first = f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS INT) AS c, v FROM kept QUALIFY c < {CENTROIDS})"
    parts = [kept, first, *(f"{nearest(r)},\n{step(r)}" for r in range(ROUNDS)), nearest(ROUNDS)]
    return f"""WITH {",\n".join(parts)} SELECT vec_id, near.c AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} z ON z.c = near.c"""


OP13_SQL = _sql()
