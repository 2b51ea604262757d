"""Exact top-k search by inner product with cover trees over queries and data.

The data vectors are dealt to blocks of bounded size, and so are the queries: a vector goes to the
nearest of at most ``CENTRES`` centres, and a centre with many vectors is cut into several blocks. A block
of queries and one of data are searched by the traversal of two cover trees together. A pair of nodes is
pruned when its bound, the inner product of the two centres plus what the covering radii allow, is below
the worst kth score of the query group so far. The same bound prunes centres and blocks before any vector
is moved. The search has two rounds: first each query block with one block of the most promising centre,
which gives every query scores to beat; then with all blocks that may still hold something better.

Vectors that are NULL or empty, hold NULL or values that are not finite, or differ in length from the
usual one take no part, nor do rows without an id. Ties go to the smaller id. Rows that repeat an id are
candidates each for itself; of queries with one id one is asked. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.session import stored

#: Vectors in a block at most, and centres that vectors are dealt to.
BLOCK = 2048
CENTRES = 128
#: A node with at most this many points is searched whole.
LEAF = 256


@dataclass
class Tree:
    """A cover tree laid out flat: the points of a node are ``order[begin:end]``, its children are nodes."""

    points: np.ndarray
    order: np.ndarray
    begin: list[int]
    end: list[int]
    centre: list[int]
    radius: list[float]
    children: list[list[int]]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Each level halves the covering radius; a child's centre is at least that far from its siblings' centres."""
    tree = Tree(points, np.arange(len(points)), [], [], [], [], [])

    def node(begin: int, end: int, centre: int, distances: np.ndarray) -> int:
        number = len(tree.begin)
        radius = float(distances.max()) if len(distances) else 0.0
        tree.begin.append(begin)
        tree.end.append(end)
        tree.centre.append(centre)
        tree.radius.append(radius)
        tree.children.append([])
        todo.append((number, distances))
        return number

    todo: list[tuple[int, np.ndarray]] = []
    if len(points):
        node(0, len(points), 0, np.linalg.norm(points - points[0], axis=1))
    while todo:
        number, distances = todo.pop()
        begin, end, radius = tree.begin[number], tree.end[number], tree.radius[number]
        if end - begin <= leaf or radius == 0:
            continue
        own = tree.order[begin:end].copy()
        nearest, group, centres = distances.copy(), np.zeros(len(own), np.int64), [tree.centre[number]]
        while nearest.max() > radius / 2 and len(centres) < 64:
            far = int(own[nearest.argmax()])
            away = np.linalg.norm(points[own] - points[far], axis=1)
            closer = away < nearest
            group[closer], nearest[closer] = len(centres), away[closer]
            centres.append(far)
        if len(centres) == 1:
            continue
        sort = np.argsort(group, kind="stable")
        tree.order[begin:end] = own[sort]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(centres)))])
        for c, a, b in zip(centres, bounds, bounds[1:]):
            if b > a:
                tree.children[number].append(node(begin + int(a), begin + int(b), c, nearest[sort][a:b]))
    return tree


class Best:
    """The k best scores of each query of a block, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores = k, [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.worst = np.full(queries, -np.inf) if floor is None else floor.astype(float).copy()

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[best], ids[best]
        if len(best) == self.k:
            self.worst[query] = max(self.worst[query], float(scores[best[-1]]))


def search(queries: Tree, query_ids: np.ndarray, data: Tree, data_ids: np.ndarray, best: Best) -> None:
    """Traverse both trees together, the more promising node pairs first.

    The children of two nodes are bounded in one product of their centres. What is left of leaves below two nodes
    is scored in one product as well: a product for each small leaf took most of the time.
    """
    if not queries.begin or not data.begin:
        return
    sides = []
    for tree in (queries, data):
        centres = tree.points[tree.centre]
        sides.append((centres, np.linalg.norm(centres, axis=1), np.array(tree.radius), np.array([not c for c in tree.children])))
    (at_q, long_q, r, leaf_q), (at_d, long_d, s, leaf_d) = sides

    def bounds(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        return at_q[q] @ at_d[d].T + np.outer(long_q[q], s[d]) + np.outer(r[q], long_d[d]) + np.outer(r[q], s[d])

    def members(tree: Tree, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([tree.order[tree.begin[n] : tree.end[n]] for n in nodes.tolist()])

    def score(group: np.ndarray, some: np.ndarray) -> None:
        scores = queries.points[group] @ data.points[some].T
        fits = (scores >= best.worst[group][:, None]) & (data_ids[some][None, :] != query_ids[group][:, None])
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            best.offer(int(group[i]), scores[i, fits[i]].astype(np.int64), data_ids[some[fits[i]]])

    def least(nodes: np.ndarray) -> np.ndarray:
        return np.array([best.worst[queries.order[queries.begin[n] : queries.end[n]]].min() for n in nodes.tolist()])

    root = np.zeros(1, np.int64)
    stack = [(float(bounds(root, root)[0, 0]), 0, 0)]
    while stack:
        top, q, d = stack.pop()
        # A score equal to the worst may still win by its id; the slack covers rounding of the bound.
        if top + 1e-6 * (1 + abs(top)) < least(np.array([q]))[0]:
            continue
        qs, ds = (np.array(tree.children[n] or [n]) for tree, n in ((queries, q), (data, d)))
        upper = bounds(qs, ds)
        hopeful = upper + 1e-6 * (1 + np.abs(upper)) >= least(qs)[:, None]
        whole = np.outer(leaf_q[qs], leaf_d[ds])
        ready = hopeful & whole
        if ready.sum() > 0.5 * whole.sum():  # little is pruned: one product for all leaves here
            score(members(queries, qs[ready.any(axis=1)]), members(data, ds[ready.any(axis=0)]))
        else:
            for i in np.flatnonzero(ready.any(axis=1)).tolist():
                score(members(queries, qs[i : i + 1]), members(data, ds[ready[i]]))
        later = np.argwhere(hopeful & ~whole).tolist()
        stack += sorted((float(upper[i, j]), int(qs[i]), int(ds[j])) for i, j in later)


def _usable(vector) -> object:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(vector: str):
    """Each component times 256, rounded down, as a double; NULL where a vector takes no part."""
    return F.when(_usable(vector), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _dealt(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Blocks of at most ``BLOCK`` vectors near one centre: a row per block with its vectors, centre and radius."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (sent.value**2).sum(axis=1)
        for batch in batches:
            points = _matrix(batch.column("v"))
            near = (squares - 2 * points @ sent.value.T).argmin(axis=1) if len(points) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32))], ["id", "v", "centre"])

    dealt = stored(df.mapInArrow(nearest, "id long, v array<double>, centre int")).read(spark)
    # A centre with many vectors is cut by hash, so that no block grows with the data.
    many = dealt.groupBy("centre").count()
    parts = many.select("centre", F.ceil(F.col("count") / (BLOCK / 2)).cast("int").alias("parts"))
    cut = dealt.join(F.broadcast(parts), "centre").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return cut.groupBy("centre", "part").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("members"))


def _with_ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, vectors = batch.column("members").slice(i, 1).flatten().flatten()
            points = _matrix(vectors)
            middle = points.mean(axis=0)
            radius = float(np.linalg.norm(points - middle, axis=1).max())
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("centre")[i].as_py()], pa.int32()), pa.array([batch.column("part")[i].as_py()], pa.int32()), pa.array([middle.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([len(points)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, points.size], pa.int32()), pa.array(points.reshape(-1)))],
                ["centre", "part", "middle", "radius", "n", "ids", "flat"],
            )


BALLS = "centre int, part int, middle array<double>, radius double, n long, ids array<long>, flat array<double>"


def _searched(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of each row's block of queries in its block of data; the rows of a block of data follow each other."""
    known: dict[str, tuple[object, np.ndarray, Tree]] = {}

    def planted(batch: pa.RecordBatch, i: int, side: str) -> tuple[object, np.ndarray, Tree]:
        """A row's block: ids and tree, which stays for the next row of the same block."""
        name = tuple(batch.column(f"{side}_{c}")[i].as_py() for c in ("centre", "part"))
        if side not in known or known[side][0] != name:
            ids = batch.column(f"{side}_ids").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
            points = batch.column(f"{side}_flat").slice(i, 1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            known[side] = (name, ids, build(points))
        return known[side]

    for batch in batches:
        for i in range(batch.num_rows):
            (_, q_ids, q), (_, d_ids, d) = (planted(batch, i, side) for side in "qd")
            floor = batch.column("floor")[i].as_py()
            best = Best(len(q_ids), k, None if floor is None else np.array(floor, float))
            search(q, q_ids, d, d_ids, best)
            n = [len(s) for s in best.scores]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns query_id, rank, ``key`` and score: each query's k best by the inner product of whole-number
    vectors, every row but the query's own being a candidate."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), whole_numbers(vector).alias("v")).filter("id is not null and v is not null")

    data, asked = usable(vectors), usable(queries)
    usual = data.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    if usual is None:
        return empty
    data, asked = (df.filter(F.size("v") == usual["n"]) for df in (data, asked))
    asked = asked.dropDuplicates(["id"])
    n_data, n_asked = data.count(), asked.count()
    if not n_asked:
        return empty
    drawn = np.array([r["v"] for r in data.orderBy(F.xxhash64("id"), "id").limit(CENTRES).collect()])
    enough = lambda n, size: drawn[: max(1, -(-n // size))]
    blocks = stored(_dealt(data, enough(n_data, BLOCK // 4)).mapInArrow(_with_ball, BALLS)).read(spark)
    groups = stored(_dealt(asked, enough(n_asked, BLOCK // 2)).mapInArrow(_with_ball, BALLS)).read(spark)
    q = groups.select(*[F.col(c).alias(f"q_{c}") for c in groups.columns])
    d = blocks.select(*[F.col(c).alias(f"d_{c}") for c in blocks.columns])
    # One ball around all blocks of a centre; at most CENTRES of them.
    away = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    middles = blocks.groupBy("centre").agg(F.min_by("middle", "part").alias("m"))  # few ids may leave part 0 empty
    balls = blocks.join(F.broadcast(middles), "centre", "left").groupBy("centre").agg(F.first("m").alias("middle"), F.max(away(F.col("middle"), F.col("m")) + F.col("radius")).alias("radius"))
    balls = balls.withColumnRenamed("centre", "d_centre")
    pairs = q.select("q_centre", "q_part", "q_middle", "q_radius").crossJoin(F.broadcast(balls))
    pairs = stored(pairs.select("q_centre", "q_part", "d_centre", _upper("q_middle", "q_radius", "middle", "radius").alias("upper"))).read(spark)
    schema = "query_id long, id long, score long"

    def searched(chosen: DataFrame) -> DataFrame:
        """``chosen`` names blocks and the scores to beat; their vectors are joined to it."""
        whole = chosen.join(q.select("q_centre", "q_part", "q_ids", "q_flat"), ["q_centre", "q_part"])
        whole = whole.join(d.select("d_centre", "d_part", "d_ids", "d_flat"), ["d_centre", "d_part"])
        # A block of data goes to one task, which builds its tree once; it holds BLOCK vectors at most.
        spread = whole.repartition("d_centre", "d_part").sortWithinPartitions("d_centre", "d_part")
        return spread.mapInArrow(lambda b: _searched(k, b), schema)

    pick = pairs.groupBy("q_centre", "q_part").agg(F.max_by("d_centre", "upper").alias("d_centre"))
    pick = pick.withColumn("d_part", F.lit(0)).withColumn("floor", F.lit(None).cast("array<double>"))
    pick = stored(pick.join(d.select("d_centre", "d_part"), ["d_centre", "d_part"], "left_semi")).read(spark)
    begun = stored(searched(pick)).read(spark)
    worst = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    floors = q.select("q_centre", "q_part", F.posexplode("q_ids").alias("at", "query_id")).join(worst, "query_id", "left")
    beat = F.coalesce(F.col("worst").cast("double"), F.lit(float("-inf")))
    floors = floors.groupBy("q_centre", "q_part").agg(F.sort_array(F.collect_list(F.struct("at", beat.alias("w")))).alias("f"))
    floors = floors.select("q_centre", "q_part", F.col("f.w").alias("floor"), F.array_min("f.w").alias("least"))
    hopeful = F.col("upper") + 1e-6 * (1 + F.abs("upper")) >= F.col("least")
    left = pairs.join(floors, ["q_centre", "q_part"]).filter(hopeful).drop("upper")
    left = left.join(q.select("q_centre", "q_part", "q_middle", "q_radius"), ["q_centre", "q_part"]).join(d.select("d_centre", "d_part", "d_middle", "d_radius"), "d_centre")
    left = left.withColumn("upper", _upper("q_middle", "q_radius", "d_middle", "d_radius")).filter(hopeful)
    left = left.join(pick.select("q_centre", "q_part", "d_centre", "d_part"), ["q_centre", "q_part", "d_centre", "d_part"], "left_anti")
    later = searched(left.select("q_centre", "q_part", "d_centre", "d_part", "floor"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = begun.unionByName(later).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _upper(a: str, r: str, b: str, s: str):
    """No vector of the ball (a, r) has a larger inner product with one of the ball (b, s)."""
    length = lambda x: F.sqrt(_dot(x, x))
    return _dot(a, b) + length(a) * F.col(s) + length(b) * F.col(r) + F.col(r) * F.col(s)
