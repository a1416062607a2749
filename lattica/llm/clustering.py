"""Centroid clustering in whole numbers with adaptive distance bounds.

Each vector keeps an upper bound on the distance to its centroid, lower bounds on the distances to several of the next
nearest centroids, and one lower bound on those to all the rest. Centroids move, bounds shift by how far; a vector is
compared again only with those centroids that its bounds leave in question, with all of them if the last bound does. How
many bounds are kept falls to what the last round needed. Bounds only say what need not be computed: distances that
decide are squared whole numbers without rounding.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, table

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Bounds give away so much of themselves at each step, which is far more than rounding takes.
SLACK = 1e-12
#: Sums cross Spark as digits of so many bits, each in a row of its own, so that they are exact at any size of components.
DIGIT, DIGITS = 30, 80
#: Vectors that are compared at once.
AT_ONCE = 4096


def _floored(v: Column) -> Column:
    # a double from 2^53 on is whole; the cast to long is for those below
    return F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly so many components, none of them null or, scaled, not finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double") * scale).alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == dimensions) & finite).select("vec_id", F.transform("v", _floored).alias("v"))


def fits(most: float, terms: int) -> bool:
    """Sums of so many products of whole numbers of this size are exact in a double."""
    return 4 * terms * most * most < 1 << 53


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances without rounding, of vectors of whole doubles and centroids of Python integers: by a matrix
    product while all terms fit a double, else in Python's integers."""
    most = max(np.abs(vectors).max(initial=0), max(map(abs, centroids.ravel()), default=0))
    if fits(most, vectors.shape[1]):
        c = centroids.astype(np.float64)
        return ((vectors * vectors).sum(1)[:, None] - 2 * (vectors @ c.T) + (c * c).sum(1)).astype(np.int64)
    v = np.array([int(x) for x in vectors.ravel().tolist()], object).reshape(vectors.shape)
    return ((v[:, None, :] - centroids[None, :, :]) ** 2).sum(2)


def roots(d: np.ndarray) -> np.ndarray:
    """Square roots, right to a few units in the last place; infinite past the range of doubles."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))

    def one(x: int) -> float:
        if x < 1 << 1000:
            return math.sqrt(x)
        root = math.isqrt(x)
        return float(root) if root < 1 << 1023 else math.inf

    return np.array([one(int(x)) for x in d.ravel()], np.float64).reshape(d.shape)


@dataclass
class Bounds:
    """Of vectors: near (their centroid, then the next nearest in order), upper, lower (of near[:, 1:]), rest (of all others)."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def ordered(d: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distances and centroid numbers, rising; of equal distances the smaller number comes first."""
    by_name = np.argsort(names, axis=1)
    d, names = np.take_along_axis(d, by_name, 1), np.take_along_axis(names, by_name, 1)
    by_size = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(d, by_size, 1), np.take_along_axis(names, by_size, 1)


def scan(vectors: np.ndarray, centroids: np.ndarray, kept: int) -> Bounds:
    """Bounds with `kept` lower ones, by comparing with every centroid."""
    k = len(centroids)
    d, names = ordered(squares(vectors, centroids), np.broadcast_to(np.arange(k), (len(vectors), k)))
    r = roots(d)
    rest = r[:, kept + 1] if kept + 1 < k else np.full(len(vectors), np.inf)
    return Bounds(names[:, : kept + 1].astype(np.int32), r[:, 0] * (1 + SLACK), r[:, 1 : kept + 1] * (1 - SLACK), rest * (1 - SLACK))


def shifted(b: Bounds, moved: np.ndarray, kept: int) -> Bounds:
    """Bounds after the centroids moved so far, cut to `kept` lower ones: those cut off go into the last."""
    with np.errstate(invalid="ignore"):
        lower = b.lower * (1 - SLACK) - moved[b.near[:, 1:]] * (1 + SLACK)
        rest = b.rest * (1 - SLACK) - moved.max(initial=0) * (1 + SLACK)
    upper = b.upper * (1 + SLACK) + moved[b.near[:, 0]] * (1 + SLACK)
    rest = np.minimum(rest, lower[:, kept:].min(axis=1, initial=np.inf))
    return Bounds(b.near[:, : kept + 1], upper, lower[:, :kept], rest)


def reassign(vectors: np.ndarray, centroids: np.ndarray, b: Bounds, work: np.ndarray) -> Bounds:
    """Bounds whose first centroid is the nearest, exactly. work counts (distances computed, deepest bound needed).

    The bounds from a place on are certified if the least of them is over the upper bound; the centroids before that
    place, and the vector's own, are compared and put in order. If the last bound isn't certified, all are compared.
    """
    kept, n = b.lower.shape[1], len(vectors)
    near, upper, lower, rest = b.near.copy(), b.upper.copy(), b.lower.copy(), b.rest.copy()

    def depth(of: np.ndarray) -> np.ndarray:
        """How many of the stored bounds are needed; one more than are stored if the last isn't certified."""
        tails = np.minimum.accumulate(np.concatenate([lower[of], rest[of, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        return (~(tails > upper[of, None])).sum(1)  # what isn't a number certifies nothing

    every = np.arange(n)
    loose = every[depth(every) > 0]
    # the distance to the own centroid, computed anew, may settle it
    if len(loose):
        for c in np.unique(near[loose, 0]):
            at = loose[near[loose, 0] == c]
            upper[at] = roots(squares(vectors[at], centroids[c : c + 1])[:, 0]) * (1 + SLACK)
        work[0] += len(loose)
        need = depth(loose)
        for j in range(1, kept + 1):
            at = loose[need == j]
            if len(at):
                names = near[at, : j + 1]
                d = np.take_along_axis(squares(vectors[at], centroids), names.astype(np.int64), 1)
                d, names = ordered(d, names)
                r = roots(d)
                near[at, : j + 1], upper[at], lower[at, :j] = names, r[:, 0] * (1 + SLACK), r[:, 1:] * (1 - SLACK)
                work[0] += len(at) * j
        at = loose[need > kept]
        if len(at):
            s = scan(vectors[at], centroids, kept)
            near[at], upper[at], lower[at], rest[at] = s.near, s.upper, s.lower, s.rest
            work[0] += len(at) * len(centroids)
        work[1] = max(work[1], min(kept, need.max(initial=0)))
    return Bounds(near, upper, lower, rest)


class Totals:
    """Exact sums of a task: of each cluster's components, vectors and distances, and of the work done."""

    def __init__(self, k: int, dimensions: int):
        self.of = np.full((k, dimensions + 2), 0, object)
        self.work = np.zeros(2, np.int64)

    def add(self, vectors: np.ndarray, cluster: np.ndarray, distance: np.ndarray | None = None) -> None:
        exact = len(vectors) * np.abs(vectors).max(initial=0) < 1 << 53
        for c in np.unique(cluster):
            at = cluster == c
            own = vectors[at]
            sums = own.sum(0).tolist() if exact else [sum(map(int, x)) for x in own.T.tolist()]
            self.of[c] += np.array([*map(int, sums), len(own), 0 if distance is None else sum(distance[at].tolist())], object)

    def rows(self) -> Iterator[tuple[int, int]]:
        """(key, value) of each digit that isn't zero; keys count clusters, then sums, then digits."""
        for at, total in enumerate(self.of.ravel().tolist()):
            sign, total, digit = (-1 if total < 0 else 1), abs(total), 0
            while total:
                if total & ((1 << DIGIT) - 1):
                    yield at * DIGITS + digit, sign * (total & ((1 << DIGIT) - 1))
                total, digit = total >> DIGIT, digit + 1

    @staticmethod
    def gathered(table: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums over all tasks, and (distances computed, deepest bound needed). A row per digit of k x (dimensions + 2)
        sums comes to the driver, whatever the number of vectors."""
        sums = table.where("keys is not null").select(F.explode(F.arrays_zip("keys", "sums")).alias("x")).groupBy("x.keys").agg(F.sum("x.sums").alias("n"), F.max("x.sums").alias("most")).collect()
        of, work = np.full(k * (dimensions + 2), 0, object), np.zeros(2, np.int64)
        for r in sums:
            if r["keys"] < 0:
                work[-1 - r["keys"]] = r["n"] if r["keys"] == -1 else r["most"]
            else:
                of[r["keys"] // DIGITS] += r["n"] << (DIGIT * (r["keys"] % DIGITS))
        return of.reshape(k, dimensions + 2), work


STATE = "vec_id long, v array<double>, near array<int>, upper double, lower array<double>, rest double, keys array<long>, sums array<long>"
FOUND = "vec_id long, cluster int, distance long, keys array<long>, sums array<long>"


def assigned(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, kept: int, last: bool) -> DataFrame:
    """The rows (vec_id, v[, bounds]) with bounds for these centroids, or, at last, with cluster and distance; each task adds
    a row of its sums. moved: how far each centroid went since the bounds were made, None to compare with all."""
    k, dimensions = centroids.shape

    def run(batches):
        import pyarrow as pa

        totals = Totals(k, dimensions)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
        none = lambda n: [pa.nulls(n, pa.list_(pa.int64()))] * 2
        for whole in batches:
            for begin in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(begin, AT_ONCE)
                n = batch.num_rows
                flat = lambda x: batch.column(x).flatten().to_numpy().reshape(n, -1)  # noqa: E731, B023
                vectors = flat("v")
                if moved is None:
                    b = scan(vectors, centroids, kept)
                    totals.work[:] = totals.work[0] + n * k, kept
                else:
                    b = Bounds(flat("near"), batch.column("upper").to_numpy(), flat("lower"), batch.column("rest").to_numpy())
                    b = reassign(vectors, centroids, shifted(b, moved, kept), totals.work)
                if last:
                    d = np.zeros(n, object)
                    for c in np.unique(b.near[:, 0]):
                        at = b.near[:, 0] == c
                        d[at] = [int(x) for x in squares(vectors[at], centroids[c : c + 1])[:, 0].tolist()]
                    totals.add(vectors, b.near[:, 0], d)
                    found = [pa.array(b.near[:, 0]), pa.array([as_long(x) for x in d], pa.int64())]
                else:
                    totals.add(vectors, b.near[:, 0])
                    found = [batch.column("v"), lists(b.near), pa.array(b.upper), lists(b.lower), pa.array(b.rest)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *found, *none(n)], names=names)
        keys, sums = zip(*totals.rows(), (-1, int(totals.work[0])), (-2, int(totals.work[1])))
        kinds = [(x.split()[1], x.split()[0]) for x in (FOUND if last else STATE).split(", ")[:-2]]
        arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, arrow[kind]) for kind, _ in kinds), pa.array([keys], pa.list_(pa.int64())), pa.array([sums], pa.list_(pa.int64()))], names=names)

    names = [x.split()[0] for x in (FOUND if last else STATE).split(", ")]
    return rows.mapInArrow(run, FOUND if last else STATE)


def as_long(x: int) -> int | None:
    return x if x < 1 << 63 else None


@dataclass
class Clustering:
    """rows: (vec_id, cluster, distance), a row per kept vector. centroids: whole numbers, a row per cluster. inertia: of each
    cluster. work: for each round the distances computed and the bounds kept."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    work: list[tuple[int, int]]


def cluster(vectors: DataFrame, scratch: Scratch, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Lloyd rounds from the k kept vectors of least hash, then one more assignment.

    Kept are vectors of exactly so many components, none null, and none that isn't finite after scaling. Repeated rows count
    each; a vector without id is clustered but never starts a centroid. Fewer than k kept vectors make fewer centroids,
    none an empty result. Ties go to the smaller centroid, empty centroids stay. A distance past the range of a long is
    null. Other columns are not read.

    A round reads the table of the one before, with vectors and bounds side by side, and writes the next one to the shared
    folder; nothing is shuffled but sums, so that a cluster or a vector that most rows have costs no more than others. A
    lost executor's part of a round is computed again from the round before.
    """
    rows = kept_vectors(vectors, id_col, vector_col, dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.where("vec_id is not null").orderBy(order, "v").limit(k).collect()
    if not seeds:
        return Clustering(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.zeros((0, dimensions), object), [], [])
    centroids = np.array([[int(x) for x in r["v"]] for r in seeds], object).reshape(len(seeds), dimensions)
    most, least = min(len(seeds) - 1, max(3, k // 4)), min(len(seeds) - 1, max(2, k // 8))
    kept, moved, before, work = most, None, None, []
    for number in range(rounds + 1):
        last = number == rounds
        made = scratch.put(assigned(rows, centroids, moved, kept, last))
        sums, done = Totals.gathered(made, *centroids.shape)
        work.append((int(done[0]), kept))
        if before is not None:
            scratch.drop(before)
        before, rows = made, made.where("keys is null")
        if last:
            break
        following = centroids.copy()
        for c, total in enumerate(sums):
            if total[dimensions]:
                following[c] = [x // total[dimensions] for x in total[:dimensions]]
        moved = roots(((following - centroids) ** 2).sum(1)) * (1 + SLACK)
        kept = max(least, int(done[1])) if number else kept
        centroids = following
    return Clustering(rows.select("vec_id", "cluster", "distance"), centroids, [int(x) for x in sums[:, dimensions + 1]], work)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "clustering"))
    whole = as_long(sum(found.inertia))
    about = [(c, as_long(x), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, (x, row) in enumerate(zip(found.inertia, found.centroids.tolist()))]
    # a row per cluster
    of = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.rows.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Plain rounds: every distance of every vector, by components."""
    steps = [
        f"n AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        "p AS MATERIALIZED (SELECT row, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM n)",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), v) - 1 AS c FROM n WHERE vec_id IS NOT NULL QUALIFY c < {K})",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM s)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT row, c, sum((p.x - k.x) * (p.x - k.x))::BIGINT AS d FROM p JOIN c{r} k USING (pos) GROUP BY row, c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := c)) AS best FROM d{r} GROUP BY row)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT a.best.c AS c, pos, sum(x) AS s, count(*) AS n FROM a{r} a JOIN p USING (row) GROUP BY 1, 2)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, k.pos, CASE WHEN m.n IS NULL THEN k.x ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS x FROM c{r} k LEFT JOIN m{r} m ON k.c = m.c AND k.pos = m.pos)")
    final = f"a{ROUNDS}"
    steps.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT n.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM {final} a JOIN n USING (row) JOIN h ON h.c = a.best.c"""


OP11_SQL = _sql()
