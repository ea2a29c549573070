"""Centroid clustering by exponion search, exact in whole numbers.

A vector is kept if it has exactly ``WIDTH`` components, none null or non-finite;
each component x becomes floor(64 * x). The first centroids are the kept vectors
with the smallest hashes of their ids. A round assigns every vector to its nearest
centroid (the smaller number among equals) and moves each centroid to the floor of
the mean of its vectors; a centroid without vectors stays where it is.

Every vector carries an upper bound of the distance to its centroid and a lower
bound of the distance to any other. When centroids have moved by no more than the
bounds allow, nothing is computed. Otherwise the distance to its own centroid is
found anew, and if that does not settle it, only centroids are scanned that lie in
the ball of radius twice that distance plus the gap to the nearest other centroid,
read off a list of the other centroids sorted by their distance. The radius is
inclusive and the bounds are rounded outwards, so equal distances are always seen;
comparisons that decide are between whole squares.

The state (vector, cluster, bounds) is cut to the shared folder once a round, and
only ``k`` sums of components come to the driver. Sums are combined in each task,
so one very common vector is no hot key.

Defined results: components beyond ``REACH`` in size count as ``REACH``, which keeps
squares in 64 bits; rows that repeat a vec_id are vectors of their own, in the order of
their components where the first centroids are chosen; a null vec_id hashes as the
empty text; with fewer than ``k`` kept vectors each is a centroid; without any the
result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import cut, pick

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Greatest size of a component; the square of a distance between two vectors of such components is below 2^63.
REACH = 1 << 26
#: Relative width by which bounds are rounded outwards; far above the error of a few operations on doubles.
SLACK = 1e-9

STATE = "vec_id {}, v array<int>, cluster int, upper double, lower double, square long"


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (whole components) of the rows that take part."""
    fits = (F.size("embedding") == WIDTH) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    limit = lambda x: F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), F.lit(float(SCALE)) * x.cast("double")))
    whole = F.transform("embedding", lambda x: F.floor(limit(x)).cast("int"))
    return pick(embeddings, "vec_id", "embedding").where(fits).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order."""
    draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.select(draw.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64).reshape(-1, WIDTH)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from those of ``c``; through doubles where these hold every sum exactly."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 21:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def _two_nearest(found: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and square of the nearest column (the smallest number among equals) and the square of the nearest other."""
    best = found.min(axis=1)
    ties = np.where(found == best[:, None], numbers[None, :], np.iinfo(np.int32).max)
    chosen = ties.min(axis=1)
    rest = np.where(numbers[None, :] == chosen[:, None], np.iinfo(np.int64).max, found)
    return chosen, best, rest.min(axis=1)


class Search:
    """Nearest centroids of batches of vectors; bounds carried from the round before spare most distances."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids, self.k = centroids, len(centroids)
        between = squares(centroids, centroids).astype(np.float64) ** 0.5
        #: For each centroid the others, nearest first, and their distances rounded down so that the ball keeps its edge.
        self.others = np.array([[j for j in np.argsort(between[a], kind="stable") if j != a] for a in range(self.k)], dtype=np.int64).reshape(self.k, -1)
        self.gaps = np.take_along_axis(between, self.others, 1) * (1 - SLACK)
        self.nearest = self.gaps[:, 0] if self.k > 1 else np.full(self.k, np.inf)
        self.scanned = 0
        if before is not None:
            moved = ((centroids - before).astype(np.float64) ** 2).sum(1) ** 0.5 * (1 + SLACK)
            self.moved = moved
            self.most = np.array([np.delete(moved, a).max(initial=0.0) for a in range(self.k)])

    def from_nothing(self, x: np.ndarray) -> tuple:
        """cluster, upper, lower, square of vectors without bounds."""
        self.scanned += len(x) * self.k
        chosen, best, rest = _two_nearest(squares(x, self.centroids), np.arange(self.k))
        return chosen.astype(np.int64), best**0.5 * (1 + SLACK), rest**0.5 * (1 - SLACK), best

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
        """cluster, upper, lower after the centroids have moved."""
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = (lower - self.most[cluster]) * (1 - SLACK)
        safe = np.maximum(lower, self.nearest[cluster] / 2)
        open_ = np.flatnonzero(~(upper < safe))
        if len(open_):
            own = ((x[open_] - self.centroids[cluster[open_]]) ** 2).sum(1)
            self.scanned += len(open_)
            upper[open_] = own.astype(np.float64) ** 0.5 * (1 + SLACK)
            open_ = open_[~(upper[open_] < safe[open_])]
        for a in np.unique(cluster[open_]):
            mine = open_[cluster[open_] == a]
            radius = (2 * upper[mine] + self.nearest[a]) * (1 + SLACK)
            inside = np.searchsorted(self.gaps[a], radius, side="right")
            # Lengths in powers of two: few scans of many vectors each, none of which leaves out a centroid of the ball.
            length = np.minimum(self.k - 1, 1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int))
            for n in np.unique(length):
                rows, numbers = mine[length == n], np.append(a, self.others[a, :n])
                self.scanned += len(rows) * len(numbers)
                chosen, best, rest = _two_nearest(squares(x[rows], self.centroids[numbers]), numbers)
                # Centroids outside the ball are no nearer than the second one inside, which the radius makes sure of.
                cluster[rows], upper[rows], lower[rows] = chosen, best**0.5 * (1 + SLACK), rest**0.5 * (1 - SLACK)
        return cluster, upper, lower


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WIDTH)


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """The state after one assignment, cut; squares are filled in by the last one only."""
    schema = STATE.format(dict(rows.dtypes)["vec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for batch in batches:
            x = _vectors(batch.column("v"))
            square = np.zeros(len(x), dtype=np.int64)
            if before is None:
                cluster, upper, lower, square = search.from_nothing(x)
            else:
                held = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower")]
                cluster, upper, lower = search.again(x, held[0].astype(np.int64), held[1].copy(), held[2].copy())
            if last:
                square = ((x - centroids[cluster]) ** 2).sum(1)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(square)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "square"])

    return cut(rows.mapInArrow(run, schema))


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; those without vectors as before."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(WIDTH)]
    after = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(WIDTH)]
    return after


def cluster_vectors(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every kept vector, and the final centroids."""
    vectors = kept_vectors(embeddings)
    centroids, before = first_centroids(vectors, k), None
    state = vectors
    if not len(centroids):
        empty = vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).where("false")
        return empty, centroids
    for turn in range(rounds + 1):
        state = _assigned(state, centroids, before, turn == rounds)
        if turn < rounds:
            before, centroids = centroids, moved_centroids(state, centroids)
    return state.select("vec_id", "cluster", F.col("square").alias("distance")), centroids


def clustering(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    found, centroids = cluster_vectors(embeddings, k, rounds)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(r["cluster_inertia"] for r in sums)
    told = [(r["cluster"], r["cluster_inertia"], whole, digests[r["cluster"]]) for r in sums]
    table = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
