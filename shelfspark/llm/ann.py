"""Approximate nearest neighbours by multiprobe p-stable hashing.

``tables`` hash tables cut space by ``k`` random Gaussian projections into cells of width ``w``; k
grows with the logarithm of the rows, so a cell holds about ``rows_per_cell``. In every table a
query visits its own cell and perturbed ones in the order of their estimated success: the chance
that a neighbour at a given distance falls there, from the normal distribution of the projected
difference. The FIRST_CELLS most likely cells of each table, at the data's typical distance, come
first. With the distance of the n + 1st point found there, a bound of the query's own n-th
neighbour, the query goes on until its cells make up ``success`` of the chance, so how far it probes
follows from its own distances, not from a count or from other queries. Where the first cells hold
too few points, or more cells than there are would have to be tried, the query visits all cells of
one table. Candidates of all tables are merged and ranked by exact distance on the original vectors.

Equal vectors are one point: it carries its ``n + 1`` smallest ids, all that any answer can need, and
equal queries are searched once. A crowded cell is split into parts of about ``part_rows`` points,
each of which meets the cell's queries. Distances are computed cell by cell, and only a cell's best
leave it: the distance found in the first cells bounds what the other cells need to hand over.

The typical distance is measured on a sample of at most ``sample_queries`` queries and
``sample_points`` points; every row is indexed.

Defined cases: vectors that are null, of another length than ``dim``, zero, or hold null or
non-finite components take no part. Rows without an id take no part. Repeated rows count once. With
fewer candidates than ``n``, all are returned; a table without usable vectors gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfspark.llm.common import read, stored
from shelfspark.llm.registry import query

N = 10
TABLES = 2
ROWS_PER_CELL = 1024
PART_ROWS = 4096
FIRST_CELLS = 4
SUCCESS = 0.9
SAMPLE_QUERIES = 64
SAMPLE_POINTS = 4096
SEED = 20240229
# Width of a cell against the spread of the projections: about three cells cover most of them.
_WIDTH = 1.4


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): finite, nonzero vectors of doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.exists("v", lambda x: x != 0)
    return rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & some
    )


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """(ids, v): different vectors, with their ``keep`` smallest ids in order.

    The limit on row_number is applied before the shuffle too, so a hot vector sends few rows.
    """
    order = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    return first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _cells_by_success(
    at: np.ndarray, r: float, width: float, success: float, most: float = math.inf
) -> list[tuple[int, ...]]:
    """Cells in order of the chance that a neighbour at distance r lies there, until ``success`` or ``most`` cells.

    ``at`` holds the query's projections in cell widths. Each cell is a choice of one offset per
    projection; a heap visits the choices by falling product of their chances.
    """
    reach = max(1, math.ceil(4 * r / width))
    own = np.floor(at).astype(int)
    choices = []
    for x, cell in zip(at, own):
        offered = []
        for c in range(cell - reach, cell + reach + 1):
            low, high = (c - x) * width / r, (c + 1 - x) * width / r
            offered.append((0.5 * (math.erf(high / math.sqrt(2)) - math.erf(low / math.sqrt(2))), c))
        choices.append(sorted(offered, reverse=True))
    start = (0,) * len(at)
    chance = math.prod(c[0][0] for c in choices)
    heap, seen, total, out = [(-chance, start)], {start}, 0.0, []
    while heap and total < success and len(out) < most:
        p, pick = heapq.heappop(heap)
        total -= p
        out.append(tuple(choices[i][j][1] for i, j in enumerate(pick)))
        for i, j in enumerate(pick):
            if j + 1 < len(choices[i]):
                further = pick[:i] + (j + 1,) + pick[i + 1 :]
                if further not in seen:
                    seen.add(further)
                    before, after = choices[i][j][0], choices[i][j + 1][0]
                    if after > 0:
                        heapq.heappush(heap, (p * after / before, further))
    return out


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, by differences."""
    out = np.empty((len(q), len(x)))
    for i in range(len(q)):
        d = x - q[i]
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _typical_distance(points: DataFrame, queries: DataFrame, n: int) -> float:
    """Median distance of a sample of queries to their n-th neighbour in a sample of points, vectors aside."""
    take = lambda df, m: np.array(
        [r[0] for r in df.orderBy(F.xxhash64("v"), "v").limit(m).select("v").collect()]
    )
    q, x = take(queries, SAMPLE_QUERIES), take(points, SAMPLE_POINTS)
    d = np.sort(_distances(q, x), axis=1)
    d = np.where(d < 1e-9, np.nan, d)[:, : n + 1]
    return float(np.nanmedian(d[:, -1])) if np.isfinite(d).any() else 1.0


def search(
    rows: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    n: int = N,
    tables: int = TABLES,
    rows_per_cell: int = ROWS_PER_CELL,
    part_rows: int = PART_ROWS,
    success: float = SUCCESS,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's n nearest found, itself left out.

    ``queries`` is a part of ``rows``, by its ids.
    """
    spark = rows.sparkSession
    usable = _usable(rows, key, vector)
    asked = _usable(queries, key, vector).distinct()
    points = stored(_points(usable, n + 1), "ann-points")
    total = points.count()
    head = points.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = head["d"]
    points = points.filter(F.size("v") == dim)
    search_for = asked.filter(F.size("v") == dim).groupBy("v").agg(F.min("id").alias("q"))
    search_for = stored(search_for, "ann-queries")
    r = _typical_distance(points, search_for, n)

    # k so that cells hold about rows_per_cell: the width gives about three likely cells a projection
    k = max(1, round(math.log(max(total / rows_per_cell, 1)) / math.log(3)))
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((tables, k, dim))
    # a projection's spread is the vectors' root mean square length
    spread = points.select(F.sqrt(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    width = _WIDTH * spread
    shift = rng.random((tables, k))

    def cells(v: np.ndarray, t: int) -> np.ndarray:
        return v @ axes[t].T / width + shift[t]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            v = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, dim))
            for t in range(tables):
                own = np.floor(cells(v, t)).astype(np.int64)
                yield pd.DataFrame({"cell": [f"{t}:{':'.join(map(str, c))}" for c in own.tolist()], "ids": part["ids"], "v": part["v"]})

    def first_cells(at: np.ndarray) -> list[tuple[int, ...]]:
        # a distance far below a cell's width would order no cell but the query's own
        return _cells_by_success(at, max(r, width / 4), width, 1.0, FIRST_CELLS)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            v = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, dim))
            for t in range(tables):
                at = cells(v, t)
                for i, q in enumerate(part["q"]):
                    names = [f"{t}:{':'.join(map(str, c))}" for c in first_cells(at[i])]
                    yield pd.DataFrame({"cell": names, "q": q})

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other cells by the query's own distance; no name stands for all cells of the first table."""
        for part in batches:
            v = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, dim))
            at = [cells(v, t) for t in range(tables)]
            for i, (q, bound) in enumerate(zip(part["q"], part["bound"])):
                names = []
                for t in range(tables):
                    # equal points have no distance to go
                    visit = _cells_by_success(at[t][i], bound, width, success, in_table[t] + 1) if 0 < bound < math.inf else []
                    if bound == math.inf or len(visit) > in_table[t]:
                        names = [None]
                        break
                    done = set(first_cells(at[t][i]))
                    names += [f"{t}:{':'.join(map(str, c))}" for c in visit if c not in done]
                yield pd.DataFrame({"cell": pd.Series(names, dtype=object), "q": q, "bound": bound})

    indexed = points.mapInPandas(index, "cell string, ids array<long>, v array<double>")
    sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    in_cell = stored(sizes.select("cell", parts.alias("parts")), "ann-cells")
    placed = indexed.join(in_cell, "cell").withColumn("part", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("parts")))
    tally = in_cell.groupBy(F.split_part("cell", F.lit(":"), F.lit(1)).cast("int").alias("t")).count()
    in_table = {row["t"]: row["count"] for row in tally.collect()}
    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("parts") - 1).cast("bigint")))

    def rank(key_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x = np.stack(left["v"].to_numpy())
            many = left["ids"].tolist()
            for start in range(0, len(right), 256):
                some = right.iloc[start : start + 256]
                d = _distances(np.stack(some["v"].to_numpy()), x)
                near = np.argpartition(d, n, axis=1)[:, : n + 1] if len(x) > n + 1 else None
                for i, (q, bound) in enumerate(zip(some["q"], some["bound"])):
                    # all points up to the distance of the n + 1st: ties are broken by id below
                    edge = min(bound, d[i, near[i]].max() if near is not None else math.inf)
                    best = [(d[i, j], vec) for j in np.flatnonzero(d[i] <= edge) for vec in many[j]]
                    out += [(q, vec, dist) for dist, vec in heapq.nsmallest(n + 1, best)]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"]).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    def nearest_in(asked_of: DataFrame) -> DataFrame:
        """The best of each probed cell, by exact distance, up to the query's bound."""
        questions = asked_of.join(search_for, "q").select("cell", "part", "q", "v", "bound")
        return (
            placed.select("cell", "part", "ids", "v")
            .groupBy("cell", "part")
            .cogroup(questions.groupBy("cell", "part"))
            .applyInPandas(rank, "q long, vec_id long, score double")
        )

    likely = search_for.mapInPandas(probe, "cell string, q long").withColumn("bound", F.lit(math.inf))
    likely = likely.join(in_cell, "cell").withColumn("part", every_part)
    first = stored(nearest_in(likely).groupBy("q", "vec_id").agg(F.min("score").alias("score")), "ann-first")
    by_distance = Window.partitionBy("q").orderBy("score", "vec_id")
    bounds = first.withColumn("place", F.row_number().over(by_distance)).filter(F.col("place") == n + 1)
    own = search_for.join(bounds.select("q", F.col("score").alias("bound")), "q", "left").fillna({"bound": math.inf})
    further = stored(own.mapInPandas(go_on, "cell string, q long, bound double"), "ann-probes")
    whole_table = in_cell.filter(F.col("cell").startswith("0:"))
    others = (
        further.filter("cell is not null").join(in_cell, "cell").select("cell", "q", "bound", "parts")
        .unionByName(further.filter("cell is null").drop("cell").crossJoin(whole_table).select("cell", "q", "bound", "parts"))
        .withColumn("part", every_part)
    )
    found = first.unionByName(nearest_in(others))
    # the tables' candidates together, each once
    near = Window.partitionBy("q").orderBy("score", "vec_id")
    merged = (
        found.groupBy("q", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("place", F.row_number().over(near))
        .filter(F.col("place") <= n + 1)
        .select("q", "vec_id", "score")
    )
    # equal queries share what was found, each without itself
    twins = asked.join(search_for.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        twins.join(merged, "q")
        .filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= n)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op1_multiprobe_ann")
def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all."""
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))
