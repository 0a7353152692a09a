"""Exact search for the highest inner products, by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.checkpoints import Tables

SCALE = 1024
LONG = 1 << 63
PLACED = "vec_id long, vec array<long>, asks boolean, dim int, cluster int, far array<double>, norm double"
FOUND = "query_id long, vec_id long, key binary, score long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): floor(1024 * x) of each component; rows with a null or non-finite one, or without id, are left out."""
    x = lambda c: c.cast("double")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(SCALE * x(c)).cast("long")).alias("vec")).dropDuplicates()


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """By dimension, so many vectors far from each other, out of a sample (the first by hash of id) of so many rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).collect()
    out: dict[int, np.ndarray] = {}
    for d in {len(r["vec"]) for r in rows}:
        own = [r["vec"] for r in rows if len(r["vec"]) == d]
        points = np.array(own, float).reshape(len(own), d)
        chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(pivots, len(points)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[d] = points[chosen]
    return out


def place(rows: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, vec, asks) with the pivot table: the distances to all pivots of their dimension, the nearest one, and the squared norm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf["vec"].map(len)
            for d, part in pdf.groupby(dims):
                x = np.array(part["vec"].tolist(), float).reshape(len(part), d)
                near = points.get(d, np.zeros((0, d)))
                far = np.stack([np.linalg.norm(x - p, axis=1) for p in near], 1) if len(near) else np.zeros((len(part), 0))
                yield part.assign(dim=d, cluster=far.argmin(1) if len(near) else 0, far=list(far), norm=(x * x).sum(1))

    return rows.mapInPandas(run, PLACED)


def bounds(query_norm: float, query_far: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds on the products of a query with rows of these squared norms, whose distances to the pivots are from low to high.

    |q - x| is at least the difference of their distances to any pivot, the most of these over all pivots is the
    bound, and a product is half of what the two squared norms exceed the squared distance by. The margins cover rounding.
    """
    gaps = np.maximum(np.maximum(low - query_far, query_far - high), 0)
    gaps = np.nan_to_num(gaps, nan=0.0)
    least = gaps.max(1) if gaps.shape[1] else np.zeros(len(norms))
    total = query_norm + norms
    return (total - (least * (1 - 1e-9)) ** 2) / 2 + 1e-9 * total + 1


def search_block(queries: np.ndarray, query_ids: np.ndarray, query_far: np.ndarray, at_least: np.ndarray, rows: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int, step: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """((query_id, vec_id, score) of the best row of each of the k best ids for each query, how many products were taken).

    Rows are evaluated in order of their bound, until the next bound is below the k-th score found here, or below what the
    query's k-th score is known to reach.
    """
    size = max(float(np.abs(queries).max(initial=0)), float(np.abs(rows).max(initial=0)))
    kind = float if size * size * max(1, rows.shape[1]) < 2**52 else object  # products of doubles are exact, or Python's whole numbers are
    wide = rows.astype(float)
    norms = (wide * wide).sum(1)
    query_norms = (queries.astype(float) ** 2).sum(1)
    queries, rows = queries.astype(kind), rows.astype(kind)
    out, taken = [], 0
    for q, query_id in enumerate(query_ids):
        bound = bounds(query_norms[q], query_far[q], norms, far, far)
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.searchsorted(-bound[order], -at_least[q], "right"))]
        best_s, best_i, at = np.zeros(0, kind), np.zeros(0, np.int64), 0
        while at < len(order) and (len(best_s) < k or bound[order[at]] >= best_s[-1]):
            part = order[at : at + step]
            part = part[ids[part] != query_id]
            taken += len(part)
            best_s = np.concatenate([best_s, rows[part] @ queries[q]])
            best_i = np.concatenate([best_i, ids[part]])
            keep = np.lexsort((best_i, -best_s))
            _, first = np.unique(best_i[keep], return_index=True)  # of each id its best row
            keep = keep[np.sort(first)][:k]
            best_s, best_i, at = best_s[keep], best_i[keep], at + step
        out += [(int(query_id), int(i), int(s)) for s, i in zip(best_s, best_i, strict=True)]
    return out, taken


def _searched(groups: DataFrame, keys: list[str], k: int) -> DataFrame:
    """FOUND of the queries and rows of each group; asked queries carry in least what their k-th score reaches."""

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asks = group["role"].to_numpy(int) == 1
        d = int(key[0])
        vectors = np.array(group["vec"].tolist(), np.int64).reshape(len(group), d)
        far, ids = np.stack(group["far"].tolist()) if len(group) else np.zeros((0, 0)), group["vec_id"].to_numpy(np.int64)
        if not asks.any() or asks.all():
            found = []
        else:
            found, _ = search_block(vectors[asks], ids[asks], far[asks], group["least"].to_numpy(float)[asks], vectors[~asks], ids[~asks], far[~asks], k)
        # The key orders scores of any size; as a long, a score is held at the ends.
        rows = [(q, i, (s + (1 << 255)).to_bytes(32, "big"), max(-LONG, min(LONG - 1, s))) for q, i, s in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "key", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return groups.groupBy(*keys).applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """FOUND with the rank of each id's best score for each query, up to k."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("key").alias("key"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _summaries(placed: DataFrame, most: int) -> pd.DataFrame:
    """One row for each cluster: rows, queries, largest norm, and the range of distances to each pivot. At most as many as there are pivots."""
    ranges = [f(F.get("far", F.lit(p))).alias(f"{n}{p}") for p in range(most) for n, f in (("low", F.min), ("high", F.max))]
    return placed.groupBy("dim", "cluster").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("norm").alias("norm"), *ranges).toPandas()


def targets(queries: DataFrame, summary: pd.DataFrame, most: int) -> DataFrame:
    """queries (PLACED, least) once for each cluster of their dimension whose bound reaches least."""
    by = {d: part for d, part in summary.groupby("dim")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reached = []
            for d, norm, far, least in zip(pdf["dim"], pdf["norm"], pdf["far"], pdf["least"], strict=True):
                s, n = by[d], len(far)
                low, high = (s[[f"{x}{p}" for p in range(n)]].to_numpy(float) for x in ("low", "high"))
                reached.append(s["cluster"].to_numpy()[bounds(norm, far, s["norm"].to_numpy(), low, high) >= least])
            yield pdf.assign(target=reached).explode("target").dropna(subset="target").astype({"target": "int32"})

    return queries.mapInPandas(run, f"{PLACED}, least double, target int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 24, sample: int = 1024, row_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query among all rows but those of its own id.

    Rows are placed with their nearest pivot. Each query first searches one block of its own cluster: its k-th score there
    is a limit that all others must reach. Then it goes only to the clusters whose bound reaches it, whose rows and
    queries meet in blocks of bounded size. Only the pivots and a summary of each cluster go by way of the driver.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors meet only those of
    their own length; empty vectors score 0. Exact repetitions of a row count once; an id with several vectors keeps
    its best score. Ties go to the smaller vec_id. Fewer rows than k: all. An empty table gives no rows. Scores
    beyond a long are ranked as they are, and shown held at its ends. Other columns are ignored.
    """
    with Tables(vectors.sparkSession) as tables:
        rows = whole_numbers(vectors).withColumn("asks", F.coalesce(is_query, F.lit(False)))
        points = choose_pivots(rows.select("vec_id", "vec"), pivots, sample)
        placed = tables.write(place(rows, points))
        most = max((len(p) for p in points.values()), default=0)
        summary = _summaries(placed, most)
        size = {(r.dim, r.cluster): -(-r.n // row_block) for r in summary.itertuples()}

        def blocks(table: dict, cluster: str) -> Column:
            """The number of blocks of each row's cluster, out of a small table."""
            pairs = [F.lit(x) for (d, c), n in table.items() for x in (f"{d}:{c}", n)]
            return F.coalesce(F.create_map(*pairs)[F.concat_ws(":", "dim", cluster)], F.lit(1)) if pairs else F.lit(1)

        own = F.xxhash64("vec_id", "vec")
        columns = ["dim", "cluster", "rb", "qb", "vec_id", "vec", "far", "role", "least"]
        dealt = placed.withColumn("n_", blocks(size, "cluster")).withColumn("rb", F.pmod(own, "n_").cast("int"))
        none = F.lit(float("-inf"))
        held = dealt.withColumns({"role": F.lit(0), "least": none, "qb": F.lit(0)}).select(columns)
        first = held.unionByName(dealt.where("asks").withColumns({"role": F.lit(1), "least": none, "qb": F.lit(0)}).select(columns))
        seeds = _best(_searched(first, ["dim", "cluster", "rb"], k), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
        asked = placed.where("asks").join(seeds.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").withColumn("least", F.coalesce("least", none))
        aimed = tables.write(targets(asked.select(*[x.split()[0] for x in PLACED.split(", ")], "least"), summary, most))
        queries = {(r["dim"], r["target"]): -(-r["n"] // query_block) for r in aimed.groupBy("dim", "target").agg(F.count("*").alias("n")).collect()}

        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
        asks = aimed.drop("cluster").withColumnRenamed("target", "cluster").withColumn("n_", blocks(size, "cluster")).withColumn("m_", blocks(queries, "cluster"))
        asks = asks.withColumns({"qb": F.pmod(own, "m_").cast("int"), "role": F.lit(1)}).withColumn("rb", every("n_")).select(columns)
        rows = dealt.withColumn("m_", blocks(queries, "cluster")).withColumns({"role": F.lit(0), "least": none}).withColumn("qb", every("m_")).select(columns)
        found = _searched(rows.unionByName(asks), ["dim", "cluster", "rb", "qb"], k)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def search_digest(vectors: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 100 asks for its 10 best."""
    return top_k(vectors, F.col("vec_id") % 100 == 0)
