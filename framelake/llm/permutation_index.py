"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order; the index is a written table of these permutations in blocks.
A block's inverted files hold, for each pivot, the vectors that have it and at which position; a query asks the files of
its own nearest pivots, adds up the footrule distance of every vector in them, and the nearest permutations are ranked
again by the exact inner product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

#: Pivots (a bounded sample: the first by hash), how many of them stand for a vector, how many of these a query asks, and the share and the least
#: number of a block's different vectors, nearest by footrule, that are ranked again. A small table's nearest are a larger share of it.
PIVOTS, PREFIX, ASKED, SHARE, LEAST = 1_024, 192, 48, 0.06, 400
#: Vectors of an index block, queries that are packed together, and packs that meet a block at a time.
BLOCK, PACK, PACKS = 8_192, 256, 16


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors on the unit sphere, by one more coordinate, that a query's cosine orders as the inner product does."""
    scaled = vectors / longest
    return np.concatenate([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1, keepdims=True)))], axis=1)


def as_query(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))], axis=1)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each vector, nearest first, by cosine; all are of unit length."""
    close = vectors @ pivots.T
    prefix = min(prefix, pivots.shape[0])
    near = np.argpartition(-close, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(close, near, 1), axis=1, kind="stable"), 1)


def inverted_files(perms: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot: the rows whose prefix has it, and their gain m - position."""
    rows, m = perms.shape
    order = np.argsort(perms.ravel(), kind="stable")
    ends = np.searchsorted(perms.ravel()[order], np.arange(n_pivots + 1))
    who, gain = (order // m).astype(np.int32), (m - order % m).astype(np.int32)
    return [(who[a:b], gain[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def footrule_gain(files: list, perm: np.ndarray, prefix: int, rows: int) -> np.ndarray:
    """What the pivots asked take off the largest footrule distance, halved, per row: the larger, the nearer. A pivot
    missing on one side counts as standing at position `prefix`."""
    met = [(files[pivot][0], np.minimum(files[pivot][1], prefix - at)) for at, pivot in enumerate(perm)]
    return np.bincount(np.concatenate([who for who, _ in met]), np.concatenate([gain for _, gain in met]), rows)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def build_index(rows: DataFrame, pivots: np.ndarray, longest: float, prefix: int, block: int) -> tuple[DataFrame, int]:
    """The written index (block, id, v, perm) and its number of blocks: every row with its vector and its nearest pivots, in blocks of about
    `block` rows that a hash of id and vector deals out, so no key decides a block's size."""
    blocks = max(1, -(-rows.count() // block))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("binary")
    def permuted(vectors: pd.Series) -> pd.Series:
        parts = [vectors.iloc[at: at + 2_000] for at in range(0, len(vectors), 2_000)]
        return pd.Series([p.astype(np.uint16).tobytes() for part in parts
                          for p in permutations(lifted(np.stack(part.to_numpy()), longest), shared.value, prefix)], index=vectors.index, dtype=object)

    index = materialize(rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "v", permuted("v").alias("perm")))
    return index, blocks


def search(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           n_pivots: int = PIVOTS, prefix: int = PREFIX, asked: int = ASKED, share: float = SHARE, block: int = BLOCK,
           least: int = LEAST) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector of `queries` its `k` nearest found among all of `df`,
    without rows of its own id, by the inner product in double precision, ties to the smaller id.

    Vectors that are null, zero, of another length than most pivots, or that hold null or non-finite components take no
    part. Repeated ids: each row is a candidate of its own; of queries that share an id the smallest vector asks. Equal
    vectors of a block are compared once and found together. With fewer candidates than `k` all are returned; an empty
    table gives an empty result; other columns aren't read, whatever their names. Pivots: the different ones of the
    `n_pivots` first vectors by hash. A task holds one block and at most PACK * PACKS queries; of each block the `share` nearest by footrule, `least`
    at least, are ranked again.
    """
    spark = df.sparkSession
    rows = _usable(df, key, vector)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    width = max((len(r.v) for r in sample), key=[len(r.v) for r in sample].count, default=0)
    rows = rows.where(F.size("v") == width)
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    same = [r.v for r in sample if len(r.v) == width]
    pivots = np.unique(lifted(np.array(same, dtype=np.float64).reshape(len(same), width), longest), axis=0)
    prefix, asked = min(prefix, max(1, len(pivots))), min(asked, max(1, len(pivots)))
    index, blocks = build_index(rows, pivots, longest, prefix, block)
    asking = _usable(queries, key, vector).where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    packs = max(1, -(-asking.count() // PACK))
    packed = asking.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack")).agg(
        F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))
    # every group of packs meets every block; nothing else is multiplied
    met = packed.select(F.floor(F.col("pack") / PACKS).cast("int").alias("group"), "ids", "vs",
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    stored = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((packs - 1) // PACKS))))
    shared = spark.sparkContext.broadcast(pivots)
    kind = rows.schema["id"].dataType.simpleString()

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            pivots, ids, copies = shared.value, left["id"].to_numpy(), {}
            for i, data in enumerate(v.tobytes() for v in left["v"]):
                copies.setdefault(data, []).append(i)
            groups = list(copies.values())
            first = np.array([g[0] for g in groups])
            vectors = np.stack(left["v"].to_numpy()[first])
            perms = np.stack([np.frombuffer(p, np.uint16) for p in left["perm"].to_numpy()[first]])
            files = inverted_files(perms, len(pivots))
            keep = max(least, 4 * k, int(np.ceil(share * len(first))))
            # Vectors that rows of one id alone have are no candidates of that id's query.
            lone: dict = {}
            for at, group in enumerate(groups):
                if all(ids[i] == ids[group[0]] for i in group):
                    lone.setdefault(ids[group[0]], []).append(at)
            for q_ids, q_vs in zip(right["ids"], right["vs"], strict=True):
                asking = np.asarray(q_vs, dtype=np.float64).reshape(-1, vectors.shape[1])
                for q, v, perm in zip(q_ids, asking, permutations(as_query(asking), pivots, asked), strict=True):
                    gain = footrule_gain(files, perm, prefix, len(first))
                    gain[lone.get(q, [])] = -1
                    near = np.argpartition(-gain, keep - 1)[:keep] if keep < len(first) else np.arange(len(first))
                    near = near[gain[near] >= 0]
                    score = vectors[near] @ v
                    # the k best vectors with all that tie; each has a row of another id
                    edge = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                    rows = [(-s, ids[j]) for i, s in zip(near[score >= edge], score[score >= edge], strict=True) for j in groups[i] if ids[j] != q]
                    found += [(q, i, -s) for s, i in sorted(rows)[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    hits = stored.groupBy("block", "group").cogroup(met.groupBy("block", "group")).applyInPandas(
        best, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
