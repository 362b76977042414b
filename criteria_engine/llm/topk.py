"""Exact top-k by inner product: term-at-a-time accumulation over blocks of rows.

A vector is a sparse row of (component, integer weight) terms. Candidates are cut into
slices and queries into blocks of SIDE_BYTES; a cell holds one slice and one block. In
a cell the slice becomes one posting list per component; each query adds its weight times
the postings, component after component, to a dense array of scores, of which the k
best are split off. Cells are merged by query. A cell's memory is bounded by SIDE_BYTES,
whatever the table's size, and no side is broadcast. Both sides of a cell are large, so that
a candidate moves once per SIDE_BYTES of queries and a query once per SIDE_BYTES of candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Vectors of one side of a cell, as they are held by a Python worker.
SIDE_BYTES = 32 << 20
ROW_BYTES, TERM_BYTES = 160, 8
# Smaller slices only as far as the cluster has tasks for them.
LEAST_SLICE = 4096
# A component that more than this part of a slice has is a posting list without gaps.
DENSE = 0.3
RESULT = "query_id long, vec_id long, score long"
LIMIT = 2**63 - 1


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, or null if the vector has no place in the search.

    Null vectors and those with null, infinite or NaN components have none.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * 256.0)))


def _rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse terms of all rows: row, component, weight."""
    counts = np.fromiter(map(len, vectors), np.int64, len(vectors))
    flat = np.concatenate([np.asarray(v, np.int64) for v in vectors] or [np.empty(0, np.int64)])
    row = np.repeat(np.arange(len(vectors)), counts)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = flat != 0
    return row[kept], term[kept], flat[kept]


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores of ids other than `own`; ids ascend, ties to smaller ids."""
    own_from, own_to = np.searchsorted(ids, [own, own + 1])
    taken = own_to - own_from
    if len(ids) - taken <= k:
        places = np.arange(len(ids))
    else:
        # the own row may be among the best, so look `taken` places further
        nth = len(ids) - min(len(ids), k + taken)
        bound = np.partition(scores, nth)[nth]
        above = np.flatnonzero(scores > bound)
        places = np.concatenate([above, np.flatnonzero(scores == bound)[: k + taken]])
    places = places[(places < own_from) | (places >= own_to)]
    order = np.lexsort((ids[places], -scores[places]))
    return places[order[:k]]


def search_cell(k: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if queries.empty or candidates.empty:
            return empty
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids = candidates["vec_id"].to_numpy(np.int64)
        row, term, weight = _rows(candidates["weights"])
        q_row, q_term, q_weight = _rows(queries["weights"])
        # the narrowest integers in which no sum can overflow
        terms = max(int(np.bincount(q_row).max(initial=0)), 1)
        largest = terms * max(1, *map(abs, map(int, (q_weight.max(initial=0), q_weight.min(initial=0)))))
        largest *= max(1, *map(abs, map(int, (weight.max(initial=0), weight.min(initial=0)))))
        kind = np.int32 if largest < 2**31 else np.int64 if largest < 2**63 else object
        postings = {}
        order = np.argsort(term, kind="stable")
        found, starts = np.unique(term[order], return_index=True)
        for t, part in zip(found, np.split(order, starts[1:])):
            rows, weights = row[part], weight[part].astype(kind)
            if len(rows) > DENSE * len(ids):
                dense = np.zeros(len(ids), kind)
                dense[rows] = weights
                rows, weights = slice(None), dense
            postings[t] = rows, weights
        out = []
        bounds = np.searchsorted(q_row, np.arange(len(queries) + 1))
        for i, query_id in enumerate(queries["query_id"].to_numpy(np.int64)):
            scores = np.zeros(len(ids), kind)
            for j in range(bounds[i], bounds[i + 1]):
                if q_term[j] in postings:
                    rows, weights = postings[q_term[j]]
                    scores[rows] += weights * (int(q_weight[j]) if kind is object else kind(q_weight[j]))
            if kind is object:
                scores = np.clip(scores, -LIMIT - 1, LIMIT).astype(np.int64)
            scores = scores.astype(np.int64)
            best = _best(scores, ids, query_id, k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else empty

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k rows of highest integer inner product for every query row.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, a query
    meets every row but those of its own id, and has fewer results if there are fewer rows.
    Rows with a null id, an unusable vector or no vector take no part. Vectors of
    unequal length: a missing component weighs 0. A repeated candidate row is a candidate
    each time; a repeated query id is asked once, with its smallest vector. Scores beyond
    64 bits stop at the limits of 64 bits. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        quantised(F.col(vector_col)).alias("weights"),
        is_query.alias("is_query"),
    ).where("vec_id is not null and weights is not null")
    asked = rows.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("weights").alias("weights"))
    size = F.size("weights") * TERM_BYTES + ROW_BYTES
    sizes = rows.agg(
        F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(F.when(F.col("is_query"), size)).alias("asked")
    ).first()
    spread = min(-(-sizes["n"] // LEAST_SLICE), vectors.sparkSession.sparkContext.defaultParallelism)
    n_slices = max(1, spread, -(-(sizes["bytes"] or 0) // SIDE_BYTES))
    n_blocks = max(1, -(-(sizes["asked"] or 0) // SIDE_BYTES))
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_slices))
    candidates = rows.select(
        "vec_id", "weights", part.cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    queries = asked.select(
        "query_id", "weights", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"),
    )
    found = (
        queries.groupBy("slice", "block")
        .cogroup(candidates.groupBy("slice", "block"))
        .applyInPandas(lambda q, c: search_cell(k)(q, c), RESULT)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
