"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempolog.llm.common import durable, ship

K = 5
QUERY_STEP = 50
SCALE = 256
# Vectors whose lists one task sorts, and queries that it answers from them.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
# Entries of each list read at first; later rounds read four times as many each.
DEPTH = 32
_EXACT = 1 << 53
_LONG = 1 << 63


class SortedLists:
    """The vectors of a block with, per dimension, their order by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # A float product is exact while all partial sums are below 2**53.
        self.wide = self.vectors.astype(np.float64)
        self.most = np.abs(self.wide).max(initial=0.0)
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        bound = self.most * float(np.abs(query.astype(np.float64)).sum())
        if bound < _EXACT:
            return (self.wide[rows] @ query.astype(np.float64)).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.vectors[rows]], dtype=object)

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, list]:
        """Ids and scores of the ``k`` best vectors for a query, by score, then id.

        Reads the lists from the end that the query's sign favours. What has not been seen scores at most the bound,
        the sum of the components at the present depth times the query's; reading stops once the kth score is above
        it. At an equal bound it goes on, since a smaller id may follow.
        """
        n = len(self.ids)
        seen = np.zeros(n, bool)
        rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = np.flatnonzero(query)
        up = query[used] > 0
        depth, step = 0, DEPTH
        while depth < n:
            to = min(n, depth + step) if len(used) else n
            if to < n:
                seen_now = np.zeros(n, bool)
                seen_now[self.order[n - to:n - depth, used[up]]] = True
                seen_now[self.order[depth:to, used[~up]]] = True
                new = np.flatnonzero(seen_now & ~seen)
            else:
                new = np.flatnonzero(~seen)
            seen[new] = True
            if len(new):
                rows, best = np.r_[rows, new], np.r_[best, self.scores(new, query)]
                order = np.lexsort((self.ids[rows], -best))[:k]
                rows, best = rows[order], best[order]
            depth, step = to, 4 * step
            if depth < n and len(best) == k:
                at = np.where(up, self.sorted[n - 1 - depth, used], self.sorted[depth, used])
                if int(best[-1]) > sum(int(a) * int(b) for a, b in zip(at, query[used])):
                    break
        return self.ids[rows], list(best)


def scaled(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: components as ``floor(scale * x)``; vectors that are null or hold null or non-finite components are left out."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, block: int = BLOCK_VECTORS, column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose vec_id is divisible by ``query_step``, the ``k`` highest
    inner products with other rows, ties to the smaller vec_id.

    Components are ``floor(256 * x)``. Equal vectors are one entry of the lists with their ``k + 1`` smallest different ids and how
    often each is repeated (up to ``k``), which is all of them that any result can hold. Entries are dealt by a hash into blocks of about ``block``, queries into blocks of
    ``BLOCK_QUERIES``; each pair of blocks is one group, in which the threshold algorithm reads the entries' sorted lists.
    Per query and block as many entries remain as ``k`` others than the query's own need, of which the best ``k`` are ranked. Vectors of different length are not
    compared. Vectors null or with null or non-finite components take no part, nor do rows without vec_id; repeated
    ids are one row each. Scores beyond 64 bits are given as the nearest long. Further columns are ignored.
    """
    rows = durable(scaled(vectors, column))
    ship(vectors.sparkSession)
    first = Window.partitionBy("v").orderBy("vec_id")
    different = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    few = different.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))
    entries = durable(entries.withColumn("first", F.col("ids")[0]["vec_id"]).withColumn("entry", F.monotonically_increasing_id()))
    queries = rows.where(F.col("vec_id") % query_step == 0)
    n_blocks = max(1, -(-entries.count() // block))
    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select(block_of("entry", n_blocks).alias("b"), F.size("v").alias("d"), each(q_blocks).alias("q"), "entry", "first", "v")
    right = queries.select(each(n_blocks).alias("b"), F.size("v").alias("d"), block_of("vec_id", q_blocks).alias("q"),
                           F.col("vec_id").alias("query_id"), F.col("v").alias("w")).distinct()
    keys = ["b", "d", "q"]

    def search(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            entries = entries.sort_values(["first", "entry"], ignore_index=True)
            names, firsts = entries["entry"].to_numpy(), entries["first"].to_numpy()
            lists = SortedLists(np.arange(len(entries)), np.stack(entries["v"].to_numpy()).reshape(len(entries), -1))
            own = queries["query_id"].value_counts()
            for query_id, w in zip(queries["query_id"], queries["w"]):
                # Entries may hold the query's own id: one for each different vector of it, so that many more are kept.
                held = int(own[query_id])
                places, scores = lists.top(np.asarray(w), k + held)
                out += [(query_id, names[e], firsts[e], held, min(max(int(s), -_LONG), _LONG - 1)) for e, s in zip(places, scores)]
        frame = pd.DataFrame(out, columns=["query_id", "entry", "first", "held", "score"])
        return frame.astype("int64")

    schema = "query_id long, entry long, first long, held long, score long"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    kept = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + F.col("held") * F.col("held"))
    each_id = kept.join(entries.select("entry", "ids"), "entry").select("query_id", F.inline("ids"), "score")
    members = each_id.select("query_id", F.explode(F.array_repeat("vec_id", F.col("times"))).alias("vec_id"), "score")
    ranked = members.where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
