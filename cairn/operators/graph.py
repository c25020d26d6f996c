"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

#: Up to this many edges (16 bytes each) one task unites them; beyond, stars in rounds of shuffles.
ONE_TASK_EDGES = 4_000_000


def _unite(t: pa.Table) -> pa.Table:
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    ids = np.unique(np.concatenate([a, b]))
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return pa.table({"id": ids, "root": ids[[root(x) for x in range(len(ids))]] if len(ids) else ids})


def components(edges: DataFrame, limit: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, root) for every id of ``edges`` (a long, b long): the least id that it is connected to.
    Rows with a null end are left out; loops count as an id alone. Large inputs alternate large and
    small stars (logarithmic rounds), each round a reliable checkpoint."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null").distinct()
    edges = cut(edges)
    if edges.count() <= limit:
        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_unite, "id long, root long")
    ids = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour points to the least one of the neighbourhood
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # so does every smaller neighbour, and the node itself
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = cut(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return ids.join(e.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
