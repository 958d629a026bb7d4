"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (u, v: longs; loops and repeats allowed).

    Large-star and small-star steps take turns: each node's neighbours are tied to the smallest node they share, until
    all edges point to their component's smallest node. The number of rounds is logarithmic in the longest path. Each
    step is written to the shared folder. An empty table gives no rows.
    """
    rows = 2 * edges.count()
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = scratch.write(edges.distinct(), f"{name}-edges-0", rows=rows)
    before, step = _state(edges), 0
    while before[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        low = scratch.write(low, f"{name}-low-{step}", rows=rows)
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = scratch.write(large.distinct(), f"{name}-large-{step}", rows=rows)
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("low")), f"{name}-small-{step}", rows=rows)
        small = large.join(low, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = scratch.write(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), f"{name}-edges-{step}", rows=rows)
        after = _state(edges)
        for table in (f"edges-{step - 1}", f"low-{step}", f"large-{step}", f"small-{step}"):
            scratch.drop(f"{name}-{table}")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
