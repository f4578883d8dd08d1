"""Connected components of a link table, by alternating large-star and small-star steps.

Defined cases: links from a node to itself, or with a null end, link nothing, and a node that has no others is in no row;
repeated and reversed links count once; without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import materialise, remove_folder, shared_folder


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each step keeps one row per link at most and is written to the shared folder. Minima combine before the shuffle,
    and no list of neighbours is ever gathered, so a node with very many links is only ever a key of counted rows.
    """
    folder = shared_folder(links.sparkSession)
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "step0", folder)
    step, mark = 0, None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_nearest(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = materialise(large, f"large{step}", folder)
        low = _nearest(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).distinct()
        step += 1
        edges = materialise(small, f"step{step}", folder)
        remove_folder(edges.sparkSession, f"{folder}/step{step - 1}")
        remove_folder(edges.sparkSession, f"{folder}/large{step - 1}")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
