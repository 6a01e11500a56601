"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.session import stored


def component_labels(links: DataFrame) -> DataFrame:
    """(cid, comp): for each end of a link (a, b), the smallest node it is connected with.

    Each round, every node takes the smallest of itself and its neighbours, the
    links are renamed by it, and links within a node vanish.  The graph shrinks
    until no link is left; the renamings, composed, are the labels.  All steps
    are joins and minima with partial sums; each round is written to the shared
    folder, so its lineage is short and survives lost executors.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("cid", "other")
        renamed = both.groupBy("cid").agg(F.min("other").alias("other"))
        step = stored(renamed.select("cid", F.least("cid", "other").alias("comp")), "component-step")
        if labels is None:
            labels = step
        else:
            to = step.toDF("comp", "next")
            labels = labels.join(to, "comp", "left").select("cid", F.coalesce("next", "comp").alias("comp"))
            labels = stored(labels, "labels")
        one, two = step.toDF("a", "a_next"), step.toDF("b", "b_next")
        moved = edges.join(one, "a").join(two, "b").where("a_next <> b_next")
        moved = moved.select(F.least("a_next", "b_next").alias("a"), F.greatest("a_next", "b_next").alias("b"))
        edges = stored(moved.distinct(), "edges")
    return edges.toDF("cid", "comp") if labels is None else labels
