"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergauge.session import new_shared_path, remove_path, write_and_read

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is its smallest node.

    Every node points at the smallest node it knows; in each round nodes hear of their neighbours'
    and of their own pointers' pointers, so chains shorten by half. A round is a written table, and
    the rounds end when no pointer moves. Minima are taken in every task before rows are shuffled,
    so a node of very many links makes no large group. Links with a null end are left out; loops and
    repeated links do no harm.
    """
    spark = links.sparkSession
    clean = links.where("a is not null and b is not null")
    both = clean.select("a", "b").union(clean.select(F.col("b"), F.col("a"))).distinct()
    paths = [new_shared_path(spark, "links"), new_shared_path(spark, "pointers")]
    edges = write_and_read(both, paths[0])
    pointers = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
    pointers = write_and_read(pointers.select(F.col("a").alias("node"), "to"), paths[1])
    for _ in range(MAX_ROUNDS):
        neighbour = edges.join(
            pointers.select(F.col("node").alias("b"), F.col("to").alias("heard")), "b"
        ).select(F.col("a").alias("node"), "heard")
        # Also tell the node pointed at, so that a whole tree learns of a smaller root at once.
        own = pointers.select(F.col("node").alias("n"), F.col("to").alias("root"))
        told = neighbour.join(own, neighbour.node == own.n).select(
            F.col("root").alias("node"), "heard"
        )
        jump = pointers.select("node", F.col("to").alias("via")).join(
            pointers.select(F.col("node").alias("via"), F.col("to").alias("heard")), "via"
        )
        heard = (
            neighbour.union(told).union(jump.select("node", "heard")).groupBy("node")
            .agg(F.min("heard").alias("heard"))
        )
        moved = pointers.join(heard, "node", "left").select(
            "node",
            F.least("to", "heard").alias("to"),
            (F.col("heard") < F.col("to")).alias("moved"),
        )
        paths.append(new_shared_path(spark, "pointers"))
        moved = write_and_read(moved, paths[-1])
        pointers = moved.select("node", "to")
        if moved.where("moved").isEmpty():
            break
        remove_path(spark, paths.pop(-2))
    else:
        raise RuntimeError("components did not settle")
    return pointers.select("node", F.col("to").alias("component"))
