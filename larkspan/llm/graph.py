"""Connected components of edges and of candidates that share buckets, by DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm._common import written


def _roots(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: each x (always above its y) to the end of its chain."""
    while True:
        g = hooks.select(F.col("x").alias("g_x"), F.col("y").alias("g_y"))
        jumped = hooks.join(g, F.col("y") == F.col("g_x"), "left").select("x", F.coalesce("g_y", "y").alias("y"), F.col("g_y").isNotNull().alias("moved"))
        jumped = written(jumped, "jump")
        hooks = jumped.select("x", "y")
        if jumped.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, follows the chains to their ends and contracts
    the edges to these ends.  Minima are taken before the shuffle; a node with very many edges meets a
    table with one row for it, so adaptive execution can split it.  The driver only asks whether edges are left.
    """
    links = written(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct(), "links")
    labels = None
    while not links.isEmpty():
        hooks = _roots(written(links.groupBy("x").agg(F.min("y").alias("y")), "hooks"))
        h = hooks.select(F.col("x").alias("h_x"), F.col("y").alias("h_y"))
        fresh = hooks.select(F.col("x").alias("node"), F.col("y").alias("component"))
        if labels is not None:
            moved = labels.join(h, F.col("component") == F.col("h_x"), "left").select("node", F.coalesce("h_y", "component").alias("component"))
            fresh = moved.unionByName(fresh)
        labels = written(fresh, "labels")
        to = lambda df, c: df.join(h, F.col(c) == F.col("h_x"), "left").withColumn(c, F.coalesce("h_y", c)).drop("h_x", "h_y")
        ends = to(written(to(links, "x"), "ends"), "y")
        links = written(ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct(), "links")
    if labels is None:
        return links.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def linked(
    members: DataFrame,
    promising: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame],
    exhaust: Callable[[DataFrame, DataFrame], DataFrame],
    rounds: int = 3,
    links: DataFrame | None = None,
) -> DataFrame:
    """(node, component) of the nodes that a confirmed link reaches, candidates being nodes in one bucket.

    members is (bucket, node), written.  promising gives of pairs (a, b) those worth a test, with their
    likeness; confirm gives of pairs those that are links.  A bucket never becomes all its pairs: in each
    round every member meets one hub of its bucket that it is not yet connected to, and of its hubs only
    the likeliest is confirmed.  After the rounds, exhaust gets what is still open, (bucket, node, comp)
    and (bucket, top_comp): the members outside a bucket's most common component have to be held against
    all its members of other components, and it gives the links among them.  So no candidates stay
    untested unless they are connected anyway, and components are those of testing all pairs.  links, if
    given, are written links found before.
    """
    tested = None
    comp = None if links is None else written(components(links), "components")
    for i in range(rounds + 1):
        if comp is None:
            placed = members.withColumn("comp", F.col("node"))
        else:
            placed = members.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
            spread = placed.groupBy("bucket").agg(F.min("comp").alias("c_low"), F.max("comp").alias("c_high")).filter("c_low <> c_high")
            placed = written(placed.join(written(spread.select("bucket"), "open-buckets"), "bucket"), "open")
            if placed.isEmpty():
                break
        if i < rounds:
            turn = F.struct((F.xxhash64("node", F.lit(i)) if i else F.col("node")).alias("turn"), "node", "comp")
            hubs = written(placed.groupBy("bucket").agg(F.min(turn).alias("h")).select("bucket", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp")), "hubs")
            pairs = placed.join(hubs, "bucket").filter("comp <> hub_comp").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
            pairs = promising(pairs).groupBy("a").agg(F.max_by("b", "likeness").alias("b"))
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs")
            found = written(confirm(pairs), "links")
            tested = pairs if tested is None else tested.unionByName(pairs)
        else:
            sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"))
            found = written(exhaust(placed, written(sizes.select("bucket", F.col("top.comp").alias("top_comp")), "top")), "links")
        links = found if links is None else links.unionByName(found)
        if comp is None or not found.isEmpty():
            comp = written(components(links), "components")
    return comp
