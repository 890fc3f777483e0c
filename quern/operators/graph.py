"""Property graphs as two tables: nodes (id, label) and edges (source, target, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sharded import previous_value
from quern.session import checkpointed


def next_edges(children: DataFrame, node: str, parent: str, order: list[str]) -> DataFrame:
    """(source, target): each child and the sibling behind it, by ``order``, then id.

    A parent with any number of children is cut into shards, see ``sharded``.
    Children without a parent have no siblings.
    """
    rows = previous_value(children.where(F.col(parent).isNotNull()), [parent], [*order, node], node, "__before")
    return rows.where("__before IS NOT NULL").select(F.col("__before").alias("source"), F.col(node).alias("target"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, degree) of every end of an edge; a self-loop counts on both sides."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), (F.sum("o") + F.sum("i")).alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """The edges whose ``side`` (source or target) is no node."""
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    return edges.join(ids, F.col(side) == F.col("__id"), "left_anti")


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(id, component): connected components of an undirected graph, named by their least id.

    Alternating large-star and small-star steps; each round groups edges by one end
    and needs only the least neighbour of a group, so a hub is aggregated map-side
    and never collected. The number of rounds grows with the logarithm of the
    longest path. Ends that are NULL are left out.
    """
    both = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target")
    nodes = both.select(F.col("source").alias("id")).unionByName(both.select(F.col("target").alias("id"))).distinct()
    links = checkpointed(both.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    for _ in range(limit):
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = checkpointed(small)
        same = now.count() == links.count() and not now.exceptAll(links).limit(1).count()
        links = now
        if same:
            break
    else:
        raise RuntimeError(f"no end after {limit} rounds")
    return nodes.join(links, nodes["id"] == links["u"], "left").select("id", F.coalesce("v", "id").alias("component"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, hop): every node within ``hops`` undirected steps of a seed, with its least number of steps.

    Level by level; a node that was reached is not visited again.
    """
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    seen = checkpointed(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1)
        ahead = both.join(frontier, both["source"] == frontier["id"], "left_semi").select(F.col("target").alias("id")).distinct()
        seen = checkpointed(seen.unionByName(ahead.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))))
    return seen


def _both_ways(edges: DataFrame) -> DataFrame:
    """(source, target): every edge in both directions once, without loops."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return checkpointed(both.where("source <> target").distinct())


def _voted(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): the label most frequent among the neighbours, of equally frequent ones the least."""
    votes = both.join(labels.select("id", "label"), both["target"] == labels["id"]).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("source").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def propagated_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, label): communities by ``rounds`` of synchronous label propagation.

    A node takes the label most frequent among its neighbours, of equally frequent
    ones the least; it begins with its own id. Votes are counted map-side, so a hub
    brings one row per label, not one per neighbour. Loops and repeated edges count once.
    """
    both = _both_ways(edges)
    labels = both.select(F.col("source").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        labels = checkpointed(_voted(both, labels))
    return labels


def communities(edges: DataFrame, least: int = 3, limit: int = 1000) -> DataFrame:
    """(id, label): communities of at least ``least`` nodes, by label propagation until it is stable.

    Rounds are those of ``propagated_labels``. Synchronous rounds over edges in both
    directions end in one state or in two that alternate, so the end is the round in
    which every node has the label it had two rounds before; a node that alternates
    has the lesser of its two labels. An error where that takes more than ``limit``
    rounds. Nodes of smaller communities are left out.
    """
    both = _both_ways(edges)
    labels = checkpointed(both.select(F.col("source").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit(None).cast(both.schema["source"].dataType).alias("before")))
    for _ in range(limit):
        last = labels.select(F.col("id").alias("node"), F.col("label").alias("before"), F.col("before").alias("earlier"))
        now = _voted(both, labels).join(last, F.col("id") == F.col("node"))
        now = checkpointed(now.select("id", "label", "before", F.col("label").eqNullSafe(F.col("earlier")).alias("same")))
        labels = now.select("id", "label", "before")
        if not now.where("NOT same").limit(1).count():
            break
    else:
        raise RuntimeError(f"no end after {limit} rounds")
    found = checkpointed(labels.select("id", F.least("label", "before").alias("label")))
    large = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(large, "label", "left_semi").select("id", "label")


def best_first(seeds: DataFrame, edges: DataFrame, weights: dict[str, float], hops: int, budget: int, decay: float = 0.8, hub: float = 0.1) -> DataFrame:
    """(seed, id, hop, score): of every seed the ``budget`` best new nodes of each hop.

    ``seeds``: id; ``edges``: source, target, type. A step along an edge, either way,
    scores decay times the score before, plus the weight of the type, less ``hub`` for
    each natural logarithm of the target's degree; a node has its best step. A node
    that a seed has reached is not reached again, and only the kept nodes go on, so a
    hop sends at most budget nodes of a seed along their edges.
    """
    both = edges.select("source", "target", "type").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "type")).where("source <> target")
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    gains = both.groupBy("source", "target").agg(F.max(F.coalesce(F.try_element_at(weight, F.col("type")), F.lit(0.0))).alias("gain"))
    degree = gains.groupBy(F.col("source").alias("target")).agg(F.count(F.lit(1)).alias("degree"))
    steps = checkpointed(gains.join(degree, "target").select("source", "target", (F.col("gain") - hub * F.log("degree")).alias("gain")))
    seen = checkpointed(seeds.select(F.col("id").alias("seed"), "id").distinct().select("seed", "id", F.lit(0).alias("hop"), F.lit(0.0).alias("score")))
    for hop in range(1, hops + 1):
        ahead = seen.where(F.col("hop") == hop - 1).join(steps, F.col("id") == F.col("source"))
        reached = ahead.groupBy("seed", F.col("target").alias("id")).agg(F.round(F.max(decay * F.col("score") + F.col("gain")), 6).alias("score")).join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))
        kept = reached.withColumn("place", place).where(F.col("place") <= budget)
        seen = checkpointed(seen.unionByName(kept.select("seed", "id", F.lit(hop).alias("hop"), "score")))
    return seen


def blocked(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, status) of tasks that wait for others: CYCLE, BLOCKED by a missing one at the end of their chain, else READY.

    ``tasks``: id, needs (NULL or empty: nothing), one row each; ``nodes``: rows of
    ``hierarchy`` over them. What the first of a chain needs decides for all behind it.
    """
    lacking = tasks.where("needs <> ''").select(F.col("id").alias("root")).distinct()
    known = nodes.select("node", "root").join(lacking.withColumn("lacks", F.lit(1)), "root", "left")
    return known.select(F.col("node").alias("id"), F.when(F.col("root") == "CYCLE", "CYCLE").when(F.col("lacks") == 1, "BLOCKED").otherwise("READY").alias("status"))
