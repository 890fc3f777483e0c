"""Parent-child rows to full hierarchies, as nested-set ranges.

Sizes of subtrees are summed upward, preorder ranges are allocated downward by
prefix sums over siblings, and a node's range [preorder, preorder + size) then
holds exactly its descendants. Both directions walk by pointer doubling, so the
number of rounds is the logarithm of the depth; nodes that the upward rounds never
finish hang in, or below, a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.sharded import prefix_sum, running
from quern.session import checkpointed

CYCLE = "CYCLE"
#: Preorder numbers per block of the range join of ``descendants``.
BLOCK = 16


def _latest(rows: DataFrame, id_col: str, parent_col: str, version_col: str, order_col: str | None) -> DataFrame:
    """(node, parent, position) of the row that counts of each id; the parent as it stands there."""
    position = F.col(order_col) if order_col else F.lit(None).cast("int")
    return (
        rows.select(F.col(id_col).alias("node"), F.struct(F.col(version_col).alias("v"), F.col(parent_col).alias("parent"), position.alias("position")).alias("row"))
        .where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.max("row").alias("row"))
        .select("node", F.nullif(F.col("row.parent"), F.lit("")).alias("parent"), F.col("row.position").alias("position"))
    )


def latest_parents(rows: DataFrame, id_col: str, parent_col: str, version_col: str, order_col: str | None) -> DataFrame:
    """One row per id: node, parent (NULL for a root) and sibling position.

    The row with the greatest ``version_col`` counts; of equal ones the greatest
    parent, then the greatest position, so that any delivery order gives the same.
    A parent that is NULL, empty or no id of the table makes a root. Rows with a
    NULL id are no nodes and are left out.
    """
    latest = checkpointed(_latest(rows, id_col, parent_col, version_col, order_col))
    known = latest.select(F.col("node").alias("known"))
    return latest.join(known, F.col("parent") == F.col("known"), "left").select("node", F.col("known").alias("parent"), "position")


def _numbered(rows: DataFrame, id_col: str, parent_col: str, version_col: str, order_col: str | None) -> DataFrame:
    """``latest_parents`` with numbers for ids: id, up (the parent's, NULL for a root), node, parent, position.

    The numbers are given once, to the written rows, and carried instead of the ids.
    """
    latest = checkpointed(_latest(rows, id_col, parent_col, version_col, order_col).withColumn("id", F.monotonically_increasing_id()))
    known = latest.select(F.col("node").alias("known"), F.col("id").alias("up"))
    return checkpointed(latest.join(known, F.col("parent") == F.col("known"), "left").select("id", "up", "node", F.col("known").alias("parent"), "position"))


def _subtree_sizes(edges: DataFrame) -> DataFrame:
    """(id, more, open): nodes below each inner node; open ones were never finished, so they reach no root.

    After round k a node points to its 2^k-th ancestor and knows its descendants
    nearer than 2^k. A node without such an ancestor is finished and set aside: only
    open nodes are joined again, and what is sent to the finished is summed at the end.
    Depths have no holes, hence a round that finishes nobody means that no deeper
    tree node exists.
    """
    state = checkpointed(edges.where("up IS NOT NULL").select("id", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size")))
    waiting = state.count()
    sent = [state]
    while waiting:
        below = state.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        further = state.join(ahead, "jump").select("id", F.col("next").alias("jump"), "size")
        state = checkpointed(further.join(below, "id", "left").select("id", "jump", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        now = state.count()
        if now == waiting:
            break
        waiting = now
        sent.append(state)
    told = state.select("id", F.lit(0).cast("long").alias("more"), F.lit(True).alias("open"))
    for s in sent:
        told = told.unionByName(s.select(F.col("jump").alias("id"), F.col("size").alias("more"), F.lit(False).alias("open")))
    return told.groupBy("id").agg(F.sum("more").alias("more"), F.max("open").alias("open"))


def _preorders(tree: DataFrame, with_path: bool) -> DataFrame:
    """(id, preorder, path if asked) of every tree node, numbered over all trees.

    ``tree``: id, up, before (sizes of the siblings before, of roots too), node if the
    path is asked. A node's number is its parent's, plus one, plus the sizes of the
    siblings before it: the sum of such steps up to the root, by pointer doubling over
    unfinished nodes. The path joins the ids on the same way.
    """
    step = F.when(F.col("up").isNull(), F.col("before")).otherwise(F.col("before") + 1).cast("long")
    path = ["path"] if with_path else []
    state = checkpointed(tree.select("id", F.col("up").alias("jump"), step.alias("preorder"), *([F.col("node").alias("path")] if with_path else [])))
    done, waiting = state.where("jump IS NULL"), state.where("jump IS NOT NULL")
    while waiting.limit(1).count():
        ahead = done.unionByName(waiting).select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("preorder").alias("more"), *[F.col(c).alias("front") for c in path])
        further = waiting.join(ahead, "jump")
        state = checkpointed(further.select("id", F.col("next").alias("jump"), (F.col("preorder") + F.col("more")).alias("preorder"), *[F.concat_ws("/", "front", c).alias(c) for c in path]))
        done, waiting = done.unionByName(state.where("jump IS NULL")), state.where("jump IS NOT NULL")
    return done.select("id", "preorder", *path)


def hierarchy(rows: DataFrame, id_col: str, parent_col: str, version_col: str, order_col: str | None = None, with_path: bool = True) -> DataFrame:
    """One row per distinct id: node, parent, root, depth, preorder, size and, if asked, path.

    A root has depth 0 and itself as root. ``path`` joins the ids from the root to
    the node by ``/``. ``preorder`` counts from 0 within a root, siblings in the
    order of ``order_col``, then id; [preorder, preorder + size) are the node and
    its descendants. Nodes on or below a circle have root ``CYCLE``, depth -1 and
    NULL in parent, preorder, size and path. An empty input gives no rows;
    repeated rows change nothing.

    Root and depth are read from the ranges: numbered over all trees, the ranges that
    are open where a node's begins are those of its ancestors, and the last root that
    began is its own. One sharded sweep over begins and ends gives both.
    """
    edges = _numbered(rows, id_col, parent_col, version_col, order_col)
    sized = _subtree_sizes(edges)
    known = checkpointed(edges.join(sized, "id", "left").select(*edges.columns, (F.coalesce("more", F.lit(0)) + 1).alias("size"), F.coalesce("open", F.lit(False)).alias("open")))
    nodes = known.where("NOT open")
    order = ["position", "node"] if order_col else ["id"]
    tree = prefix_sum(nodes.select("id", "up", "size", *dict.fromkeys([*(order if order_col else []), *(["node"] if with_path else [])])), ["up"], order, "size", "before")
    path = ["path"] if with_path else []
    numbered = nodes.join(_preorders(tree, with_path), "id").select("id", "node", "parent", "size", "preorder", *path)
    # an end comes before the begin at the same number
    begin = F.when(F.col("parent").isNull(), F.struct(F.col("node").alias("root"), F.col("preorder").alias("start")))
    swept = running(
        numbered.withColumn("root_of", begin).withColumn("event", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
            F.when(F.col("event") == 1, F.col("preorder")).otherwise(F.col("preorder") + F.col("size")).alias("at"), "event",
            *[F.when(F.col("event") == 1, F.col(c)).alias(c) for c in ("id", "node", "parent", "size", "root_of", *path)],
        ),
        [], ["at", "event", "id"], {"depth": "event"}, {"of": "root_of"},
    )
    found = swept.where("event = 1").select(
        "node", "parent", F.col("of.root").alias("root"), F.col("depth").cast("int").alias("depth"), (F.col("at") - F.col("of.start")).alias("preorder"), "size", *path
    )
    circles = known.where("open").select("node", F.lit(CYCLE).alias("root"), F.lit(-1).alias("depth"))
    return found.unionByName(circles, allowMissingColumns=True)


def descendants(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant, distance) of every pair, from the ranges of ``hierarchy``; with ``of`` (node), of those ancestors only.

    A range join in blocks of preorder numbers: a node that has descendants is sent
    to the blocks its range touches, every node to the one block it lies in. What is
    compared is at most the true pairs and two blocks more for each inner node.
    Nodes on or below a circle have no pairs.
    """
    inner = nodes.where("size > 1")
    inner = (inner if of is None else inner.join(of.select("node").distinct(), "node", "left_semi")).select(
        F.col("node").alias("ancestor"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("preorder").alias("first"), (F.col("preorder") + F.col("size")).alias("end"),
        F.explode(F.sequence(F.floor((F.col("preorder") + 1) / BLOCK), F.floor((F.col("preorder") + F.col("size") - 1) / BLOCK))).alias("a_block"),
    )
    placed = nodes.where("preorder > 0").select(F.col("node").alias("descendant"), "root", "depth", "preorder", F.floor(F.col("preorder") / BLOCK).alias("block"))
    within = (F.col("root") == F.col("a_root")) & (F.col("block") == F.col("a_block")) & (F.col("preorder") > F.col("first")) & (F.col("preorder") < F.col("end"))
    return placed.join(inner, within).select("ancestor", "descendant", (F.col("depth") - F.col("a_depth")).alias("distance"))
