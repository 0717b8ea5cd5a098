"""Walks over the market forest: integrity, path to the root, closure, tree.

A node names its parent by code, so leaves, which are nearly all rows, are never a join target.
The walks run on the referenced nodes alone, level by level or by jumps of doubled length, each round
written to the shared checkpoint folder; the leaves join the finished result once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.functions import columns as C
from salesops.functions.params import check_range
from salesops.operators.joins import lookup_join
from salesops.operators.market import MARKET_COLUMNS
from salesops.plans.lineage import cut, written

# Which column a parent code is matched to.
PARENT_MATCH = {"field_id": "FIELD_ID", "code": "MKT_CODE_OLD"}


def _referenced(market: DataFrame) -> DataFrame:
    """(PARENT_MKT_CODE, children): distinct parent codes, however many children share one."""
    return (
        market.filter(F.col("PARENT_MKT_CODE").isNotNull())
        .groupBy("PARENT_MKT_CODE")
        .agg(F.count("*").alias("children"))
    )


def _known(market: DataFrame, parent_match: str) -> DataFrame:
    if parent_match not in PARENT_MATCH:
        raise ValueError(f"parent_match must be one of {sorted(PARENT_MATCH)}")
    return market.select(F.col(PARENT_MATCH[parent_match]).alias("PARENT_MKT_CODE")).distinct()


def hierarchy_integrity(market: DataFrame, parent_match: str = "field_id") -> DataFrame:
    """Nodes with a parent code, and how many of them name a parent that does not exist."""
    known = _known(market, parent_match).withColumn("exists", F.lit(True))
    return (
        _referenced(market)
        .join(known, "PARENT_MKT_CODE", "left")
        .agg(
            F.coalesce(F.sum("children"), F.lit(0)).alias("total_children"),
            F.coalesce(F.sum(F.when(F.col("exists").isNull(), F.col("children"))), F.lit(0)).alias(
                "issue_count"
            ),
        )
    )


def hierarchy_orphans(
    market: DataFrame, sample: int = 200, parent_match: str = "field_id"
) -> DataFrame:
    """First ``sample`` nodes whose parent does not exist.

    The anti-join compares distinct codes; its usually short answer then selects the nodes.
    """
    check_range("sample", sample, 1, 5000)
    lost = _referenced(market).select("PARENT_MKT_CODE")
    lost = cut(lost.join(_known(market, parent_match), "PARENT_MKT_CODE", "left_anti"))
    nodes = market.select("FIELD_ID", "PARENT_MKT_CODE")
    return (
        lookup_join(nodes, lost, "PARENT_MKT_CODE", "left_semi")
        .select(
            F.col("FIELD_ID").alias("child_field_id"),
            F.col("PARENT_MKT_CODE").alias("parent_code"),
            F.lit(1).alias("missing_parent"),
        )
        .orderBy("child_field_id", "parent_code")
        .limit(sample)
    )


def hierarchy_path(market: DataFrame, field_id: str, max_steps: int = 10) -> DataFrame:
    """The node with this id or code, its parent, and so on for at most ``max_steps`` steps.

    Starts from the seed rows and climbs the inner nodes level by level; the market itself is read
    for the seed and for its inner nodes. Rows that share a code are all followed, so a step holds
    as many rows as there are ways up.
    """
    check_range("max_steps", max_steps, 1, 50)
    shown = ["FIELD_ID", "MKT_NAME", "MKT_LEVEL", "PARENT_MKT_CODE"]
    seed = market.filter((F.col("FIELD_ID") == field_id) | (F.col("MKT_CODE_OLD") == field_id))
    current = cut(seed.select(*shown, F.lit(0).alias("depth")))
    internal = written(_internal(market, cut(_referenced(market))).select("MKT_CODE_OLD", *shown), "inner-nodes")
    levels = [current]
    for depth in range(1, max_steps + 1):
        wanted = current.select(F.col("PARENT_MKT_CODE").alias("MKT_CODE_OLD"))
        found = lookup_join(wanted.filter(F.col("MKT_CODE_OLD").isNotNull()), internal, "MKT_CODE_OLD")
        current = cut(found.select(*shown, F.lit(depth).alias("depth")))
        if current.isEmpty():
            break
        levels.append(current)
    return reduce(DataFrame.unionByName, levels).orderBy("depth")


def _internal(market: DataFrame, referenced: DataFrame) -> DataFrame:
    """Rows that some node names as its parent."""
    codes = referenced.select(F.col("PARENT_MKT_CODE").alias("MKT_CODE_OLD"))
    return lookup_join(market.select(*MARKET_COLUMNS), codes, "MKT_CODE_OLD", "left_semi")


def hierarchy_closure(market: DataFrame, max_steps: int = 10) -> DataFrame:
    """(node_id, ancestor_id, ancestor_level, depth): ``hierarchy_path`` of every node at once.

    Depth 0 is the node itself. Rows that share a code are all followed, cycles end after
    ``max_steps``. Rows of one code that agree in id, level and parent are walked once, with the
    number of ways, so that rows sharing codes do not multiply level by level on the way up.
    """
    check_range("max_steps", max_steps, 1, 50)
    internal = _internal(market, cut(_referenced(market)))
    step = cut(
        internal.groupBy(
            F.col("MKT_CODE_OLD").alias("next_code"),
            F.col("FIELD_ID").alias("ancestor_id"),
            C.whole_number(market, "MKT_LEVEL").alias("ancestor_level"),
            F.col("PARENT_MKT_CODE").alias("parent"),
        ).agg(F.count("*").alias("same"))
    )
    reached = cut(
        step.select(
            F.col("next_code").alias("code"), "ancestor_id", "ancestor_level", "parent",
            F.col("same").alias("ways"), F.lit(1).alias("depth"),
        )
    )
    levels = [reached]
    while len(levels) < max_steps:
        onward = (
            reached.filter(F.col("parent").isNotNull())
            .groupBy("code", "depth", F.col("parent").alias("next_code"))
            .agg(F.sum("ways").alias("ways"))
        )
        above = lookup_join(cut(onward), step, "next_code")
        reached = cut(
            above.groupBy("code", "ancestor_id", "ancestor_level", "parent", (F.col("depth") + 1).alias("depth"))
            .agg(F.sum(F.col("ways") * F.col("same")).alias("ways"))
        )
        if reached.isEmpty():
            break
        levels.append(reached)
    every_way = F.explode(F.sequence(F.lit(1).cast("long"), F.col("ways")))
    ancestors = (
        reduce(DataFrame.unionByName, levels)
        .select(F.col("code").alias("PARENT_MKT_CODE"), "ancestor_id", "ancestor_level", "depth", every_way)
        .drop("col")
    )
    nodes = market.select(F.col("FIELD_ID").alias("node_id"), "PARENT_MKT_CODE")
    above = lookup_join(nodes.filter(F.col("PARENT_MKT_CODE").isNotNull()), ancestors, "PARENT_MKT_CODE")
    itself = market.select(
        F.col("FIELD_ID").alias("node_id"),
        F.col("FIELD_ID").alias("ancestor_id"),
        C.whole_number(market, "MKT_LEVEL").alias("ancestor_level"),
        F.lit(0).alias("depth"),
    )
    return itself.unionByName(above.drop("PARENT_MKT_CODE"))


def _placed(marked: DataFrame) -> DataFrame:
    """(code, root_code, depth, path) of the codes that have a root, from (code, parent, known).

    Every code holds how far it has come (``up``, none once the root is met), in how many steps and past
    which codes, and takes over what the code it has come to holds: after r rounds 2**r steps are done. A code
    of any depth has one of half that depth above it, so a round in which no code meets its root leaves
    those on cycles, and below them, alone; their paths are no longer than twice the longest one.
    """
    known = F.col("known").isNotNull()
    jump = marked.select(
        "code",
        F.when(known, F.col("parent")).alias("up"),
        F.when(~known, F.col("code")).alias("root_code"),
        F.when(known, 1).otherwise(0).alias("depth"),
        F.col("code").alias("path"),
    )
    left = jump.filter("up IS NOT NULL").count()
    while left:
        upper = jump.select(F.col("code").alias("up"), *[F.col(c).alias(f"upper_{c}") for c in ("up", "root_code", "depth", "path")])
        # All rows take part, those without a jump unchanged, so that no round adds partitions.
        moved = lookup_join(jump, upper, "up", "left")
        jump = cut(
            moved.select(
                "code",
                F.col("upper_up").alias("up"),
                F.coalesce("root_code", "upper_root_code").alias("root_code"),
                (F.col("depth") + F.coalesce("upper_depth", F.lit(0))).alias("depth"),
                F.concat_ws("/", "upper_path", "path").alias("path"),
            )
        )
        before, left = left, jump.filter("up IS NOT NULL").count()
        if left == before:
            break
    return jump.filter("up IS NULL").drop("up")


def market_tree(market: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Every node with its place in the forest.

    Adds ``is_root``, ``root_code``, ``depth``, ``path`` (codes from the root down, joined by
    ``/``), ``n_children`` and ``reachable``. A node whose parent code is missing or unknown is
    a root; of rows that share a code the last by level, name and id is the parent of that
    code's children. Nodes on a cycle, or below one, have no path and are not reachable; any depth
    is. The children of a node are the rows that carry its code as parent: a nested list would put
    all children of a hot parent into one row.

    Inner codes find their root by jumps of doubled length, so the rounds grow with the logarithm of
    the depth.
    """
    nodes = market.select(*MARKET_COLUMNS).withColumn("MKT_LEVEL", C.whole_number(market, "MKT_LEVEL"))
    if max_nodes is not None:
        check_range("max_nodes", max_nodes, 1, 20_000)
        nodes = nodes.orderBy("MKT_LEVEL", "MKT_NAME", "FIELD_ID").limit(max_nodes)
    # An empty parent code counts as none.
    referenced = cut(_referenced(nodes.filter(F.col("PARENT_MKT_CODE") != "")))
    place = F.struct("MKT_LEVEL", "MKT_NAME", "FIELD_ID")
    # One row per referenced code.
    internal = cut(
        _internal(nodes, referenced)
        .groupBy(F.col("MKT_CODE_OLD").alias("code"))
        .agg(F.max_by("PARENT_MKT_CODE", place).alias("parent"), F.max(place).alias("holder"))
    )
    parents = internal.select(F.col("code").alias("parent"), F.lit(True).alias("known"))
    marked = cut(lookup_join(internal.select("code", "parent"), parents, "parent", "left"))
    placed = _placed(marked)

    # A known parent without a path lies on a cycle or below one; an unknown one makes a root.
    above = cut(
        internal.select("code").join(placed, "code", "left").select(
            F.col("code").alias("PARENT_MKT_CODE"),
            F.col("root_code").alias("parent_root"),
            F.col("depth").alias("parent_depth"),
            F.col("path").alias("parent_path"),
            F.lit(True).alias("parent_known"),
        )
    )
    children = cut(
        internal.select(F.col("code").alias("PARENT_MKT_CODE"), "holder")
        .join(referenced, "PARENT_MKT_CODE")
        .withColumnRenamed("PARENT_MKT_CODE", "MKT_CODE_OLD")
    )
    linked = lookup_join(nodes, above, "PARENT_MKT_CODE", "left")
    counted = lookup_join(linked, children, "MKT_CODE_OLD", "left")
    is_root = F.col("parent_known").isNull()
    own = F.col("MKT_CODE_OLD")
    return counted.select(
        *MARKET_COLUMNS,
        is_root.alias("is_root"),
        F.when(is_root, own).otherwise(F.col("parent_root")).alias("root_code"),
        F.when(is_root, 0).otherwise(F.col("parent_depth") + 1).alias("depth"),
        F.when(is_root, own)
        .when(F.col("parent_path").isNotNull(), F.concat_ws("/", "parent_path", own))
        .alias("path"),
        F.when(place == F.col("holder"), F.col("children")).otherwise(0).alias("n_children"),
        (is_root | F.col("parent_path").isNotNull()).alias("reachable"),
    )
