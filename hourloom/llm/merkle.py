"""A Merkle manifest of a table: a tree of digests per group, a root over the groups, and a proof for every row.

Leaves. A row's leaf is the digest of its columns, each `-` if null, else its UTF-8 byte count, `:` and the value.
Tree. In a group the leaves stand in the order of their ids (nulls first, equal ids by their digests). While several nodes remain,
every FANOUT consecutive ones become their digest; the last run may be shorter. What remains is the group's subroot. The subroots, in the
order of their groups (null first), become the root in the same way. Digests are SHA-256 of the hex digests joined.

Numbering. Rows are sorted into ranges, and a row's number is that of its range's first row plus its place there, so no task holds a
group. Levels are built by one small aggregation each; a run has FANOUT members at most.

Proofs by pointer jumping. Every node points at an ancestor and holds the segment up to it: for each level the digests before it and
after it in its run. At first that is its parent. Then a self-join looks up the ancestor's own ancestor and segment: the distance
doubles and the segments are put one after another, until every leaf points at the root. Only nodes that someone still points at are kept.
The nodes that share an ancestor grow with the distance, so beyond BLOCK_LEVELS levels they join by blocks of FANOUT ** BLOCK_LEVELS
nodes, and an ancestor is copied once for each block below it; what belongs to a whole tree is looked up by block too. So no key has more
rows than a block, however large a group is, and the copies are a 4,096th of the rows.

Defined cases: null ids sort before all others; repeated rows are leaves of their own; an empty table has no leaves, no root and no
proofs; a group of one has its leaf as subroot, and with one group the subroot is the root. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.llm.common import cut, remove, stored

# The columns of a leaf, in order, and the nodes of a run.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
BLOCK_LEVELS = 4
SEGMENT = "array<struct<before:binary,after:binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_text(values: dict[str, Column], columns: tuple[str, ...] = LEAF_COLUMNS) -> Column:
    """What a leaf is the digest of."""
    said = [values[c].cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said])


def leaves(docs: DataFrame, changed: Column | None = None, group: str = "lang") -> DataFrame:
    """id, tree (the group, with null as ''), leaf of every row, and `seen`: the leaf if the text had become `changed`."""
    own = {c: F.col(c) for c in LEAF_COLUMNS}
    leaf = digest(leaf_text(own))
    seen = leaf if changed is None else F.when(F.col("text").eqNullSafe(changed), leaf).otherwise(digest(leaf_text(own | {"text": changed})))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), tree.alias("tree"), leaf.alias("leaf"), seen.alias("seen"))


def up(number: Column, steps: int) -> Column:
    """The number of a node's ancestor so many levels above."""
    return F.floor(number / FANOUT**steps).cast("long")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `number`, the place of a row in its tree (from 0) by the order of the columns. Rows must be stored: they are read twice."""
    # Rows that are the same in all columns may come in any order; telling them apart lets a large group of them be split.
    loose = rows.withColumn("apart", F.monotonically_increasing_id())
    keys = ["tree", *order, "apart"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = loose.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("apart")
    # Within a partition the numbers are consecutive, and the least one of a tree is that of its first row there.
    placed = cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    spans = placed.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(spans.select("part", "tree", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("offset")), "offsets")
    return placed.join(offsets, ["part", "tree"]).withColumn("number", F.col("at") + F.col("offset")).drop("part", "at", "offset")


def of_tree(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Adds what `trees` (tree, size, ...) holds for the tree of each lowest node, by blocks of nodes."""
    blocks = F.sequence(F.lit(0).cast("long"), up(F.col("size") - 1, BLOCK_LEVELS))
    each = trees.withColumn("block", F.explode(blocks)).drop("size")
    return rows.withColumn("block", up(F.col("number"), BLOCK_LEVELS)).join(each, ["tree", "block"]).drop("block")


def run_digest(members: Column) -> Column:
    """Digest of a run, from structs of (number, digest)."""
    return digest(F.array_join(F.transform(F.array_sort(members), lambda m: hex_of(m["digest"])), ""))


def tree_sizes(lowest: DataFrame) -> DataFrame:
    """tree, size, height."""
    sizes = lowest.groupBy("tree").agg(F.count("*").alias("size"))
    powers = F.array(*[F.lit(FANOUT**k).cast("long") for k in range(21)])
    return stored(sizes.withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("size")))), "trees")


def levels(lowest: DataFrame, trees: DataFrame) -> DataFrame:
    """tree, level, number, digest, height of all nodes over (tree, number, digest, ...); further columns are kept on the lowest.

    Each level is an aggregation of an eighth of the rows of the level below.
    """
    level = of_tree(lowest, trees).withColumn("level", F.lit(0))
    made, narrow = level, level.select("tree", "number", "digest", "height")
    for depth in range(1, (trees.agg(F.max("height")).first()[0] or 0) + 1):
        runs = narrow.filter(F.col("height") >= depth).groupBy("tree", up(F.col("number"), 1).alias("number"), "height")
        members = runs.agg(F.collect_list(F.struct("number", "digest")).alias("members"))
        narrow = cut(members.select("tree", "number", run_digest(F.col("members")).alias("digest"), "height"))
        made = made.unionByName(narrow.withColumn("level", F.lit(depth)), allowMissingColumns=True)
    return made


def with_segments(nodes: DataFrame) -> DataFrame:
    """Adds `segment`: the digests before and after a node in its run; none for the top of a tree."""
    run = Window.partitionBy("tree", "level", up(F.col("number"), 1)).orderBy("number")

    def side(first: int, last: int) -> Column:
        return F.aggregate(F.collect_list("digest").over(run.rowsBetween(first, last)), F.lit(b""), lambda a, d: F.concat(a, d))

    step = F.array(F.struct(side(Window.unboundedPreceding, -1).alias("before"), side(1, Window.unboundedFollowing).alias("after")))
    return nodes.withColumn("segment", F.when(F.col("level") < F.col("height"), step).otherwise(F.array().cast(SEGMENT)))


def jump(nodes: DataFrame, highest: int) -> DataFrame:
    """The lowest nodes with the `segment` of their whole way to the top of their tree.

    A node of level l points at its ancestor of level l + distance, or at the top if that is nearer. After a doubling, only levels
    that are multiples of the distance are pointed at; the others are left out.
    """
    spark, distance = nodes.sparkSession, 1
    held = stored(with_segments(nodes), "segments")
    while distance < highest:
        below = held.filter(F.col("level") % (2 * distance) == 0)
        at_top = F.col("level") + distance >= F.col("height")
        shared = min(distance, BLOCK_LEVELS)
        copies = FANOUT ** (distance - shared)
        blocks = F.sequence(F.col("number") * copies, (F.col("number") + 1) * copies - 1)
        above = held.filter(F.col("level") % (2 * distance) == distance).select(
            "tree", (F.col("level") - distance).alias("level"), F.explode(blocks).alias("block"), F.col("segment").alias("more")
        )
        going = below.filter(~at_top).withColumn("block", up(F.col("number"), shared)).join(above, ["tree", "level", "block"])
        further = going.withColumn("segment", F.concat("segment", "more")).select(*held.columns)
        longer = stored(below.filter(at_top).unionByName(further), "segments")
        remove(spark, held)
        held, distance = longer, 2 * distance
    return held.filter(F.col("level") == 0).drop("level", "height")


def top_digests(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("level") == F.col("height")).select("tree", F.col("digest").alias("top"))


def proofs(rows: DataFrame) -> DataFrame:
    """id, leaf, seen, subroot, root and `segment` of every row of `leaves`; the segment leads from the leaf by way of the subroot to the root."""
    lowest = numbered(cut(rows), "id", "leaf").withColumnRenamed("leaf", "digest")
    lowest = cut(lowest)
    trees = tree_sizes(lowest)
    nodes = levels(lowest, trees)
    own = jump(nodes, trees.agg(F.max("height")).first()[0] or 0)

    subroots = cut(top_digests(nodes))
    groups = numbered(subroots.select(F.col("tree").alias("group"), F.lit("").alias("tree"), F.col("top").alias("digest")), "group")
    groups = cut(groups)
    whole = tree_sizes(groups)
    upper = levels(groups, whole)
    ways = jump(upper, whole.agg(F.max("height")).first()[0] or 0)
    root = of_tree(ways, top_digests(upper).join(whole.select("tree", "size"), "tree"))
    known = root.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), F.col("top").alias("root"), F.col("segment").alias("on"))
    shared = stored(known.join(trees.select("tree", "size"), "tree"), "subroots")
    return of_tree(own, shared).select("id", F.col("digest").alias("leaf"), "seen", "subroot", "root", F.concat("segment", "on").alias("segment"))


def fold(leaf: Column, segment: Column) -> Column:
    """Hex digest that a leaf and the digests around it on its way give."""
    step = lambda done, s: F.sha2(F.concat(hex_of(s["before"]), done, hex_of(s["after"])).cast("binary"), 256)
    return F.aggregate(segment, hex_of(leaf), step)


def siblings(segment: Column) -> Column:
    """All sibling digests of a proof in hex, level by level, left to right."""
    return F.array_join(F.transform(segment, lambda s: F.concat(hex_of(s["before"]), hex_of(s["after"]))), "")
