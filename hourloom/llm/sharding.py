"""Sharding by fixed virtual slots.

Records are hashed into N_SLOTS slots. Bytes are added up per slot, and a versioned map says which shard a slot belongs to.
The first version deals slots, largest first, to the shard with the least bytes. Later versions are edits: `rebalance` moves
slots off overfull shards, `grow` fills added shards; a slot that is not named by the edit stays where it is. The map has one row
per slot and version, so all work on it is bounded by the number of slots, whatever the data.

Law of the result: `bytes` (shard sizes are near equal). A record's slot depends on its own columns alone; its shard on the map.

Defined cases: a null text has no bytes and crc 0; a null id is a value like any other; repeated rows are told apart by a copy
number and may fall into different slots; an empty table gives an empty result and a map that deals empty slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_SLOTS = 4096
OVERHEAD = 16
TOLERANCE = 0.01


#: Columns that a record's slot depends on.
SLOT_KEY = ("doc_id", "size", "text_crc32", "copy")
#: Rows of one key are numbered in so many parts.
COPY_PARTS = 1024


def record_columns() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"size": (F.octet_length(text) + OVERHEAD).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}


def record_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, copy: one row per document without its text; copy numbers rows that are otherwise the same."""
    made = record_columns()
    same = docs.select("doc_id", *[c.alias(n) for n, c in made.items()]).groupBy("doc_id", "size", "text_crc32").count()
    # Many copies are first counted in chunks, so no row becomes one long list.
    chunks = same.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / COPY_PARTS))))
    first = F.col("chunk") * COPY_PARTS
    return chunks.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first + 1, F.least(first + COPY_PARTS, "count"))).alias("copy"))


def slot_of(*columns: str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*(columns or SLOT_KEY)), F.lit(n_slots)).cast("int")


def slot_totals(spark: SparkSession, records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows for every slot, empty ones too."""
    totals = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(totals), "virtual_slot", "left").fillna(0, ["bytes", "rows"])  # totals: n_slots rows at most


def _listed(totals: DataFrame, *extra: str) -> DataFrame:
    """All slots in one row, largest first, then by number."""
    item = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", *extra)
    return totals.agg(F.sort_array(F.collect_list(item)).alias("slots"))


def _put(loads: Column, at: Column, change: Column) -> Column:
    return F.transform(loads, lambda load, i: F.when(i == at, load + change).otherwise(load))


def _rows(walked: DataFrame, version: int) -> DataFrame:
    each = walked.select(F.explode(F.arrays_zip("slots.virtual_slot", "done.shards")).alias("m"))
    return each.select(F.lit(version).alias("version"), F.col("m.virtual_slot").alias("virtual_slot"), F.col("m.shards").alias("shard"))


def first_map(totals: DataFrame, n_shards: int) -> DataFrame:
    """version 1: slots, largest first, each to the shard that has the least bytes so far."""

    def deal(done: Column, s: Column) -> Column:
        at = (F.array_position(done["loads"], F.array_min(done["loads"])) - 1).cast("int")
        # One byte more for each slot deals empty slots evenly.
        return F.struct(_put(done["loads"], at, s["bytes"] + 1).alias("loads"), F.concat(done["shards"], F.array(at)).alias("shards"))

    empty = F.array_repeat(F.lit(0).cast("long"), n_shards)
    start = F.struct(empty.alias("loads"), F.array().cast("array<int>").alias("shards"))
    return _rows(_listed(totals).select("slots", F.aggregate("slots", start, deal).alias("done")), 1)


def rebalance(slot_map: DataFrame, totals: DataFrame, n_shards: int, tolerance: float = TOLERANCE, first_target: int = 0) -> DataFrame:
    """The next version of a map (all rows of one version): slots leave shards that are over the mean, while that lowers the larger of both.

    They go to the shard with the least bytes among those from `first_target` on.
    """
    version = slot_map.agg(F.max("version")).first()[0]
    now = totals.join(slot_map.select("virtual_slot", "shard"), "virtual_slot")
    listed = _listed(now, "shard")
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + F.when(s["shard"] == i, s["bytes"]).otherwise(0)),
    )
    mean = F.aggregate("slots", F.lit(0).cast("double"), lambda a, s: a + s["bytes"]) / n_shards

    def move(done: Column, s: Column) -> Column:
        own = F.element_at(done["loads"], s["shard"] + 1)
        targets = F.slice(done["loads"], F.lit(first_target + 1), F.lit(n_shards - first_target))
        least = F.array_min(targets)
        at = (F.array_position(targets, least) - 1 + first_target).cast("int")
        moves = (s["bytes"] > 0) & (own > done["mean"] * (1 + tolerance)) & (least + s["bytes"] < own)
        changed = F.struct(
            _put(_put(done["loads"], at, s["bytes"]), s["shard"], -s["bytes"]).alias("loads"), done["mean"].alias("mean"), F.concat(done["shards"], F.array(at)).alias("shards")
        )
        stays = F.struct(done["loads"].alias("loads"), done["mean"].alias("mean"), F.concat(done["shards"], F.array(s["shard"])).alias("shards"))
        return F.when(moves, changed).otherwise(stays)

    start = F.struct(loads.alias("loads"), mean.alias("mean"), F.array().cast("array<int>").alias("shards"))
    return _rows(listed.select("slots", F.aggregate("slots", start, move).alias("done")), version + 1)


def grow(slot_map: DataFrame, totals: DataFrame, n_shards: int, added: int = 1) -> DataFrame:
    """The next version with more shards: the mean falls, and slots move into the added shards only."""
    return rebalance(slot_map, totals, n_shards + added, 0.0, n_shards)


def save_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Adds a version to the stored map (a version written again replaces itself) and reads that version back."""
    spark = slot_map.sparkSession
    writer = slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("version").parquet(path)
    return load_map(spark, path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest by default."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    wanted = every.agg(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def place(records: DataFrame, totals: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds `shard` and `slot`, the place of a row in its shard (gapless from 0).

    The place is the number of rows in the shard's earlier virtual slots plus the place in the own one, so no shard is sorted
    as a whole; a window covers one virtual slot.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = totals.join(slot_map.select("virtual_slot", "shard"), "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "copy")
    numbered = records.withColumn("inside", F.row_number().over(inside))
    placed = numbered.join(F.broadcast(slots), "virtual_slot")  # one row per slot
    return placed.withColumn("slot", (F.col("before") + F.col("inside") - 1).cast("long")).drop("before", "inside")


def with_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and a struct) with size, text_crc32 and copy as in `record_rows`, each row a copy of its own. docs must read the same way twice.

    Rows of one key are dealt to parts; a row's number is its place in the part after the rows of the parts before, so a
    key of any size is numbered by many tasks.
    """
    key = ["doc_id", "size", "text_crc32"]
    marked = docs.withColumns(record_columns()).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(COPY_PARTS)))
    counts = marked.groupBy(*key, "part").count()
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.struct(*key).alias("of"), F.col("part").alias("in_part"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(0)))
    numbered = marked.withColumn("inside", inside)
    joined = numbered.join(before.filter("before > 0"), F.struct(*key).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")), "left")
    return joined.withColumn("copy", F.col("inside") + F.coalesce("before", F.lit(0))).drop("part", "inside", "of", "in_part", "before")


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, n_slots: int = N_SLOTS, parts: int = 8) -> None:
    """Writes whole documents under shard=<n>/, each shard in `parts` files, by the slots that the map was made for. All columns are kept; none may be named shard."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the column shard is made here")
    nested = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = with_copies(nested).withColumn("virtual_slot", slot_of(n_slots=n_slots))
    placed = keyed.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")  # n_slots rows
    dealt = placed.withColumn("part", F.pmod("virtual_slot", F.lit(parts))).repartition("shard", "part")
    dealt.select("row.*", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
