"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets. Every source gets its share by weight of all words, at most EPOCHS times its own; what is over goes to the others by
   weight. That is one level of filling: target = min(EPOCHS * size, level * weight), found by sorting the sources.
2. Blocks. The documents of a source, in a seeded order, form one stream of words, cut into blocks of B words (the last may be
   shorter). B is a 64th of the smallest source with words, from 1 to 1,024.
   A block is a unit of account: what is selected is a run of blocks, so documents inside it stay whole however short a block is.
3. Quotas. Blocks go to the sources with the highest quotients target / (2 k - 1), k = 1, 2, ..., down to the quotient of half a
   block: a source gets floor(target / B + 1/2) blocks. In this order they fill the shards of the mix, so shard j of n has
   the quotas floor((j + 1) target / (n B) + 1/2) - floor(j target / (n B) + 1/2), capped by what the source may give in all.
4. Selection. The k-th award of a source is the block k - 1 places after a seeded first one, around the source's stream, which is in
   a seeded order itself: full passes over the source, then one run of blocks. Only the two documents at the ends of the run are cut,
   and a block is never taken more often than EPOCHS times. The shard of an award follows from the quotas per shard; a document goes, each
   time it is taken, to the shard of the award that its first taken word falls into, so shards do not cut documents either. Reruns agree.

Defined cases: null texts have no words and are not taken; documents without source form a source of their own, the last;
repeated rows are documents of their own; with no words at all, all targets are 0. Other columns are ignored or kept as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.llm.common import cut, fresh, let

# The pattern of a word, the weights by position of the source.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
BLOCK_PARTS, LARGEST_BLOCK = 64, 1024
#: A source's stream is ordered by digests, in this many leading hex digits of which its documents are dealt to tasks.
BUCKET_DIGITS = 3
#: Shards of the mix.
SHARDS = 16


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """One narrow row per document: doc_id, source, size, place (its digest in the stream), bucket, and columns to keep."""
    place = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), place.alias("place"), *keep)
    return narrow.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """From (source, source_size): position, weight, target, block, n_blocks, quota, first_block; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("ceiling") / F.col("weight"), "position")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("position") - 1) % len(weights)).cast("int"))
    ranked = sizes.withColumn("position", F.row_number().over(order)).withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * epochs)
    total = F.sum("source_size").over(everything)
    levels = ranked.withColumns(
        {"left": total - F.coalesce(F.sum("ceiling").over(before), F.lit(0)), "open": F.sum("weight").over(rest),
         "smallest": F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything)}
    ).withColumn("fits", F.col("left") * F.col("weight") / F.col("open") <= F.col("ceiling"))
    # The first source, in order of filling, whose share fits under its ceiling sets the level for itself and all after it.
    chosen = F.min(F.when(F.col("fits"), F.struct(F.col("ceiling") / F.col("weight"), "position", "left", "open"))).over(everything)
    leveled = levels.withColumn("level", chosen).withColumn(
        "target", F.least(F.col("ceiling").cast("double"), F.coalesce(F.col("level.left") * F.col("weight") / F.col("level.open"), F.lit(0.0)))
    )
    block = F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(F.coalesce("smallest", F.lit(0)) / BLOCK_PARTS))).cast("long")
    planned = leveled.withColumn("block", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    quota = F.least(F.floor(F.col("target") / F.col("block") + 0.5).cast("long"), F.col("n_blocks") * epochs)
    digest = F.md5(F.concat(F.lit(f"{SEED}:source:"), F.coalesce("source", F.lit(""))).cast("binary"))
    first = F.when(F.col("n_blocks") > 0, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n_blocks"))
    return planned.withColumns({"quota": quota, "first_block": first}).select(
        "source", "source_size", "position", "weight", "target", "block", "n_blocks", "quota", "first_block"
    )


def shard_quotas(plan: DataFrame, n_shards: int) -> DataFrame:
    """source, shard, blocks: how many blocks each shard of the mix takes from each source, in the order of the quotients."""

    def up_to(shard: Column) -> Column:
        return F.least(F.floor(shard * F.col("target") / (F.col("block") * n_shards) + 0.5), F.col("quota"))

    each = plan.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    upper = F.when(F.col("shard") == n_shards - 1, F.col("quota")).otherwise(up_to(F.col("shard") + 1))
    return each.select("source", "shard", (upper - up_to(F.col("shard"))).cast("long").alias("blocks"))


def with_shards(plan: DataFrame, n_shards: int) -> DataFrame:
    """Adds `filled`: for every shard the number of a source's awards up to its end."""
    each = shard_quotas(plan, n_shards).groupBy(F.col("source").alias("named")).agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("quotas"))
    up_to = F.transform("quotas", lambda q: F.aggregate(F.slice("quotas", 1, q["shard"] + 1), F.lit(0).cast("long"), lambda a, x: a + x["blocks"]))
    return plan.join(each, plan["source"].eqNullSafe(each["named"])).withColumn("filled", up_to).drop("named", "quotas")


def place_documents(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the columns of the plan and `start`, the first word of the document in its source's stream.

    The stream is cut by leading digits of the digest: totals per (source, bucket) are added up over the small table of buckets,
    and a window covers one bucket, so a source of any share of the rows is spread over thousands of tasks.
    """
    keyed = rows.withColumn("named", F.coalesce("source", F.lit(""))).withColumn("known", F.col("source").isNotNull())
    key = ["named", "known", "bucket"]
    totals = keyed.groupBy(*key).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("named", "known").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    planned = plan.withColumn("named", F.coalesce("source", F.lit(""))).withColumn("known", F.col("source").isNotNull()).drop("source")
    buckets = totals.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").join(planned, ["named", "known"])
    inside = Window.partitionBy(*key).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return counted.join(buckets, key).withColumn("start", F.col("base") + F.col("inside")).drop("named", "known", "base", "inside")


def select_blocks(placed: DataFrame) -> DataFrame:
    """Adds `whole` (how often the mix takes the document in full passes), `pieces` (array<struct<first, last, shard>>, words taken once more) and `shards` (of the full passes)."""
    passes = F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(0).cast("int")
    left, end, block = F.col("quota") % F.col("n_blocks"), F.col("start") + F.col("size"), F.col("block")
    run_end = F.col("first_block") + left

    def shard_at(word: Column, done: Column) -> Column:
        """Shard of the award that a word of the stream falls into, after so many full passes."""
        award = done * F.col("n_blocks") + F.pmod(F.floor(word / block) - F.col("first_block"), F.col("n_blocks"))
        return F.size(F.filter("filled", lambda f: f <= award))

    def piece(lo: Column, hi: Column) -> Column:
        first, last = F.greatest(lo * block, F.col("start")), F.least(hi * block, end)
        return F.struct((first - F.col("start")).alias("first"), (last - F.col("start")).alias("last"), shard_at(first, passes).alias("shard"))

    # The run, and its part around the end of the stream.
    both = F.array(piece(F.lit(0).cast("long"), F.greatest(run_end - F.col("n_blocks"), F.lit(0))), piece(F.col("first_block"), F.least(run_end, F.col("n_blocks"))))
    some = (F.col("size") > 0) & (left > 0)
    pieces = F.when(some, F.filter(both, lambda p: p["first"] < p["last"])).otherwise(F.array().cast("array<struct<first:bigint,last:bigint,shard:int>>"))
    full = F.when((F.col("size") > 0) & (passes > 0), F.transform(F.sequence(F.lit(0), passes - 1), lambda p: shard_at(F.col("start"), p)))
    return placed.withColumn("whole", passes).withColumn("pieces", pieces).withColumn("shards", F.coalesce(full, F.array().cast("array<int>")))


def mix(docs: DataFrame, *keep: str, n_shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole, pieces, taken, shard (where it is taken first) and columns to keep."""
    rows = cut(sized_rows(docs, *keep))
    plan = cut(with_shards(cut(source_plan(rows.groupBy("source").agg(F.sum("size").alias("source_size")))), n_shards))
    chosen = select_blocks(place_documents(rows, plan))
    more = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"])
    first = F.get(F.concat("shards", F.transform("pieces", lambda p: p["shard"])), F.lit(0))
    return chosen.withColumn("taken", F.col("whole") * F.col("size") + more).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "pieces", "taken", first.alias("shard"), *keep
    )


def mixed_documents(docs: DataFrame, n_shards: int = SHARDS, shard: str | None = None) -> DataFrame:
    """The mix itself, with the columns of docs (n_chars, if there, counts the row's text): a row per full pass over a document, and one with the words of the last run.

    The words of a cut document keep the white space between them; if a run ends and begins in one document, its parts are joined by a
    newline. With a name for `shard` the shard of the row comes too.
    """
    rest, = fresh(docs, "rest")
    names = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    nested = docs.select("doc_id", "source", "text", F.struct("text", *[F.col(f"`{c}`") for c in names]).alias(rest))
    rows = sized_rows(nested)
    plan = cut(with_shards(cut(source_plan(cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))), n_shards))
    chosen = select_blocks(place_documents(sized_rows(nested, rest), plan))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    read = chosen.select("doc_id", "source", "size", "shards", F.col(f"{rest}.text").alias("text"), rest, "pieces")
    complete = (F.size("pieces") == 1) & (F.col("pieces")[0]["last"] - F.col("pieces")[0]["first"] == F.col("size"))

    def piece_text(w: Column, p: Column) -> Column:
        return F.array_join(F.slice(w, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")), "")

    cut_text = let(words, lambda w: F.array_join(F.transform("pieces", lambda p: piece_text(w, p)), "\n"))
    run_text = F.when(complete, F.col("text")).otherwise(cut_text)
    last = F.when(F.size("pieces") > 0, F.array(F.struct(run_text.alias("text"), F.col("pieces")[0]["shard"].alias("shard"))))
    every = F.concat(F.transform("shards", lambda s: F.struct(F.col("text").alias("text"), s.alias("shard"))), F.coalesce(last, F.array().cast("array<struct<text:string,shard:int>>")))
    each = read.select("doc_id", "source", rest, F.explode(every).alias("taken"))
    made = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("taken.text")}
    columns = [made.get(c, F.length("taken.text").cast("long") if c == "n_chars" else F.col(f"{rest}.`{c}`")).alias(c) for c in docs.columns]
    return each.select(*columns, *([F.col("taken.shard").alias(shard)] if shard else []))
