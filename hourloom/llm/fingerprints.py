"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All shingles (five words; a shorter text is one shingle) are hashed once. The upper bits of a hash name its bin, the least rest per
bin is kept. An empty bin takes the value of the first filled bin in a probe sequence that depends on the bin alone, so two texts
that lack the same bin look at the same others. Of every value the lowest BITS bits are stored, 16 to a 64-bit word.

Likeness of two fingerprints: the share of equal values m, corrected for equality by chance, (m - 2^-BITS) / (1 - 2^-BITS), within
0 and 1. Its standard error is about sqrt(J (1 - J) / BINS).

Defined cases: null text is empty; a text without words has an empty fingerprint, like 1 to another such text and 0 to any other;
equal texts have equal fingerprints; other columns are kept.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.llm.common import fresh, let

SHINGLE = 5
BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS
SHIFT = 63 - BIN_BITS
TOP = (1 << SHIFT) - 1
PROBES, SEED = 24, 20240229
PER_WORD = 64 // BITS
LOWEST_BITS = sum(1 << (BITS * i) for i in range(PER_WORD))
FIRST_ID = -(1 << 63)


def shingle_hashes(text: Column) -> Column:
    """63-bit hashes of all runs of SHINGLE words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        # A slice ends with its array: a short text is hashed as a whole.
        last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(SHINGLE))).bitwiseAND(F.lit((1 << 63) - 1)))

    return let(words, hashes)


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin in the order of the bins; a bin without any has its largest possible value.

    That value of every bin is added first, so sorting brings each bin's minimum to the front of its run.
    """
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.shiftleft(j.cast("long"), SHIFT).bitwiseOR(F.lit(TOP)))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get(s, i - 1), SHIFT)))

    return let(F.sort_array(F.concat(hashes, ends)), firsts)


def filled(value: Column) -> Column:
    return value.bitwiseAND(F.lit(TOP)) != F.lit(TOP)


def densify(minima: Column) -> Column:
    """Low-order bits of every bin; empty bins by their probe sequence."""
    rng = random.Random(SEED)
    # Bin j looks at the upper bits of multiplier * j + summand, by another pair at every attempt.
    pairs = [(rng.randrange(1, 1 << 40, 2), rng.randrange(1 << 40)) for _ in range(PROBES)]

    def place(j: Column, attempt: int) -> Column:
        multiplier, summand = pairs[attempt]
        mixed = (j + 1) * F.lit(multiplier) + F.lit(summand)
        return F.shiftright(mixed, 40 - BIN_BITS).bitwiseAND(F.lit(BINS - 1)).cast("int")

    def known(low: Column) -> Column:
        def of(v: Column, j: Column) -> Column:
            tries = [F.get(low, place(j, a)) for a in range(PROBES)]
            # What the probes miss goes round from the last probe to the next filled bin.
            around = F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda d: F.get(low, (place(j, PROBES - 1) + d) % BINS))
            return F.coalesce(v, *tries, F.get(F.filter(around, lambda x: x.isNotNull()), F.lit(0)))

        return F.transform(low, of)

    return let(F.transform(minima, lambda v: F.when(filled(v), v.bitwiseAND(F.lit((1 << BITS) - 1)))), known)


def pack(values: Column) -> Column:
    """array<long> of 64-bit words, the first value in the highest bits."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)),
        lambda w: F.aggregate(F.slice(values, w * PER_WORD + 1, F.lit(PER_WORD)), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v)),
    )


def fingerprint(text: Column) -> Column:
    """array<long>, empty for a text without words."""
    none = F.array().cast("array<bigint>")

    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, none).otherwise(let(bin_minima(hashes), lambda m: let(densify(m), pack)))

    return let(shingle_hashes(F.coalesce(text, F.lit(""))), of)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the two shingle sets."""

    def unequal(x: Column, y: Column) -> Column:
        differ, shift = x.bitwiseXOR(y), BITS // 2
        while shift:  # folds each value onto its lowest bit
            differ, shift = differ.bitwiseOR(F.shiftrightunsigned(differ, shift)), shift // 2
        return F.bit_count(differ.bitwiseAND(F.lit(LOWEST_BITS)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, d: s + d)
    chance = 2.0**-BITS
    corrected = ((BINS - differ) / BINS - chance) / (1 - chance)
    known = F.least(F.greatest(corrected, F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(known)


def add_fingerprint(docs: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text; a column of that name is replaced."""
    return docs.withColumn(name, fingerprint(F.col(text_column)))


def search(bounds: list[int], value: Column) -> Column:
    """How many of the descending bounds are not below the value, by halving."""
    known = F.array(*[F.lit(b).cast("long") for b in bounds])

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        inside = at["lo"] < at["hi"]
        reached = F.get(known, middle) >= value
        return F.struct(F.when(inside & reached, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(inside & ~reached, middle).otherwise(at["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda at: at["lo"]) if bounds else F.lit(0)


def with_next(docs: DataFrame, id_column: str, next_of: dict[str, str], tie: Column) -> DataFrame:
    """Adds columns of the next row in descending id order (null ids last; after the last row comes the first).

    The ids are cut into ranges at approximate quantiles, a few per shuffle partition, so no task sorts more than its ranges. The
    first row of a range is copied to the range before it, which then holds the successor of its own last row.
    """
    spark = docs.sparkSession
    key, part, copied, order = fresh(docs, "key", "part", "copied", "order")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_column).cast("long"), F.lit(FIRST_ID))).withColumn(order, tie)
    n_ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fractions = [i / n_ranges for i in range(1, n_ranges)]
    seen = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(FIRST_ID)).alias("k"))
    found = seen.agg(F.max("k").alias("most"), F.percentile_approx("k", fractions, 100_000).alias("cuts")).first()
    bounds = sorted({*(found["cuts"] or []), *([] if found["most"] is None else [found["most"]])}, reverse=True)
    ranges = max(1, len(bounds))
    own = search(bounds[1:], F.col(key))
    heads = F.col(key) == (F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), own) if bounds else F.lit(None))
    before = F.when(own == 0, F.lit(ranges - 1)).otherwise(own - 1)
    places = F.when(heads, F.array(F.struct(own.alias("p"), F.lit(False).alias("c")), F.struct(before.alias("p"), F.lit(True).alias("c")))).otherwise(
        F.array(F.struct(own.alias("p"), F.lit(False).alias("c")))
    )
    dealt = keyed.withColumn(part, F.explode(places)).withColumn(copied, F.col(part)["c"]).withColumn(part, F.col(part)["p"])
    order_by = Window.partitionBy(part).orderBy(F.col(copied), F.col(key).desc(), F.col(order))
    ahead = {new: F.lead(old).over(order_by) for old, new in next_of.items()}
    return dealt.withColumns(ahead).filter(~F.col(copied)).drop(key, part, copied, order)


def edited_text(text: Column, following: Column) -> Column:
    """The last third replaced by as many first code points of the following text, or all of them."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))
