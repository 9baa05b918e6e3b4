"""Grouping of spelling variants: words one edit apart, by asymmetric q-chunks.

Words are runs of letters, in lower case of A to Z, counted over all texts. Two words are near if one inserted, deleted or replaced code
point makes the one the other. Of each pair the shorter word (of two words of one length, either) gives two disjoint chunks,
its halves; the other one gives all its grams of the length of a half, with their places. One edit leaves one of the halves whole,
shifted by one place at most. So near words share a chunk and a gram at places that differ by one at most, and the join on
(length of the shorter word, chunk) within a shift of one loses none; what it finds is verified by edit distance.

A half stands at a place that follows from the word's length, so the grams that are shifted by more than one against it are left out
before the join, whose key is (length of the shorter word, half, chunk). Words are distinct, so the rows of a key are the words around
one half, however frequent they are in the texts.

A word's form is its most frequent near word, if that is at least FORM_TIMES as frequent. Frequencies grow along forms, so following them
ends; the last one is found by pointer jumping.

Defined cases: null texts have no words; a null id is an empty one; repeated rows count each time; texts without words give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import cut, stored

# What a word is made of, which occurrences lose a letter, and which words count.
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP_ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
FORM_TIMES = 2


def lower_ascii(text: Column) -> Column:
    """Lower case of A to Z alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def spelled(docs: DataFrame, slips: bool = True) -> DataFrame:
    """`word` of every occurrence. With slips, one in SLIP_ONE_IN by the hash of id and word loses a letter."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lower = runs.select("key", lower_ascii(F.col("run")).alias("word"))
    if not slips:
        return lower.select("word")
    hashed = lower.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(F.when(F.col("h") % SLIP_ONE_IN == 0, shorter).otherwise(F.col("word")).alias("word"))


def word_counts(docs: DataFrame, slips: bool = True) -> DataFrame:
    """word, n of the words that count."""
    counted = spelled(docs, slips).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def chunks(words: DataFrame) -> DataFrame:
    """word, length, half (0 or 1), chunk and place of the two halves of every word."""
    size = F.length("word")
    first = F.floor(size / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.substring("word", F.lit(1), first).alias("chunk"), F.lit(0).alias("place")),
        F.struct(F.lit(1).alias("half"), F.substring("word", first + 1, size).alias("chunk"), first.alias("place")),
    )
    return words.select("word", size.alias("length"), F.explode(halves).alias("c")).select("word", "length", "c.half", "c.chunk", "c.place")


def grams(words: DataFrame) -> DataFrame:
    """word, length, half, chunk, place: all positional grams of a word as long as a half of a word of that length, its own or one less.

    Those that stand more than one place from where such a half does can meet none and are left out.
    """
    size = F.length("word")
    wanted = words.select("word", F.explode(F.array(size, size - 1)).alias("length"))
    wanted = wanted.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    first = F.floor(F.col("length") / 2).cast("int")
    sized = wanted.withColumn("q", F.when(F.col("half") == 0, first).otherwise(F.col("length") - first))
    placed = sized.withColumn("place", F.explode(F.sequence(F.lit(0), size - F.col("q"))))
    within = placed.filter(F.abs(F.col("place") - F.when(F.col("half") == 0, 0).otherwise(first)) <= 1)
    return within.select("word", "length", "half", F.substring("word", F.col("place") + 1, F.col("q")).alias("chunk"), "place")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: all pairs of words one edit apart, each once; a is the shorter one, or the first of two of one length."""
    short = chunks(words).select(F.col("word").alias("a"), "length", "half", "chunk", F.col("place").alias("p"))
    long = grams(words).select(F.col("word").alias("b"), "length", "half", "chunk", F.col("place").alias("q"))
    met = short.join(long, ["length", "half", "chunk"]).filter(F.abs(F.col("p") - F.col("q")) <= 1)
    ordered = met.filter((F.length("b") > F.col("length")) | (F.col("a") < F.col("b")))
    return ordered.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def near_words(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of every word."""
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = ends.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("word")))
    around = counted.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    takes = -F.col("best.order") >= FORM_TIMES * F.col("n")
    joined = words.join(around, "word", "left")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.order")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds `root`, the last of the forms from a word on. Each round doubles the distance that a word's step covers."""
    steps, moved = cut(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))), True
    while moved:
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("on"))
        jumped = cut(steps.join(onward, "to", "left").select("word", "to", "on"))
        moved = jumped.filter(F.col("on").isNotNull()).limit(1).count() > 0
        steps = jumped.select("word", F.coalesce("on", "to").alias("to"))
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame, slips: bool = True) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the texts."""
    words = stored(word_counts(docs, slips), "words")
    formed = cut(near_words(words, near_pairs(words)))
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
