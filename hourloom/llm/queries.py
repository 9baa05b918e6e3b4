"""Registered queries of the subpackage: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, chat, exact_dedup, fingerprints, html_text, jaccard_join, merkle, mixing, oracles, prefix_bpe, quality, secrets, sharding, spelling
from hourloom.llm.common import cut, scratch_folder, sha256_hex, table

PROBE = r"\### Assistant: </turn> ok"


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose two turns say control strings, read back from the formatted examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    probe = spark.range(1).select(F.lit(-7).alias("conv_id"), said.alias("s")).select("conv_id", "s.turn", "s.role", F.lit(PROBE).alias("text"))
    examples = chat.expand_examples(chat.format_conversations(turns.unionByName(probe)))
    return chat.digests(chat.read_back(examples))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight and score of every document, and whether the sample takes it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, weight, total, taken = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col(weight).alias("log_weight"), F.col(total).alias("score"), taken.alias("selected"))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and random secrets in every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.span_digests(secrets.find_secrets(docs))


N_SHARDS = 40


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes by way of 4,096 virtual slots."""
    rows = sharding.record_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    records = cut(rows.withColumn("virtual_slot", sharding.slot_of()))
    totals = cut(sharding.slot_totals(spark, records))
    slot_map = sharding.save_map(sharding.first_map(totals, N_SHARDS), f"{scratch_folder(spark, 'slot-map')}")
    placed = sharding.place(records, totals, slot_map)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op4_history_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; the row with the largest id stays."""
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


VOCABULARY = "byte_bpe_50k.tiktoken"


def op5_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts and what they decode to."""
    vocabulary = bpe.load(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode(docs, vocabulary, keep_text=False, decoded="decoded")
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decoded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_packed_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edited texts, and how alike they and neighbours are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = fingerprints.add_fingerprint(docs, name="own")
    ahead = fingerprints.with_next(own, "doc_id", {"text": "next_text", "own": "next"}, F.xxhash64("text"))
    edited = ahead.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprints.edited_text(F.col("text"), F.col("next_text")).alias("edited"), "own", "next")
    both = edited.withColumn("changed", fingerprints.fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_hex(F.col("own")).alias("fingerprint"), fingerprints.as_hex(F.col("changed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"), fingerprints.likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op7_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shard")


def op8_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a similarity of 0.8 or more on five-word shingles."""
    classes = jaccard_join.similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", "class_size", "n_links", "first")


def op9_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    texts = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_asymmetric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all texts."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


WORD_VOCABULARY = "word_bpe_49k.json"


def op12_prefix_programming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts and what they decode to."""
    vocabulary = prefix_bpe.load(spark, public_tokenizers.path(WORD_VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = prefix_bpe.encode(docs, vocabulary, keep_text=False, decoded="decoded")
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(said).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op13_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its proof holds for the text that a third of the readers find."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, spelling.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proven = merkle.proofs(merkle.leaves(docs, changed))
    folded = proven.withColumn("folded_root", merkle.fold(F.col("seen"), F.col("segment")))
    return folded.select(
        F.col("id").alias("doc_id"), *[merkle.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        sha256_hex(merkle.siblings(F.col("segment"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == merkle.hex_of(F.col("root"))).alias("verified"),
    )


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_randomness_battery": op2_randomness_battery,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_history_hash": op4_history_hash,
    "op5_two_tier_bpe": op5_two_tier_bpe,
    "op6_packed_minhash": op6_packed_minhash,
    "op7_sainte_lague": op7_sainte_lague,
    "op8_bayes_jaccard_join": op8_bayes_jaccard_join,
    "op9_block_rules": op9_block_rules,
    "op10_prefix_targets": op10_prefix_targets,
    "op11_asymmetric_chunks": op11_asymmetric_chunks,
    "op12_prefix_programming": op12_prefix_programming,
    "op13_pointer_jumping": op13_pointer_jumping,
}

SQL: dict[str, str] = {
    "op4_history_hash": oracles.HISTORY_HASH,
    "op7_sainte_lague": oracles.SAINTE_LAGUE,
    "op10_prefix_targets": oracles.PREFIX_TARGETS,
    "op11_asymmetric_chunks": oracles.ASYMMETRIC_CHUNKS,
    "op13_pointer_jumping": oracles.POINTER_JUMPING,
}
