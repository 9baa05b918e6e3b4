"""The pipeline against a plain version of every stage, stage by stage and as a whole."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import DOCS, RANKS, brute_classes, words

import corpus_pipeline
from hourloom.llm import mixing, quality
from hourloom.llm.shingles import WordHashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make_rows(n=260):
    rng = random.Random(21)
    rows = []
    for i in range(n):
        kind = i % 13
        if kind == 0:
            text = " | ".join(words(rng, 40).upper().split()) + " %%%"
        elif kind == 1 and i > 13:
            text = rows[i - 8][1]
        elif kind == 2 and i > 13:
            w = (rows[i - 7][1] or "").split()
            text = " ".join([*w[:-1], "changed"])
        else:
            text = words(rng, rng.choice([3, 60, 90, 400])).replace(" ", "\n", 1)
        rows.append((i, text, "en", f"s{i % 5}" if i % 17 else None, len(text)))
    rows += [(900, None, None, "s1", None), (901, "", "en", "s1", 0), (902, words(rng, 5000), "en", "s2", 9), (None, words(rng, 80), "en", "s3", 1)]
    return rows + [rows[5], rows[5], (903, rows[6][1], "de", "s9", 3)]


def brute_quality(spark, rows, labels):
    frame = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    chosen = quality.sampled_labels(frame).collect()
    assert {(r["doc_id"], r["good"]) for r in chosen} == {(i, q == 1) for i, q in labels}
    good = {r["doc_id"] for r in chosen if r["good"] and not r["held"]}
    known, best = {r["doc_id"]: r["good"] for r in chosen if r["held"] or not r["good"]}, (0.0, -math.inf)
    hashes = WordHashes()
    raw, target = Counter(), Counter()
    grams = [Counter(quality.ngram_buckets(r[1] or "", hashes).tolist()) for r in rows]
    for r, g in zip(rows, grams):
        raw.update(g)
        if r[0] in good:
            target.update(g)
    n, sums = quality.N_BUCKETS, [sum(c.values()) + quality.N_BUCKETS for c in (raw, target)]
    ratio = [math.log((target[b] + 1) / sums[1]) - math.log((raw[b] + 1) / sums[0]) for b in range(n)]
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").distinct()
    noise = {r["doc_id"]: r["g"] for r in ids.select("doc_id", quality.gumbel("doc_id").alias("g")).collect()}
    scores = [sum(ratio[b] * c for b, c in g.items()) + noise[r[0]] for r, g in zip(rows, grams)]
    held = [(s, known[r[0]]) for r, s in zip(rows, scores) if r[0] in known]
    for value in sorted({s for s, _ in held}):
        gone = [g for s, g in held if s <= value]
        gain = (len(gone) - sum(gone)) / sum(not g for _, g in held) - quality.GOOD_COST * sum(gone) / sum(g for _, g in held)
        if gain > best[0] + 1e-9:
            above = [s for s, _ in held if s > value]
            best = (gain, (value + min(above)) / 2 if above else value + 1)
    return [r for r, s in zip(rows, scores) if s >= best[1]]


def brute_exact(rows):
    kept = {}
    for r in rows:
        at = kept.get(r[1] or "")
        if at is None or (r[0] is not None and (at[0] is None or r[0] > at[0])):
            kept[r[1] or ""] = r
    return list(kept.values())


def brute_near(rows):
    kept = defaultdict(list)
    for r, (_, class_id, size, links) in zip(rows, in_order(rows)):
        kept[class_id if size > 1 else ("own", r[0], r[1])].append(r)
    return [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in kept.values()]


def in_order(rows):
    """brute_classes gives class by class; here in the order of rows, which have different ids."""
    found = {x[0]: x for x in brute_classes(rows)}
    return [found[r[0]] for r in rows]


def brute_mix(rows):
    """Words that each row gives, pass by pass: the stream of every source, its blocks and their seeded order, word by word."""
    word = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    by_source = defaultdict(list)
    for n, r in enumerate(rows):
        place = hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        by_source[r[3]].append((place, -1 if r[0] is None else r[0], len(word.findall(r[1] or "")), n))
    names = sorted(s for s in by_source if s is not None) + ([None] if None in by_source else [])
    size = {s: sum(x[2] for x in by_source[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = sum(size.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s], left = 3.0 * size[s], left - 3 * size[s]
            free.discard(s)
    block = max(1, min(1024, min((v for v in size.values() if v), default=0) // 64))
    taken = []
    for s in names:
        blocks = math.ceil(size[s] / block)
        quota = min(math.floor(target[s] / block + 0.5), 3 * blocks)
        if not blocks:
            continue
        shift = int(hashlib.md5(f"{mixing.SEED}:source:{s or ''}".encode()).hexdigest()[:8], 16) % blocks
        at = 0
        for _, _, n_words, n in sorted(by_source[s]):
            held = word.findall(rows[n][1] or "")
            for k in range(3):
                pieces, last = [], None
                for i in range(n_words):
                    b = (at + i) // block
                    if k * blocks + (b - shift) % blocks < quota:
                        if last != i - 1 or not pieces:
                            pieces.append("")
                        pieces[-1] += held[i]
                        last = i
                if pieces:
                    full = sum(len(word.findall(p)) for p in pieces) == n_words and len(pieces) == 1
                    taken.append((rows[n][0], rows[n][1] if full else "\n".join(pieces), rows[n][3]))
            at += n_words
    return taken


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = make_rows()
    labels = [(i, int(i % 13 != 0), 0) for i in range(0, 260, 2)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root), rows, [(i, q) for i, q, _ in labels]


def shown(rows):
    return Counter(str(tuple(r)) for r in rows)


def test_stages_one_by_one_and_as_a_whole(spark, sf_dir):
    path, rows, labels = sf_dir
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{path}/documents.parquet")

    kept = brute_quality(spark, rows, labels)
    got = stages[0](spark, docs, path)
    assert got.columns == COLUMNS and shown(got.collect()) == shown(kept)
    assert sum(r[0] is not None and r[0] < 260 and r[0] % 13 == 0 for r in kept) <= 3 < len(kept) < len(rows)

    kept = brute_exact(kept)
    frame = spark.createDataFrame(got.collect(), DOCS)
    got = stages[1](spark, frame, path)
    assert got.columns == COLUMNS and shown(got.collect()) == shown(kept)

    kept = brute_near(kept)
    frame = spark.createDataFrame(got.collect(), DOCS)
    got = stages[2](spark, frame, path)
    assert got.columns == COLUMNS and shown(got.collect()) == shown(kept)

    mixed = brute_mix(kept)
    frame = spark.createDataFrame(got.collect(), DOCS)
    got = stages[3](spark, frame, path)
    assert got.columns == COLUMNS
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == Counter(mixed)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = Counter()
    for i, text, source in mixed:
        ids = other.encode_ordinary(text)
        want[(i, source, len(ids), struct.pack(f"<{len(ids)}I", *ids), True)] += 1
    whole = corpus_pipeline.run(spark, path)
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"]), r["round_trip"]) for r in whole.collect()) == want


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir[0]).count() == 0, name


def test_stages_keep_other_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet").withColumn("rest", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("score", F.lit(np.pi))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir[0]).columns == docs.columns


def test_op7_takes_what_the_plain_version_takes(spark, sf_dir):
    rows = sf_dir[1]
    want = Counter()
    for i, text, source in brute_mix(rows):
        want[(i, source)] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    got = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, DOCS).select("doc_id", "source", "text")).collect():
        got[(r["doc_id"], r["source"])] += r["taken"]
    assert {k: v for k, v in got.items() if v} == dict(want)


@pytest.mark.parametrize("balanced", [False, True])
def test_the_cut_does_not_hang_on_the_mix_of_labels(spark, balanced):
    """Natural labels, and labels of which half are bad: nearly all good documents stay and most bad ones go."""
    folder = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    bad, good = ([i for i, q in known.items() if q == kind] for kind in (0, 1))
    told = bad + (random.Random(1).sample(good, len(bad)) if balanced else good)
    frame = spark.createDataFrame([(i, known[i], 0) for i in told], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resample(spark.read.parquet(f"{folder}/documents.parquet"), frame).collect()}
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_cut_of_labelled_scores():
    assert quality.best_cut([5, 6, 7], [1, 2]) == 3.5
    assert quality.best_cut([5, 6], []) == quality.best_cut([], [1]) == quality.best_cut([1, 2], [5, 6]) == -math.inf
    assert quality.best_cut([3, 3], [3, 1]) == 2 and quality.best_cut([2] + [9] * 9, [1, 3]) == 6
