"""Spelling variants, word BPE and Merkle proofs against plain versions, the library and SQL."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from oracle import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourloom.llm import bpe, fingerprints, html_text, merkle, prefix_bpe, queries, secrets, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Words and their slips, nulls, empty and very long texts, repeated rows and ids, a group of one and one without name."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    made = []
    for i in range(90):
        said = [rng.choice(base) for _ in range(rng.randint(0, 60))]
        said = [w[:j] + rng.choice("abÀé") + w[j + rng.randint(0, 1) :] if rng.random() < 0.2 else w for w in said for j in [rng.randrange(len(w) + 1)]]
        made.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in said), rng.choice(["en", "de"]), f"s{i % 3}", i))
    made += [(100, None, "en", None, None), (101, "", None, "", 0), (102, ("x" * 2000 + " ") * 70, "fr", "s", 1), (105, "chaina " * 4 + "chainab " * 9 + "chainabc " * 25, "en", "s", 1), (103, "漢字 ×÷ ÀÉ", None, "s", 1)]
    made += [(None, "abaab ABAAB", "en", "s", 2), (None, None, None, None, None), (7, "abaab", "de", "s", 1), (7, "abaab", "de", "s", 1)]
    return made + [(104, made[0][1], "en", "s0", 0)] * 30


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def stored(docs, tmp_path):
    """The unusual table as files, and a DuckDB that sees it."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), db


@pytest.mark.parametrize("name", ["op11_asymmetric_chunks", "op13_pointer_jumping"])
def test_sql_on_unusual_rows(spark, stored, name):
    folder, db = stored
    assert compare(queries.QUERIES[name](spark, folder), db, queries.SQL[name]) is None




# --- spelling


def plain_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in spelling_runs(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def spelling_runs(text):
    runs, run = [], ""
    for c in text + " ":
        if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
            run += c
        elif run:
            runs.append(run)
            run = ""
    return runs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_against_all_pairs(docs, rows):
    counts = plain_words(rows)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    want = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        want.add((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    assert form and any(form.get(f) for f in form.values())
    assert {tuple(r) for r in spelling.variants(docs).collect()} == want


def test_halves_meet_grams_of_every_edit(spark):
    """Every single edit of words of all short lengths, letters repeated, is found, and each pair once."""
    rng = random.Random(8)
    words = set()
    for n in range(5, 10):
        for _ in range(4):
            w = "".join(rng.choice("ab") for _ in range(n))
            words |= {w, *(w[:i] + w[i + 1 :] for i in range(n)), *(w[:i] + c + w[i:] for i in range(n + 1) for c in "ab"), *(w[:i] + "é" + w[i + 1 :] for i in range(n))}
    words = sorted(w for w in words if len(w) >= 5)
    found = [tuple(sorted(r)) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_long_chain_of_forms(spark):
    formed = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)], "word string, form string")
    assert {r["root"] for r in spelling.with_roots(formed).collect()} == {"w40"}


def test_no_words(none):
    assert spelling.variants(none).collect() == []


# --- word BPE


@pytest.fixture(scope="module")
def vocabulary(spark):
    return prefix_bpe.load(spark, public_tokenizers.path(queries.WORD_VOCABULARY))


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    made.no_truncation()
    made.no_padding()
    return made


AWKWARD = [
    "", " \n\t ", "Hello WORLD's it's WE'LL 'S", "<|endoftext|>", "a<|startoftext|><|endoftext|>B <|endoftext|", "ΑΣ ΣΑΣ σς", "é É ﬁ İ ǅ", "123 ½² ٣ x1y2",
    "foo</w> </w>", "!!!???... --- ___   x", "漢字かな한국어", "a" * 3000, "ab" * 2000, "ha" * 999 + "!", "\x00\x1c\x1f\x85", "🙂🙂 👩‍👩‍👧", "don't DON'T 'twas", "word " * 20_000,
]


def test_ids_and_texts_equal_the_library(spark, vocabulary, library):
    rng = random.Random(9)
    alphabets = ["ab", "aeiounst", "abcdefghijklmnopqrstuvwxyz'", "aAéÉßΣσςİ́ 1２½", "<|endoftext|> a\n", "?!.-_ <>", "the ing er on"]
    texts = AWKWARD + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    pieces = [t for t in vocabulary.value.tokens.tolist() if t]
    texts += ["".join(rng.choice(pieces).replace("</w>", rng.choice(["", " "])) for _ in range(6)) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    made = prefix_bpe.encode(frame, vocabulary, decoded="decoded")
    again = prefix_bpe.decode(made.select("doc_id", "ids"), vocabulary).select("doc_id", F.col("decoded").alias("again"))
    for r in made.join(again, "doc_id").collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want, texts[r["doc_id"]][:80]
        assert r["decoded"] == r["again"] == library.decode(want, skip_special_tokens=False)


def test_last_token_of_every_prefix(vocabulary, library):
    """Pairs pass exactly if merging both texts together gives the two tokens again."""
    known, rng = vocabulary.value, random.Random(10)
    inner = [t for t, s in known.symbols.items() if max(s) < prefix_bpe.WORD_END and bytes(s).isalpha() and bytes(s).islower()]
    ending = [t for t, s in known.symbols.items() if s[-1] >= prefix_bpe.WORD_END and bytes(x % 256 for x in s).isalpha() and bytes(x % 256 for x in s).islower()]
    passed = 0
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(ending)
        word = bytes(x % 256 for x in known.symbols[a] + known.symbols[b]).decode()
        passed += known.apart(a, b)
        assert known.apart(a, b) == (library.encode(word, add_special_tokens=False).ids == [a, b])
    assert 0 < passed < 3000


def test_nulls_clashing_names_and_forgetting(spark, vocabulary, docs, none, library, monkeypatch):
    clash = docs.withColumn("IDS", F.lit("old")).withColumn("decoded", F.lit(1)).withColumn("symbols", F.lit(2))
    made = prefix_bpe.encode(clash, vocabulary, decoded="decoded")
    assert made.columns == [*DOCS_COLUMNS, "symbols", "ids", "decoded"] and made.count() == docs.count()
    assert made.filter("text IS NULL").select("ids", "decoded").distinct().collect() == [([], "")]
    assert prefix_bpe.encode(none, vocabulary).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([-1, 49406, 10**6, 320],)], "ids array<int>")
    assert [r["decoded"] for r in prefix_bpe.decode(odd, vocabulary).collect()] == ["", "", f"<|startoftext|> {vocabulary.value.tokens[320]}"]
    # With tiny memories the ids stay the same.
    monkeypatch.setattr(prefix_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(prefix_bpe, "PAIRS", 5)
    encoder = prefix_bpe.Encoder(vocabulary.value)
    for text in ["one two three four", "two one five six", "<|endoftext|> one " + "z" * 100, "four one two " + "z" * 100]:
        got = [int.from_bytes(encoder.encode([text])[0][i : i + 4], "little") for i in range(0, 4 * len(library.encode(text, add_special_tokens=False).ids), 4)]
        assert got == library.encode(text, add_special_tokens=False).ids


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_query_digests(spark, stored, library, rows):
    folder, _ = stored
    got = Counter(tuple(r) for r in queries.op12_prefix_programming(spark, folder).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        said, decoded = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want


# --- Merkle proofs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """The top, and for each leaf the runs on its way: (place in the run, members)."""
    ways, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for way, i in zip(ways, places):
            way.append((i % 8, runs[i // 8]))
        places, level = [i // 8 for i in places], [h(*r) for r in runs]
    return level[0], ways


def plain_manifest(rows, changed=lambda doc_id, text: text):
    def leaf(doc_id, text, lang, source, n_chars):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    groups = defaultdict(list)
    for doc_id, text, *rest in rows:
        groups[rest[0]].append(((doc_id is not None, doc_id or 0), leaf(doc_id, text, *rest), doc_id, leaf(doc_id, changed(doc_id, text), *rest)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        trees[name] = plain_tree([x[1] for x in groups[name]])
    root, ways = plain_tree([trees[n][0] for n in names])
    for name, onward in zip(names, ways):
        subroot, own = trees[name]
        for (_, digest, doc_id, seen), way in zip(groups[name], own):
            folded, proof = seen, []
            for at, run in way + onward:
                proof += run[:at] + run[at + 1 :]
                folded = h(*run[:at], folded, *run[at + 1 :])
            yield doc_id, digest, subroot, root, h(*proof), folded, folded == root


def tamper(doc_id, text):
    hit = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
    return "".join(c.lower() if c.isascii() else c for c in text) if hit else text


def test_manifest_against_a_plain_tree(spark, stored, rows):
    folder, _ = stored
    got = Counter(tuple(r) for r in queries.op13_pointer_jumping(spark, folder).collect())
    assert got == Counter(plain_manifest(rows, tamper))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9, 1], [64, 65, 8, 7, 1, 2, 3, 4, 5, 6], [600, 3]])
def test_trees_of_all_shapes(spark, sizes, monkeypatch):
    """Heights on both sides of the powers, and blocks so small that ancestors are copied."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(n, f"Text {n}", f"l{g}", "s", n) for g, size in enumerate(sizes) for n in range(size)]
    proven = merkle.proofs(merkle.leaves(spark.createDataFrame(rows, DOCS)))
    got = proven.select("id", *[merkle.hex_of(F.col(c)) for c in ("leaf", "subroot", "root")], F.sha2(merkle.siblings(F.col("segment")).cast("binary"), 256), merkle.fold(F.col("seen"), F.col("segment")))
    assert Counter((*r, True) for r in map(tuple, got.collect())) == Counter(plain_manifest(rows))


def test_no_rows(none):
    assert merkle.proofs(merkle.leaves(none)).collect() == []


def test_extra_columns_are_ignored(docs, rows):
    clash = docs.withColumns({c: F.lit("x") for c in ("number", "tree", "leaf", "segment", "level", "size", "id")})
    got = Counter(r["root"] for r in merkle.proofs(merkle.leaves(clash)).select(merkle.hex_of(F.col("root")).alias("root")).collect())
    assert got == Counter(r[3] for r in plain_manifest(rows))


# --- earlier operators


def test_added_columns_replace_those_of_their_name(spark, docs):
    ranks = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    clash = docs.withColumns({"Ids": F.lit("old"), "secret_spans": F.lit("old"), "fingerprint": F.lit("old"), "decoded": F.lit(1)})
    made = bpe.encode(clash, ranks, decoded="decoded")
    assert made.columns == [*DOCS_COLUMNS, "secret_spans", "fingerprint", "ids", "decoded"] and made.count() == docs.count()
    again = bpe.decode(made.withColumn("DECODED", F.lit(2)), ranks)
    assert again.where(F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")).cast("binary"))).count() == docs.count()
    found = secrets.find_secrets(clash)
    assert found.columns.count("secret_spans") == 1 and dict(found.dtypes)["secret_spans"].startswith("array") and found.count() == docs.count()
    assert dict(fingerprints.add_fingerprint(clash).dtypes)["fingerprint"] != "string"


def test_edited_text(spark):
    pairs = [("abcdefgh", "XY"), ("abcdefgh", "XYZW"), ("", "XYZ"), ("ab", "XYZ"), ("abc", ""), ("éßñéßñ", "漢字かな")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in frame.select(fingerprints.edited_text(F.col("a"), F.col("b"))).collect()]
    assert got == [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in pairs]


def test_deep_pages_take_time_in_proportion():
    """Open elements without ends, ends without elements, marks inside marks: a megabyte is read at once."""
    deep = "<article><p>" + "<b>" * 100_000 + "</i>" * 100_000 + "the text of the page and it is that " * 30
    marked = "".join(f'<div class="sidebar-wrap n{i}">the and of in it ' for i in range(20_000))
    began = time.perf_counter()
    assert html_text.main_text(deep).startswith("the text of the page") and isinstance(html_text.main_text(marked), str)
    assert time.perf_counter() - began < 20
    nested = "<article><p>It was the first of the texts that we had <b><i><u><s><em><strong><span><small><code>and it was long</article>"
    assert html_text.main_text(nested.replace("</article>", "<p>The second of them was in the other one</p></article>")).count("\n\n") == 1
