"""Secret scan: named patterns, and a battery of randomness tests with control of the false discovery rate.

Patterns (base spans) are `assign`, `access` and `hex`; matches are leftmost and non-overlapping per kind, a span is the whole
match. The battery looks at every other run of key characters:

1. The encoding is inferred from the characters: hex, base 32, base 36 or base 64. Runs of letters of one case, or of digits
   alone, have none of these and are not tested.
2. The null hypothesis is that the run is ordinary: words, paths and identifiers, by a chain of symbols fitted for each encoding
   (`ordinary.py`). The p-value is the chance of the run under the null over its chance at random. By Markov's inequality ordinary
   runs reach a p-value of p with a probability of p at most. It is a sum of logarithms, so it has no least value.
3. Three tests of the hypothesis that the run is random guard against runs that are neither: chi-squared on eight classes of the
   alphabet, changes between its halves, serial correlation of neighbours. A run that one of them rejects (CHI, NORMAL: a level
   of 0.001 each) has a p-value of 1.
4. Benjamini-Hochberg at level FDR decides over all runs of the corpus, apart in each stratum of encoding and length class.
   p-values are rounded up to 1/100 of a decade first, so the procedure needs one count per stratum and step, and is exact.

Defined cases: null text is empty and has no spans; a repeated row gives a repeated result; other columns are not read. Positions
are code points, ends exclusive. Runs that overlap a base span are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import ordinary
from hourloom.llm.common import cut, fresh, let, sha256_hex

# The named patterns, in the order of their kinds, with the least length of what they must match.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

# '=' parts runs, as in name=value; one or two at the end of a run are its padding.
RUN = "[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
CLASSES = 8
CHI, NORMAL, FDR = 24.32, 3.29, 0.05
LENGTH_CLASSES = (20, 28, 40, 64, 128, 256)
# A p-value of 1e-20 is accepted even alone among 1e18 runs, so steps above it are counted as one.
STEPS, LAST_STEP = 100, 2000

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": (DIGITS + "abcdef",), "base32": (UPPER + "234567",), "base36": (DIGITS + LOWER,), "base64": (UPPER + LOWER + DIGITS + "+/", "-_")}
ENCODINGS = tuple(ALPHABETS)


def spans(text: Column, pattern: str, kept=None) -> Column:
    """array<struct<start, end, said>> of the matches of a pattern that never matches an empty string."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"))
    matched = F.filter(pairs, lambda p: p["said"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,said:string>>")

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["gap"])
        end = start + F.length(p["said"])
        made = F.array(F.struct(start.alias("start"), end.alias("end"), p["said"].alias("said")))
        keep = F.lit(True) if kept is None else kept(p["said"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(done["made"], made)).otherwise(done["made"]).alias("made"))

    return F.aggregate(matched, F.struct(F.lit(0).alias("at"), none.alias("made")), step, lambda done: done["made"])


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> in order; kind is an index into KINDS."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def of(kind: int, pattern: str, seen: str, kept=None) -> Column:
        found = F.transform(spans(text, pattern, kept), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
        return F.when(text.rlike(seen), found).otherwise(none)

    return F.array_sort(
        F.concat(
            of(0, ASSIGN, ASSIGN, lambda said: F.length(F.regexp_extract(said, ASSIGN, 2)) >= LEAST["assign"]),
            # A class with a least count finds the same maximal runs as the class with + and a check of the length.
            of(1, "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}"),
            of(2, "[0-9a-f]{24,}", "[0-9a-f]{24}"),
        )
    )


def encoding_of(run: Column) -> Column:
    """Index into ENCODINGS, or null for runs that no encoding explains."""
    body = F.rtrim(run, F.lit("="))
    mixed = body.rlike("[A-Z]") & body.rlike("[a-z]") | body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return (
        F.when(~mixed, None)
        .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0)
        .when(body.rlike("^[A-Z2-7]+$"), 1)
        .when(body.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 2)
        .when(body.rlike("^[A-Za-z0-9+/_-]+$"), 3)
    )


def _values(alphabet: tuple[str, ...]) -> dict[str, int]:
    """Value by character; letters missing in one case count as the other case."""
    first, values = alphabet[0], {}
    for at, letter in enumerate(first):
        values[letter] = at
    for at, letter in enumerate(alphabet[1] if len(alphabet) > 1 else ""):
        values[letter] = len(first) - 2 + at
    for letter, at in list(values.items()):
        values.setdefault(letter.swapcase(), at)
    return values


def _codes(alphabet: tuple[str, ...]) -> Column:
    """Value by character code."""
    values = _values(alphabet)
    return F.array(*[F.lit(values.get(chr(code), 0)) for code in range(128)])


def _lookup(codes: Column):
    return lambda letter: F.element_at(codes, F.ascii(letter) + 1)


def symbol_values(run: Column, encoding: Column) -> Column:
    letters = F.regexp_extract_all(F.rtrim(run, F.lit("=")), F.lit("."), F.lit(0))
    made = F.lit(None).cast("array<int>")
    for at, name in enumerate(ENCODINGS):
        made = F.when(encoding == at, F.transform(letters, _lookup(_codes(ALPHABETS[name])))).otherwise(made)
    return made


def _ratios() -> Column:
    """The tables of all encodings, one after the other, as one literal."""
    tables = [ordinary.log_ratios(_values(ALPHABETS[name]), ALPHABETS[name][0]) for name in ENCODINGS]
    return F.split(F.lit(",".join(str(x) for table in tables for x in table)), ",").cast("array<int>")


def _shares() -> Column:
    """Per encoding the share of the alphabet in each class."""
    sizes = [len(ALPHABETS[name][0]) for name in ENCODINGS]
    return F.array(*[F.array(*[F.lit(sum(v * CLASSES // size == c for v in range(size)) / size) for c in range(CLASSES)]) for size in sizes])


def _by_encoding(numbers: list[int], encoding: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in numbers]), encoding + 1)


def battery(values: Column, encoding: Column) -> Column:
    """-STEPS * log10 of the p-value, rounded down, for an array of symbol values; 0 where a test says that they are not random."""
    zero = F.array(*[F.lit(0.0)] * CLASSES)
    sizes = [len(ALPHABETS[name][0]) for name in ENCODINGS]
    size, before = _by_encoding(sizes, encoding), _by_encoding([sum(x * x for x in sizes[:at]) for at in range(len(sizes))], encoding)
    ratios = _ratios()

    def count(done: Column, v: Column) -> Column:
        x = v.cast("double")
        at = F.floor(x * CLASSES / size).cast("int")
        side = x * 2 >= size - 1
        ratio = F.when(done["last"].isNull(), 0).otherwise(F.element_at(ratios, before + done["last"] * size + v + 1))
        return F.struct(
            F.transform(done["classes"], lambda c, i: c + F.when(i == at, 1.0).otherwise(0.0)).alias("classes"),
            (done["changes"] + F.when(side != done["side"], 1.0).otherwise(0.0)).alias("changes"),
            side.alias("side"), v.alias("last"), (done["ratio"] + ratio).alias("ratio"),
            (done["sum"] + x).alias("sum"), (done["squares"] + x * x).alias("squares"), (done["products"] + x * F.coalesce(done["last"], F.lit(0))).alias("products"),
        )

    start = F.struct(
        zero.alias("classes"), F.lit(0.0).alias("changes"), F.lit(None).cast("boolean").alias("side"), F.lit(None).cast("int").alias("last"),
        F.lit(0).cast("long").alias("ratio"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("products"),
    )

    def step(s: Column) -> Column:
        return let(F.size(values).cast("double"), lambda n: step_of(s, n))

    def step_of(s: Column, n: Column) -> Column:
        shares = F.element_at(_shares(), encoding + 1)
        chi = F.aggregate(F.zip_with(s["classes"], shares, lambda c, share: c * c / share), F.lit(0.0), lambda a, c: a + c) / n - n
        steps = n - 1
        mean = s["sum"] / n
        variance = s["squares"] / n - mean * mean
        r = F.when(variance > 0, (s["products"] / steps - mean * mean) / variance).otherwise(1.0)
        random = (chi <= CHI) & (F.abs(s["changes"] - steps / 2) <= NORMAL * F.sqrt(steps / 4)) & (F.abs(r) * F.sqrt(n) <= NORMAL)
        ratio = F.floor(s["ratio"] * STEPS / ordinary.UNITS)
        return F.when(random, F.least(F.greatest(ratio, F.lit(0)), F.lit(LAST_STEP))).otherwise(0).cast("int")

    return F.aggregate(values, start, count, step)


def random_runs(text: Column, base: Column) -> Column:
    """array<struct<start, end, stratum, step>> of the tested runs that no base span touches."""
    none = F.array().cast("array<struct<start:int,end:int,stratum:int,step:int>>")
    free = F.filter(spans(text, RUN), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def tested(s: Column, encoding: Column) -> Column:
        length = F.lit(0)
        for least in LENGTH_CLASSES[1:]:
            length = length + F.when(s["end"] - s["start"] >= least, 1).otherwise(0)
        step = let(symbol_values(s["said"], encoding), lambda values: battery(values, encoding))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (encoding * len(LENGTH_CLASSES) + length).alias("stratum"), step.alias("step"))

    known = F.filter(F.transform(free, lambda s: F.struct(s.alias("s"), encoding_of(s["said"]).alias("e"))), lambda x: x["e"].isNotNull())
    return F.when(text.rlike(RUN), F.transform(known, lambda x: tested(x["s"], x["e"]))).otherwise(none)


def least_steps(scanned: DataFrame, runs: str, level: float = FDR) -> dict[int, int]:
    """Per stratum the least step that Benjamini-Hochberg accepts; at most 24 strata, so the answer is small."""
    counts = scanned.select(F.explode(runs).alias("r")).groupBy("r.stratum", "r.step").count()
    kept: dict[int, int] = {}
    by_stratum: dict[int, dict[int, int]] = {}
    for row in counts.collect():  # at most strata times steps rows
        by_stratum.setdefault(row["stratum"], {})[row["step"]] = row["count"]
    for stratum, steps in by_stratum.items():
        total, found = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            found += steps[step]
            if 10.0 ** (-step / STEPS) <= level * found / total:
                kept[stratum] = step
    return kept


def find_secrets(docs: DataFrame, text_column: str = "text", level: float = FDR) -> DataFrame:
    """The other columns of docs, and `secret_spans`: array<struct<start, kind, end>> sorted by start, kind an index into KINDS.

    A column of docs with that name is replaced.
    The text is read once; what it gave is cut, counted for the thresholds, and filtered by them.
    """
    base, runs, text = fresh(docs, "base", "runs", "whole")
    rest = [c for c in docs.columns if c != text_column and c.lower() != "secret_spans"]
    whole = docs.select(*rest, F.coalesce(F.col(text_column), F.lit("")).alias(text))
    with_base = whole.withColumn(base, base_spans(F.col(text)))
    scanned = cut(with_base.select(*rest, base, random_runs(F.col(text), F.col(base)).alias(runs)))
    kept = least_steps(scanned, runs, level)

    def passes(r: Column) -> Column:
        said = F.lit(False)
        for stratum, step in sorted(kept.items()):
            said = said | ((r["stratum"] == stratum) & (r["step"] >= step))
        return said

    added = F.transform(F.filter(runs, passes), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return scanned.select(*rest, F.array_sort(F.concat(base, added)).alias("secret_spans"))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts per named kind, digest of the base spans, all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)

    def said(some: Column) -> Column:
        return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return found.select("doc_id", *counts, sha256_hex(said(base)).alias("base_sha256"), said(F.col("secret_spans")).alias("spans"))
