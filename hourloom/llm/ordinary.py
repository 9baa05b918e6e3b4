"""What ordinary runs of key characters look like: how much likelier each pair of symbols is at random than in words, paths and names.

The model of an encoding is a chain over symbol values. It is fitted once, on the driver, to words of several languages, names of
code and numbers, joined as paths, identifiers and slugs are. A pair takes its share among the pairs of its first symbol, smoothed by
the share of its class of characters (small, capital, digit, sign), and UNSEEN of all pairs are taken to be anything at all.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Mapping
from functools import cache

#: Units of a decade in the tables.
UNITS = 1000
UNSEEN, BACKED, LEAST, ROWS = 0.1, 20, 5, 2000

WORDS = """the and that with from this have which their would there about other were more these when your what some than them only
time people into could first after also made over such where most should through before right between under another while
number system program government company information development international organization responsibility understanding
une des les dans pour que qui avec sur plus par mais nous vous leur sont cette comme tout faire etre deux aussi gouvernement
der die und das nicht von mit sich auf ist dem eine auch nach wie werden aber zeit jahr haus gesellschaft entwicklung verwaltung
los las del para con una por como pero sus este entre cuando todo esta desde sobre tiempo informacion desarrollo
il che per non sono della nel anche come piu questo quello sviluppo governo nie jest sie na do przez oraz ktore
usr local lib python site packages src main java org apache spark sql functions bin home user documents images static assets
index html config json test tests data files utils common core server client build target node modules var log etc opt share
get set is has add remove update create delete find load save read write parse format convert encode decode handle process
request response session context manager factory builder provider service controller repository listener iterator exception
abstract singleton proxy bean default value values name names type types key keys list array map string integer object
length size count max min width height start end last next previous current total offset limit page item items
connection timeout retry buffer stream thread pool queue worker task job event message channel socket http https url uri query
window view button panel text label image color background border layout widget menu dialog action state props component
account customer product order invoice payment address email phone password username identifier version release snapshot vendor
january february march april may june july august september october november december monday friday sunday report summary
linux windows android debug install package module class method property attribute element document xml css www com net""".split()
NUMBERS = """0 1 2 3 4 5 6 7 8 9 10 11 12 16 20 21 24 32 42 50 64 80 99 100 101 128 200 256 404 500 512 1000 1024 1999 2000 2005 2010 2015
2019 2020 2021 2022 2023 2024 2025 01 02 03 04 05 06 07 08 09 15 30 31 20240105 20231231 20200229 123 1234 12345 123456 0000 000001 8080
3306 1080 640x480 v1 v2 v3 utf8 sha256 md5 int64 float32 x86 64bit b64 mp3 mp4 h264 3d 2d i18n l10n k8s ipv4 ipv6 base64 python3 java8
html5 log4j p0 a1 b2 c3""".split()
#: How parts are joined, and the share of runs joined so.
STYLES = (
    (15, "_".join), (13, "-".join), (10, lambda t: "_".join(t).upper()), (15, "/".join), (4, lambda t: "/".join(t).upper()),
    (27, lambda t: t[0] + "".join(x.title() for x in t[1:])), (8, lambda t: "".join(x.title() for x in t)), (8, "".join),
)


@cache
def runs() -> tuple[str, ...]:
    rng = random.Random(0)
    pick = lambda some: some[int(rng.random() * len(some))]
    styles = [style for share, style in STYLES for _ in range(share)]
    return tuple(pick(styles)([pick(WORDS if rng.random() < 0.8 else NUMBERS) for _ in range(3 + int(rng.random() * 4))]) for _ in range(ROWS))


def _kind(letter: str) -> int:
    return 0 if letter.islower() else 1 if letter.isupper() else 2 if letter.isdigit() else 3


def log_ratios(values: Mapping[str, int], letters: str) -> list[int]:
    """Per pair of symbols, log10 of its chance at random over its chance in ordinary runs, in UNITS rounded down.

    `values` has the symbol value of each character, `letters` one character for each value. Characters without a value part a run.
    """
    size, kinds = len(letters), [_kind(x) for x in letters]
    pairs, single, changes = Counter(), Counter(), Counter()
    for run in runs():
        said = [values.get(x) for x in run]
        single.update(v for v in said if v is not None)
        pairs.update((a, b) for a, b in zip(said, said[1:]) if a is not None and b is not None)
    for (a, b), n in pairs.items():
        changes[kinds[a], kinds[b]] += n
    of_kind = Counter()
    for v in range(size):
        of_kind[kinds[v]] += single[v] + 1
    made = []
    for a in range(size):
        seen, left = sum(pairs[a, b] for b in range(size)), sum(changes[kinds[a], k] + LEAST for k in of_kind)
        for b in range(size):
            backed = (changes[kinds[a], kinds[b]] + LEAST) / left * (single[b] + 1) / of_kind[kinds[b]]
            share = (1 - UNSEEN) * (pairs[a, b] + BACKED * backed) / (seen + BACKED) + UNSEEN / size
            made.append(math.floor(-UNITS * math.log10(share * size)))
    return made
