import random
import re
import zlib
from collections import Counter

import pytest

from loomfeed.llm.variants import count_words, near_words, spelling_variants

RNG = random.Random(11)
BASE = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randrange(7, 11))) for _ in range(25)]


def misspelt(w):
    k = RNG.randrange(len(w))
    return [w[:k] + w[k + 1 :], w[:k] + RNG.choice("abz") + w[k + 1 :], w[:k] + RNG.choice("abÿ") + w[k:]][RNG.randrange(3)]


DOCS = [(i, " ".join(RNG.choice(BASE) if RNG.random() < 0.9 else misspelt(RNG.choice(BASE)) for _ in range(RNG.randrange(80)))) for i in range(150)]
CHAIN = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
DOCS += [(200, None), (201, ""), (202, "short words only"), (None, BASE[0]), (203, " ".join(BASE[0] for _ in range(3000))), (203, BASE[1].upper() + "Àé÷" + "\n" + BASE[1].title()), (204, "aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaaa aaaaaaa aaaaaaaaa"), (205, "ÀBCDEFGH àbcdefgh ÀbcdefgH 12hgfedcba34"), (206, "日本hgfedcba日本")]
DOCS += [(300 + i, " ".join([w] * n)) for i, (w, n) in enumerate(zip(CHAIN, (2, 20, 200, 2000)))]


def words_of(rows, slips, shortest=7):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if slips and not (h := zlib.crc32(f"{'' if i is None else i}:{run}".encode())) % slips:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows, slips):
    n = words_of(rows, slips)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def slipped(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in DOCS], "doc_id long, text string, word string, n int, key string").repartition(5)


@pytest.mark.parametrize("slips", [0, 3, 31])
def test_variants_equal_brute_force(slipped, slips):
    got = [tuple(r) for r in spelling_variants(slipped, slips=slips).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = expected(DOCS, slips)
    assert len(got) == len(set(got)) and set(got) == want
    assert slips or any(r[2] == CHAIN[-1] and r[0] == CHAIN[0] for r in got)
    assert sum(r[1] is not None for r in got) > 5


def test_words_leave_a_task_in_bounded_portions(slipped):
    assert {tuple(r) for r in count_words(slipped, slips=3, most=10).collect()} == set(words_of(DOCS, 3).items())


def test_ties_and_repeats_of_letters(spark):
    words = spark.createDataFrame([("aab", 5), ("ab", 5), ("aaab", 5), ("abb", 5), ("zzz", 1)], "word string, n long")
    got = {r.word: (r.n_near, r.best.word if r.best else None) for r in near_words(words).collect()}
    assert got == {"aab": (3, "aaab"), "ab": (2, "aab"), "aaab": (1, "aab"), "abb": (2, "aab"), "zzz": (0, None)}


def test_empty_tables(slipped):
    assert spelling_variants(slipped.limit(0)).count() == 0
    assert spelling_variants(slipped.where("text IS NULL")).count() == 0
