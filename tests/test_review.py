"""Review pairs: names are compared by the letter, whatever their alphabet, and entities meet by their names."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from cairn.operators import alike, resolve, review


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_matched_letters_are_those_of_sequence_matcher():
    r = random.Random(4)
    for letters in ("AB ", "ABCDE12 "):
        for _ in range(60):
            m, n = r.randrange(25), r.randrange(25)
            a, b = (["".join(r.choice(letters) for _ in range(k)) for _ in range(20)] for k in (m, n))
            points = lambda s, k: np.array([[ord(c) for c in x] for x in s], np.uint32).reshape(len(s), k)
            assert alike.matched(points(a, m), points(b, n)).tolist() == [sum(t.size for t in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(a, b)]


def test_lists_of_names_equal_brute_force():
    """Of up to 32, 64 and more letters, and of 200, from where SequenceMatcher leaves letters out."""
    r = random.Random(6)
    base = ["".join(r.choice("ABCDEF 123") for _ in range(n)) for n in (0, 1, 7, 16, 31, 32, 33, 50, 64, 65, 90, 199, 200, 230)]
    edit = lambda s: "".join(c if r.random() > 0.06 else r.choice(["", "X", c + "Y"]) for c in s)
    names = sorted({edit(s) for s in base for _ in range(12)})
    of, ix = alike.Names(names, review.ALIKE), np.arange(len(names))
    got = set()
    for x, y in of.among(ix, ix, True):
        there, back = of.judged(x, y)
        got |= {(names[i], names[j]) for i, j in zip(x[there], y[there])} | {(names[j], names[i]) for i, j in zip(x[back], y[back])}
    assert got == {(a, b) for a in names for b in names if a != b and ratio(a, b) >= review.ALIKE} and len(got) > 300


@pytest.mark.parametrize("alphabet", ["ABCDE", "abñü1"])
def test_pairs_of_entities_equal_brute_force(spark, alphabet):
    """Few names of many entities, names without a word, numbers that flip, ages that fit or are missing. A letter that isn't A-Z or 0-9 wasn't
    counted by the bound, and two empty names had none."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    names = ["", "", "A B", *(" ".join(sorted(word(r.choice((2, 4, 5))) for _ in range(3))) for _ in range(12))]
    names += [n[:-1] + r.choice(alphabet) for n in names[3:]]
    number = lambda: r.choice(["1234", "12345", str(12345600 + r.randrange(14)), str(12435600 + r.randrange(5)), "1234560", "98765432"])
    rows = [(i, r.choice(names), sorted({number() for _ in range(r.choice((0, 1, 1, 2)))}), r.choice(["", "20", "21", "24", "x"])) for i in r.sample(range(1000), 110)]
    df = spark.createDataFrame(rows, "entity long, name_key string, cis array<string>, age string")
    want = set()
    for a, m, c, s in rows:
        for b, n, d, t in rows:
            if a >= b or s.isdigit() and t.isdigit() and abs(int(s) - int(t)) > review.YEARS:
                continue
            blocks = lambda n, c: {"N" + w[:3] for w in n.split() if len(w) >= 3} | {"C" + x[:4] for x in c if len(x) >= 5}
            rel = {resolve.related(x, y) for x in c for y in d}
            near = bool(rel & {"equal", "flip"})
            if blocks(m, c) & blocks(n, d) and ("equal" in rel or near and (set(m.split()) & set(n.split()) or ratio(m, n) >= 0.5) or ratio(m, n) >= 0.82):
                want.add((a, b))
    got = [(x.a, x.b) for x in review.possible_same(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    e = df.selectExpr("entity", "name_key as name", "cis", "try_cast(age as int) as years")
    small = review.alike_pairs(e, 4, 2)  # lists of few names and entities
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, review.alike_pairs(e).collect()))
