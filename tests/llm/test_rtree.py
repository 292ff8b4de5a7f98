"""The Jaccard join against brute force, and what its trees rule out."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ticklattice.llm import rtree

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def brute(rows, least=(9, 10), size=3):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * least[1] >= max(len(sets[a]), len(sets[b])) * least[0]:
                if least[1] * len(sets[a] & sets[b]) >= least[0] * len(sets[a] | sets[b]):
                    links += sets[a] != sets[b]
                    root[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    return [(i, len(s), smallest[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))], links


def corpus():
    rng = random.Random(11)
    words = lambda n: [f"{rng.choice(['Wort', 'mot', 'wörd'])}{rng.randrange(4000)}" for _ in range(n)]
    texts = [None, "", " \n\t", "one", "One", "two words", "two  words", "a b c", "A b\nc", "a b c d", "x " * 5000, "y " * 40]
    for n in (11, 12, 19, 30, 60, 148, 400, 1500):
        base = words(n)
        for edits in (0, 0, 1, 1, 2, 3, max(1, n // 60), max(1, n // 45), n // 20):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words(1))
            texts.append(" ".join(copy))
        texts += [" ".join(base[: int(n * 0.92)]), " ".join(base + words(max(1, n // 15)))]
    original = words(150)  # many copies of one original, near the border
    for k in range(150):
        copy = list(original)
        for _ in range(k % 6):
            copy[rng.randrange(len(copy))] = words(1)[0]
        texts.append(" ".join(copy))
    common = words(40)
    texts += [" ".join(words(20) + common + words(20)) for _ in range(40)]
    texts += [" ".join(words(25)) for _ in range(60)]
    rows = [(k if k % 29 else None, t) for k, t in enumerate(texts)]
    rows[7] = (3, rows[7][1])  # a doc_id that repeats with another text
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, id int, key string, first int, component string"


@pytest.mark.parametrize("block", [16, rtree.BLOCK])
def test_equals_brute_force(spark, block):
    rows = corpus()
    given = spark.createDataFrame([(*r, 1, "key", 2, "x") for r in rows], SCHEMA).repartition(4)
    want, links = brute(rows)
    assert links > 300
    assert sorted(map(tuple, rtree.near_duplicates(given, block=block).collect()), key=repr) == sorted(want, key=repr)


def test_other_similarity_and_size(spark):
    rows = corpus()[::2]
    given = spark.createDataFrame([(*r, 1, "key", 2, "x") for r in rows], SCHEMA).repartition(4)
    found = rtree.near_duplicates(given, size=2, least=(4, 5)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows, (4, 5), 2)[0], key=repr)


def test_empty_and_without_words(spark):
    assert rtree.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    found = rtree.near_duplicates(spark.createDataFrame([(5, None, 1, "", 1, ""), (6, " ", 1, "", 1, "")], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == [(5, 0, 5), (6, 0, 6)]


def test_boxes_rule_out_most_pairs_and_no_link():
    rng = np.random.default_rng(4)
    middles = rng.integers(0, 40, (50, rtree.COORDS))
    vectors = np.repeat(middles, 20, axis=0) + rng.integers(0, 2, (1000, rtree.COORDS))
    tree = rtree.Boxes(vectors, vectors.sum(1), np.arange(1000))
    tested = []
    found = {tuple(sorted(x)) for x in zip(*(k.tolist() for k in rtree.search(tree, tree, (9, 10), tested)), strict=True)}
    size = vectors.sum(1)
    want = set()
    for a in range(1000):
        over = np.minimum(vectors[a], vectors[:a]).sum(1) * 19 >= 9 * (size[a] + size[:a])
        over &= np.minimum(size[a], size[:a]) * 10 >= 9 * np.maximum(size[a], size[:a])
        want |= {(int(b), a) for b in np.flatnonzero(over)}
    assert found == want and sum(tested) < 0.4 * 1000 * 999 / 2
