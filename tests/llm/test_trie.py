"""The prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from ticklattice.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, node string, n int"


def conversations():
    rng = random.Random(7)
    say = ["hi", "héllo", "", None, "yes", "no 日本", "x" * 300]
    rows = []
    for conv in [*range(-7, 120), 500, 503, 900]:
        if conv % 5 == 0 and conv % 15 == 0:
            continue  # the family has no opening
        for turn in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(say)))
    for conv in range(1000, 1100):  # one text, very often
        rows += [(conv, k, "user", "same") for k in range(3)]
    rows += [(2001, k // 3, "user", f"t{k % 4}") for k in range(400)]  # long, with ties and repeats
    rows += [(2002, k // 3, "user", f"t{k % 4}") for k in range(390)]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {k: [x for _, x in sorted(v)] for k, v in own.items()}
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = tuple(own.get(conv - int(math.fmod(conv, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(x) for x in sorted(of) if len(whole[x]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        last = node[-1] if node else (None, None)
        out.append((min(of), len(node), parent, len(of), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(), *last))
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_equals_brute_force(spark, block):
    rows = conversations()
    given = spark.createDataFrame([(*r, 1, "node", 2) for r in rows], SCHEMA).repartition(5)
    found = trie.prefix_trie(given, block=block, texts=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "role", "text"
    )
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # 4 takes nothing from the absent 0 and loses its first turn to h.
    conv = next(k for k in range(1, 1000) if k % 5 and zlib.crc32(str(k).encode()) % 9 > 0)
    found = trie.prefix_trie(spark.createDataFrame([(conv, None, "user", "one", 1, "", 1)], SCHEMA)).collect()
    assert [tuple(r)[:7] for r in found] == [(conv, 0, None, 1, 0, 1, 0)]
    assert found[0]["ends_sha256"] == hashlib.sha256(str(conv).encode()).hexdigest()
