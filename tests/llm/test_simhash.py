"""Operator 13: fingerprints and components against plain Python."""

import random
import re

import numpy as np
import xxhash

from papersieve.llm import simhash
from papersieve.llm.frames import read_table, take_columns

from . import edge

SMALL = "/root/testdata/sf0.001"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = ([" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
             or ([" ".join(words)] if words else []))
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(rows):
    """rows of (doc_id, print): least reachable id of each."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return sorted(((d is None, d or 0, f"{p:016x}", least.get(find(p))) for d, p in rows), key=str)


def check(spark, docs, members=simhash.MEMBERS):
    want = plain_components([(r.doc_id, plain_print(r.text))
                             for r in take_columns(docs, "doc_id", "text").collect()])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id)
                  for r in simhash.simhash_components(docs, members).collect()), key=str)
    assert got == want


def test_components_equal_brute_force(spark):
    check(spark, read_table(spark, SMALL, "documents", "doc_id", "text"))


def test_query_is_the_operator(spark):
    docs = read_table(spark, SMALL, "documents", "doc_id", "text")
    want = plain_components([(r.doc_id, plain_print(r.text)) for r in docs.collect()])
    got = sorted(((False, r.doc_id, r.fingerprint, r.component_id)
                  for r in simhash.simhash_dedup(spark, SMALL).collect()), key=str)
    assert got == want


def test_edges(spark):
    docs = edge.documents(spark)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(edge.ROWS)
    none = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert len(none) == 1
    check(spark, docs)
    assert simhash.simhash_components(edge.empty(spark)).count() == 0
    long_one = " ".join(f"w{i % 997}" for i in range(simhash.CHUNK + 5000))
    assert simhash.fingerprint(long_one.encode()) == plain_print(long_one)


def near_prints(seed=3, n=300):
    draw = random.Random(seed)
    prints = []
    for _ in range(n):
        p = draw.getrandbits(64)
        prints.append(p)
        for _ in range(draw.randrange(4)):
            q = p
            for _ in range(draw.randrange(1, 6)):
                q ^= 1 << draw.randrange(64)
            prints.append(q)
    center = draw.getrandbits(64)  # one dense ball
    for _ in range(400):
        q = center
        for _ in range(draw.randrange(5)):
            q ^= 1 << draw.randrange(64)
        prints.append(q)
    return prints


def test_links_of_dense_prints_equal_brute_force(spark):
    prints = near_prints()
    want = {(f, c) for _, _, f, c in plain_components(list(enumerate(prints)))}
    for members in (simhash.MEMBERS, 40):  # 40: groups and cells of a hot key
        nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)],
                                      "print long")
        reached = {r.node: r.component for r in
                   simhash.components(simhash.print_links(nodes, members)).collect()}
        by = {}
        for i, p in enumerate(prints):
            s = int(np.uint64(p).astype(np.int64))
            by.setdefault(reached.get(s, s), []).append(i)
        got = {(f"{prints[i]:016x}", min(ids)) for ids in by.values() for i in ids}
        assert got == want


def test_every_near_pair_has_a_chain():
    draw = random.Random(7)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << draw.randrange(64)
        pair = np.array([a, b], np.uint64)
        assert any(len(simhash.chain_pairs(simhash.rotated(pair, p * simhash.BITS))[0])
                   for p in range(simhash.SEGMENTS))


def test_forest_has_bounded_degree():
    a = np.zeros(5000, int)
    b = np.arange(1, 5001)
    x, y = simhash.forest(5001, a, b)
    assert len(x) == 5000 and np.bincount(np.concatenate([x, y])).max() <= simhash.FAN + 1
