"""Operator 13, SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a bit set where over half of its three-word shingles'
64-bit hashes have it.  Texts link at DISTANCE or fewer differing bits.

The 64 bits are a ring of SEGMENTS segments.  By the pigeonring principle, two
fingerprints within DISTANCE have a segment at which a chain begins such that
its first l segments, for every l, differ in at most DISTANCE * l / SEGMENTS
bits together.  The first EQUAL segments of the chain must then be equal: they
are the key under which Spark brings fingerprints together, once for each place
on the ring.  Within a key the next segments may differ in one bit, so one half
of them is equal too; what shares that half is compared along the chain, and
only pairs whose whole chain keeps to its budgets come to the full distance.

Equal fingerprints are one node and never paired.  A key of more than MEMBERS
nodes is dealt in cells (part i with part j), so no task holds it whole.  A
task sends on a tree over each of its components and not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage
from .components import components
from .frames import read_table, take_columns
from .words import U

WIDTH, SEED, DISTANCE = 3, 42, 3
SEGMENTS = 16
BITS = 64 // SEGMENTS
#: Segments at the head of a chain that have to be equal (their budget is 0).
EQUAL = (SEGMENTS - 1) // DISTANCE
#: Segments of a chain that may differ in one bit together.
ONE = (2 * SEGMENTS - 1) // DISTANCE
#: Bits compared as equal within a key: the key and half of the next segments.
HALF = (ONE - EQUAL) * BITS // 2
#: Nodes that a task compares at once.
MEMBERS = 65_536
#: Shingles of a text whose bits are counted at once.
CHUNK = 1 << 15
#: Children of a node in the trees that stand for components.
FAN = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MASK = (1 << 64) - 1


def fingerprint(text: bytes) -> int:
    """Of the UTF-8 bytes of a text; without words 0."""
    words = text.translate(LOWER).split()  # at \x20 and \x09-\x0D
    if not words:
        return 0
    width = min(WIDTH, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:len(words) - width + 1]
    ends = ends[width - 1:]
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        found = b"".join([digest(joined[s:e], SEED) for s, e in zip(
            starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``print`` (the fingerprint's 64 bits as a signed number) of
    every row; a null text is an empty one.  No shuffle."""

    def rows(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), U, len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return take_columns(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, print long")


def rotated(prints: np.ndarray, by: int) -> np.ndarray:
    return prints << U(by) | prints >> U(64 - by) if by else prints


def chain_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the numbers ``x`` (chains written from the highest bit)
    that keep to the budgets of a chain from its head on.  A pair may come
    twice."""
    first = EQUAL * BITS
    heads = (x >> U(64 - first - HALF),
             x >> U(64 - first) << U(HALF)
             | x >> U(64 - first - 2 * HALF) & U((1 << HALF) - 1))
    out_a, out_b = [], []
    for head in heads:
        order = np.argsort(head, kind="stable")
        head, value = head[order], x[order]
        active, step = np.arange(len(x)), 0
        while len(active):
            step += 1
            active = active[active + step < len(x)]
            active = active[head[active] == head[active + step]]
            differ = value[active] ^ value[active + step]
            good = np.ones(len(active), bool)
            for l in range(EQUAL + 1, SEGMENTS):
                good &= np.bitwise_count(differ >> U(64 - l * BITS)) <= DISTANCE * l // SEGMENTS
            good &= np.bitwise_count(differ) <= DISTANCE
            out_a.append(order[active[good]])
            out_b.append(order[active[good] + step])
    return np.concatenate(out_a or [np.zeros(0, int)]), np.concatenate(out_b or [np.zeros(0, int)])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees over the components of the graph on n nodes: a member is
    linked with the (its place / FAN)th of its component, so no node has many."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    order = np.argsort(label, kind="stable")
    start = np.searchsorted(label[order], label[order])
    place = np.arange(n) - start
    some = place > 0
    return order[some], order[start[some] + (place[some] - 1) // FAN]


def cells(nodes: DataFrame, n: int, members: int = MEMBERS) -> DataFrame:
    """The nodes at each place on the ring as (place, part, cell_i, cell_j,
    chain).  ``part`` is as many leading bits of the chain as deal the nodes
    into groups of about ``members``; a group that is far larger all the same
    is dealt into cells."""
    bits = min(EQUAL * BITS, max(0, int(n // members).bit_length()))
    by = F.col("place") * BITS
    chain = F.expr(f"shiftleft(print, place * {BITS}) | "
                   f"CASE WHEN place = 0 THEN 0L ELSE shiftrightunsigned(print, 64 - place * {BITS}) END")
    placed = (nodes.select("print", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("place"))
              .withColumn("chain", chain)
              .select("place", "chain", (F.shiftrightunsigned("chain", 64 - bits) if bits else
                                         F.lit(0).cast("long")).alias("part")))
    # SEGMENTS << bits rows at most: about SEGMENTS * n / members
    large = (placed.groupBy("place", "part").count().filter(F.col("count") > 2 * members)
             .select("place", "part", F.ceil(F.col("count") / members).cast("int").alias("of")))
    slot = F.pmod(F.xxhash64("chain"), F.col("of")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("of") - 1), lambda x: x != slot))
    whole = placed.join(large, ["place", "part"], "left_anti").select(
        "place", "part", F.lit(0).alias("cell_i"), F.lit(0).alias("cell_j"), "chain")
    dealt = (placed.join(large, ["place", "part"]).withColumn("_slot", slot)
             .withColumn("_other", other)
             .select("place", "part", F.least("_slot", "_other").alias("cell_i"),
                     F.greatest("_slot", "_other").alias("cell_j"), "chain"))
    return whole.unionByName(dealt)


def print_links(nodes: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(a, b) edges between fingerprints that join all that links reach."""

    def linked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        place = key[0].as_py()
        x = table["chain"].to_numpy().view(U)
        here, there = forest(len(x), *chain_pairs(x))
        prints = rotated(x, (64 - place * BITS) % 64).view(np.int64)
        return pa.table({"a": prints[here], "b": prints[there]})

    return (cells(nodes, nodes.count(), members).groupBy("place", "part", "cell_i", "cell_j")
            .applyInArrow(linked, "a long, b long").distinct())


def simhash_components(docs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the least doc_id reachable by links, the own one included.
    Texts without words (null, empty) have fingerprint zero and are linked like
    any others.  Rows with equal texts are linked; a null id counts as larger
    than all, and where a component has no other its component_id is null.
    Very long texts are hashed in chunks."""
    rows = cut_lineage(fingerprints(docs))
    nodes = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    reached = components(print_links(nodes, members))
    joined = nodes.join(reached, nodes["print"] == reached["node"], "left") \
        .withColumn("component", F.coalesce("component", "print"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("print", "component_id")
    return (rows.join(named, "print")
            .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's fingerprint and component."""
    return simhash_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))
