"""Operator 2, n-gram Jaccard join by a blocked sparse matrix product.

The document by shingle incidence matrix X (five words, A-Z lower-cased) is
multiplied by its transpose in column blocks, and a pair's overlap counts are
added up over the blocks; pairs whose count cannot reach what their sizes
demand are dropped, the rest is checked on whole sets.  The join is exact:

1. Documents with equal sets are one node (64-bit name of the set), so copies
   are never paired.
2. All shingles have one total order: those held by more than OFTEN nodes
   ("frequent", counted over the whole corpus) last, else by hash.  Two sets of
   Jaccard similarity >= t that keep their first n - ceil(t n) + 1 shingles
   share one of them, so only these columns are multiplied.
3. With c shingles shared there, a pair's overlap is at most
   c + max(ceil(t n) - 1); linked pairs need t / (1 + t) of both sizes.
4. In a frequent column, documents are first checked against one of their
   number only; those found linked are one component, and only pairs of
   different components are then counted.

Blocks are packed numpy arrays grouped by Spark, one for BLOCK_BYTES of the
texts, so a group stays as large at any size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from .components import components
from .frames import give_back, groups_for, pieces, read_table, take_columns, text_bytes, with_plain_names
from .words import PLACE, U, mix, shingle_sets

WIDTH = 5
PERCENT = 80
#: Columns held by more nodes than this are frequent.
OFTEN = 64
#: Most frequent columns told to the tasks (the most frequent first).  This
#: bounds a broadcast to 8 MB; any choice of columns keeps the join exact.
TOLD = 1_000_000
#: Text bytes whose shingles make a block.
BLOCK_BYTES = 16 << 20
#: Shingles gathered in a task before they are sent on.
FLUSH = 1_000_000
#: Bits of the table that tells which nodes' sets are needed (512 KB).
NEEDED = 1 << 22

#: ``rare``: how many of the node's shingles are not frequent.
ENTRY = np.dtype([("gram", "<u8"), ("node", "<i8"), ("n", "<u4"), ("rare", "<u4")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<u4"), ("nb", "<u4"), ("c", "<u4")])


def node_name(grams: np.ndarray) -> int:
    """64-bit name of a set of shingles, the same for equal sets."""
    total = mix(grams + PLACE[40]).sum(dtype=U, keepdims=True)
    return int(mix(total + np.full(1, len(grams), U) * PLACE[41]).astype(np.int64)[0])


def block_of(grams: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((grams >> U(32)) * U(n_blocks)) >> U(32)


def column_code(grams: np.ndarray, n_blocks: int) -> np.ndarray:
    """Block and low 32 bits: enough of a hash to count a column's documents."""
    return block_of(grams, n_blocks) << U(32) | (grams & U(0xFFFFFFFF))


def kept(n: int) -> int:
    """Leading shingles that a set of n keeps."""
    return n - (PERCENT * n + 99) // 100 + 1


def need(na, nb):
    """Least overlap of linked sets of these sizes."""
    return (PERCENT * (na + nb) + 99 + PERCENT) // (100 + PERCENT)


def task_sets(batches, text: str = "text"):
    """(node, set) of the rows with words, each set once a task."""
    seen = set()
    for b in pieces(batches, text):
        for i, grams in enumerate(shingle_sets(*text_bytes(b.column(text)), WIDTH)):
            if len(grams):
                node = node_name(grams)
                if node not in seen:
                    seen.add(node)
                    yield node, grams


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(sorted_values)]]))


def packed(keys: np.ndarray, records: np.ndarray, names: list[str], **fixed):
    """One row a key: the key and its records as bytes."""
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    starts, sizes = runs(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(starts), v, np.int32)) for v in fixed.values()]
        + [pa.array(keys[starts].astype(np.int32)),
           pa.array([records[s:s + n].tobytes() for s, n in zip(starts, sizes, strict=True)],
                    pa.binary())],
        [*fixed, *names])


def unpack(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def document_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node (null for a text without words), n of every row."""

    def rows(batches):
        for b in pieces(batches, "text"):
            sets = shingle_sets(*text_bytes(b.column("text")), WIDTH)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"),
                 pa.array([node_name(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "node", "n"])

    return docs.mapInArrow(rows, "doc_id long, node long, n long")


def frequent_columns(docs: DataFrame, n_blocks: int) -> np.ndarray:
    """Codes of the columns held by more than OFTEN nodes."""

    def count(batches):
        held, size = [], 0

        def send():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            out = np.zeros(len(codes), [("low", "<u4"), ("n", "<u4")])
            out["low"], out["n"] = codes & U(0xFFFFFFFF), n
            block = (codes >> U(32)).astype(np.int32)
            once = n == 1
            for many, part in ((0, once), (1, ~once)):
                if part.any():
                    yield packed(block[part], out["low"][part] if not many else out[part],
                                 ["block", "data"], many=many)

        for _, grams in task_sets(batches):
            held.append(column_code(grams, n_blocks))
            size += len(grams)
            if size >= FLUSH:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    def often(table: pa.Table) -> pa.Table:
        give_back()  # of the group before
        many = table["many"].to_numpy()
        once = unpack(table["data"].filter(pa.array(many == 0)), "<u4")
        more = unpack(table["data"].filter(pa.array(many == 1)), [("low", "<u4"), ("n", "<u4")])
        low, n = np.unique(once, return_counts=True)
        some, at = np.unique(more["low"], return_inverse=True)
        many = np.bincount(at, more["n"], minlength=len(some)).astype(np.int64)
        if len(low) and len(some):  # columns seen once in one task, more often in another
            at = np.minimum(np.searchsorted(low, some), len(low) - 1)
            same = low[at] == some
            many[same] += n[at[same]]
            n[at[same]] = 0
        low, n = np.concatenate([low, some]), np.concatenate([n, many])
        keep = n > OFTEN
        block = table["block"][0].as_py()
        return pa.table({"code": pa.array((np.int64(block) << 32 | low[keep].astype(np.int64))),
                         "n": pa.array(n[keep].astype(np.int64))})

    found = (docs.mapInArrow(count, "many int, block int, data binary")
             .groupBy("block").applyInArrow(often, "code long, n long")
             .orderBy(F.desc("n"), "code").limit(TOLD).select("code").toArrow())
    return np.sort(found["code"].to_numpy().astype(U))


def entries(docs: DataFrame, frequent: np.ndarray, n_blocks: int) -> DataFrame:
    """The kept columns of every node, packed by block."""

    def rows(batches):
        held, size = [], 0

        def send():
            out = np.concatenate(held)
            return packed(block_of(out["gram"], n_blocks).astype(np.int32), out, ["block", "data"])

        for node, grams in task_sets(batches):
            rare = len(grams)
            if len(frequent):
                code = column_code(grams, n_blocks)
                at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
                common = frequent[at] == code
                if common.any():
                    grams = np.concatenate([grams[~common], grams[common]])
                    rare -= int(common.sum())
            own = np.zeros(kept(len(grams)), ENTRY)
            own["gram"], own["node"], own["n"] = grams[:len(own)], node, len(grams)
            own["rare"] = rare
            held.append(own)
            size += len(own)
            if size >= FLUSH // 4:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return docs.mapInArrow(rows, "block int, data binary")


def columns(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of (gram, n, node), each once, and each one's column
    size."""
    rows = rows[np.lexsort((rows["node"], rows["n"], rows["gram"]))]
    if len(rows):
        rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])]
    starts, sizes = runs(rows["gram"]) if len(rows) else (np.zeros(0, int),) * 2
    return rows, np.repeat(sizes, sizes)


def products(rows: np.ndarray, component: np.ndarray | None = None) -> np.ndarray:
    """Pairs of entries in one column whose sizes allow a link (and whose
    components differ), with how many columns they share here."""
    out, held = [], 0
    active, step = np.arange(len(rows)), 0
    while len(active):
        step += 1
        active = active[active + step < len(rows)]
        other = active + step
        # in a column entries go by size: once too large, always too large
        near = (rows["gram"][active] == rows["gram"][other]) \
            & (100 * rows["n"][active].astype(np.int64) >= PERCENT * rows["n"][other].astype(np.int64))
        active, other = active[near], other[near]
        use = slice(None) if component is None else component[active] != component[other]
        a, b = rows[active[use]], rows[other[use]]
        pair = np.zeros(len(a), PAIR)
        swap = a["node"] > b["node"]
        for x, y, nx, ny, s in (("a", "b", "na", "nb", ~swap), ("b", "a", "nb", "na", swap)):
            pair[x][s], pair[y][s] = a["node"][s], b["node"][s]
            pair[nx][s], pair[ny][s] = a["n"][s], b["n"][s]
        pair["c"] = 1
        out.append(pair)
        held += len(pair)
        if held > FLUSH // 4:
            out = [added(np.concatenate(out))]
            held = 0
    return added(np.concatenate(out)) if out else np.zeros(0, PAIR)


def added(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, its counts added."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    new = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    starts = np.flatnonzero(np.concatenate([[True], new]))
    out = pairs[starts]
    out["c"] = np.add.reduceat(pairs["c"], starts)
    return out


RARE, STAR, FREQUENT = 0, 1, 2
PARTS = "kind int, bucket int, data binary"


def pair_bucket(pairs: np.ndarray, n_blocks: int) -> np.ndarray:
    h = mix(pairs["a"].astype(U) * PLACE[50] + pairs["b"].astype(U) * PLACE[51])
    return ((h >> U(32)) * U(n_blocks) >> U(32)).astype(np.int32)


def multiply(packed_entries: DataFrame, n_blocks: int) -> DataFrame:
    """Per block: counted pairs of its rare columns; for its frequent ones the
    pairs with one member, and the entries themselves.  That member is the one
    with the fewest shingles of its own: of near copies, the one that the
    others were made from."""

    def one(table: pa.Table) -> pa.Table:
        give_back()  # of the group before
        rows, size = columns(unpack(table["data"], ENTRY))
        out = []
        pairs = products(rows[size <= OFTEN])
        if len(pairs):
            out.append(packed(pair_bucket(pairs, n_blocks), pairs, ["bucket", "data"], kind=RARE))
        many = rows[size > OFTEN]
        if len(many):
            starts, sizes = runs(many["gram"])
            by_node = many[np.lexsort((many["node"], many["rare"], many["gram"]))]
            hub = np.repeat(by_node[starts], sizes)
            low, high = np.minimum(hub["n"], by_node["n"]), np.maximum(hub["n"], by_node["n"])
            good = (hub["node"] != by_node["node"]) \
                & (100 * low.astype(np.int64) >= PERCENT * high.astype(np.int64))
            star = np.zeros(int(good.sum()), PAIR)
            star["a"], star["b"] = hub["node"][good], by_node["node"][good]
            star["na"], star["nb"] = hub["n"][good], by_node["n"][good]
            if len(star):
                star = added(star)
                out.append(packed(pair_bucket(star, n_blocks), star, ["bucket", "data"], kind=STAR))
            block = np.full(len(many), table["block"][0].as_py(), np.int32)
            out.append(packed(block, many, ["bucket", "data"], kind=FREQUENT))
        return pa.Table.from_batches(out) if out else pa.table(
            {"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()),
             "data": pa.array([], pa.binary())})

    return packed_entries.groupBy("block").applyInArrow(one, PARTS)


def multiply_frequent(parts: DataFrame, linked: DataFrame, n_blocks: int) -> DataFrame:
    """Counted pairs of the frequent columns, of different components only."""

    def nodes(batches):
        for b in batches:
            for block, data in zip(b.column("bucket"), b.column("data"), strict=True):
                own = np.unique(np.frombuffer(data.as_buffer(), ENTRY)["node"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block.as_py(), np.int32)), pa.array(own)],
                    ["bucket", "node"])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # of the group before
        rows, _ = columns(unpack(left["data"], ENTRY))
        node, component = right["node"].to_numpy(), right["component"].to_numpy()
        order = np.argsort(node)
        node, component = node[order], component[order]
        if len(node):
            at = np.minimum(np.searchsorted(node, rows["node"]), len(node) - 1)
            component = np.where(node[at] == rows["node"], component[at], rows["node"])
        else:
            component = rows["node"].copy()
        pairs = products(rows, component)
        if not len(pairs):
            return pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()),
                             "data": pa.array([], pa.binary())})
        return pa.Table.from_batches([packed(pair_bucket(pairs, n_blocks), pairs,
                                             ["bucket", "data"], kind=RARE)])

    rows = parts.filter(F.col("kind") == FREQUENT)
    known = (rows.select("bucket", "data").mapInArrow(nodes, "bucket int, node long")
             .join(linked, "node").select("bucket", "node", "component"))
    return (rows.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(one, PARTS))


def possible(parts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose added counts can still reach a link."""

    def one(table: pa.Table) -> pa.Table:
        give_back()  # of the group before
        pairs = added(unpack(table["data"], PAIR))
        na, nb = pairs["na"].astype(np.int64), pairs["nb"].astype(np.int64)
        beyond = (PERCENT * np.maximum(na, nb) + 99) // 100 - 1
        pairs = pairs[pairs["c"] + beyond >= need(na, nb)]
        return pa.table({"a": pa.array(pairs["a"]), "b": pa.array(pairs["b"])})

    return parts.groupBy("bucket").applyInArrow(one, "a long, b long")


def plain_pairs(parts: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            pairs = unpack(b.column("data"), PAIR)
            yield pa.RecordBatch.from_arrays([pa.array(pairs["a"]), pa.array(pairs["b"])], ["a", "b"])

    return parts.select("data").mapInArrow(rows, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are linked, by the overlap of their whole sets.  Sets of
    the nodes in ``pairs`` alone are moved: a fixed-size bit table leaves out
    most others, the joins the rest."""
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bits = np.zeros(NEEDED, bool)
    at = (ends.select(F.pmod("node", F.lit(NEEDED)).cast("int").alias("at")).distinct()
          .toArrow()["at"].to_numpy())  # NEEDED numbers at most
    bits[at] = True
    bits = np.packbits(bits)

    def sets(batches):
        table = np.unpackbits(bits).view(bool)
        for node, grams in task_sets(batches):
            if table[node % NEEDED]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node]), pa.array([grams.astype(np.int64)], pa.list_(pa.int64()))],
                    ["node", "grams"])

    if not len(at):
        return pairs
    own = (docs.mapInArrow(sets, "node long, grams array<long>")
           .join(ends.distinct(), "node", "left_semi").dropDuplicates(["node"]))
    own = cut_lineage(own)
    return (pairs.join(own.toDF("a", "_ga"), "a").join(own.toDF("b", "_gb"), "b")
            .withColumn("_i", F.size(F.array_intersect("_ga", "_gb")))
            .filter(100 * F.col("_i") >= PERCENT * (F.size("_ga") + F.size("_gb") - F.col("_i")))
            .select("a", "b"))


def node_links(docs: DataFrame) -> DataFrame:
    """(a, b) links that join the nodes of each component.  Between nodes of a
    frequent column links are left out where others connect them already."""
    n_blocks = groups_for(docs, BLOCK_BYTES)
    frequent = frequent_columns(docs, n_blocks)
    parts = cut_lineage(multiply(entries(docs, frequent, n_blocks), n_blocks))
    counted = parts.filter(F.col("kind") == RARE)
    star = parts.filter(F.col("kind") == STAR)
    if parts.filter(F.col("kind") == FREQUENT).isEmpty():
        return verified(docs, possible(counted))
    first = cut_lineage(verified(docs, plain_pairs(star)))
    more = multiply_frequent(parts, components(first), n_blocks)
    return first.union(verified(docs, possible(counted.union(more))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) that stay when one document
    of each component does: the one of the smallest doc_id; of rows equal in id
    and set, the least in all columns.  Rows without words all stay."""
    docs, restored = with_plain_names(docs, "doc_id", "text")
    names = docs.columns

    def named(batches):
        for b in pieces(batches, "text"):
            sets = shingle_sets(*text_bytes(b.column("text")), WIDTH)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([node_name(s) if len(s) else None for s in sets], pa.int64())],
                [*b.schema.names, "_node"])

    rows = docs.mapInArrow(named, T.StructType(
        [*docs.schema.fields, T.StructField("_node", T.LongType())]))
    plain = take_columns(docs, "doc_id", "text")
    nodes = cut_lineage(document_nodes(plain).filter("node IS NOT NULL").groupBy("node")
                        .agg(F.min("doc_id").alias("least")))
    joined = nodes.join(components(node_links(plain)), "node", "left")
    stay = joined.groupBy(F.coalesce("component", "node").alias("_c")).agg(
        F.min(F.struct(F.col("least").isNull().alias("_no_id"), "least", "node")).alias("s")) \
        .select(F.col("s.node").alias("_node"), F.coalesce("s.least", F.lit(0)).alias("_id"),
                F.col("s._no_id").alias("_no_id"))
    own = ["_node", "_id", "_no_id"]
    # one id a set stays, so rows of equal keys are those to choose among: the
    # choice goes by the join's partitions and moves no text again
    kept_rows = (rows.withColumn("_id", F.coalesce("doc_id", F.lit(0)))
                 .withColumn("_no_id", F.col("doc_id").isNull()).join(stay, own, "left_semi"))
    first = (kept_rows.groupBy(*own).agg(F.min(F.struct(*names)).alias("_row"))
             .select("_row.*"))
    return restored(first.unionByName(rows.filter("_node IS NULL").select(*names)))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable by links of Jaccard
    similarity >= 0.8, the own one included.  A text without words (null,
    empty) has no shingles and is linked with nothing.  Rows with equal texts,
    also of equal ids, are linked; a null id counts as larger than all."""
    docs = take_columns(docs, "doc_id", "text")
    rows = cut_lineage(document_nodes(docs))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = components(node_links(docs))
    joined = nodes.join(linked, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("node", "component_id")
    return (rows.join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def ngram_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's shingle count and component."""
    return jaccard_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3),
         lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)
  UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.least AS component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r
  ON s.doc_id = r.doc_id
"""
