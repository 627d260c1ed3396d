"""Operator 7, language-model scores by context-tree weighting.

A byte is eight binary decisions; each decision (the bits already known of the
byte) has a context tree over the DEPTH bytes before it, nearest first.  A node
keeps a Krichevsky-Trofimov estimate, and its weighted probability is the mean
of that estimate and of the product over its children.  After training the
tree is frozen: a decision's probability is the mix of the estimates along its
context's path, and a text's score is the sum over all its bytes and an end
symbol.  Texts are lower-cased (A-Z); a context does not reach before a text.

What the corpus tells is large (all distinct runs of DEPTH + 1 bytes), so it is
never broadcast.  Texts are read once and packed into parts of about PART
bytes; each part asks for the runs that it holds, the runs are dealt out by
their three nearest context bytes, each such shard grows its subtrees and
answers, and answers meet the part again.  Levels 0 to 2 of the tree (at most
65,793 contexts, 255 decisions each) are summed by DataFrame aggregates and
told to the shards.  Words of the base score take the same way.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage
from .frames import groups_for, pieces, read_table, take_columns, text_bytes
from .words import LOWER, U, mix, span_hashes, word_spans

DEPTH = 5
#: Text bytes of one part.
PART = 16 << 20
#: Text bytes for each shard of the contexts and words.
SHARD = 16 << 20
CHUNK = 1 << 21
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never holds
TEXT, RUNS, WORDS = 0, 1, 2
LOG_HALF, LOG10_2 = float(np.log(0.5)), float(np.log10(2))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series at x + 8."""
    shift, y = np.ones_like(x), x
    for _ in range(8):
        shift = shift * y
        y = y + 1
    r = 1 / (y * y)
    return ((y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi)
            + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(shift))


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return (log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0)
            - np.log(np.pi))


def weigh(n0, n1, children):
    """(estimate of a one, weight of the own estimate, log weighted
    probability) of nodes whose children's log probabilities sum up to
    ``children`` (None at full depth)."""
    n0, n1 = n0.astype(float), n1.astype(float)
    own = kt_log(n0, n1)
    kt = (n1 + 0.5) / (n0 + n1 + 1)
    if children is None:
        return kt, np.ones_like(own), own
    return (kt, 1 / (1 + np.exp(np.clip(children - own, -700, 700))),
            LOG_HALF + np.logaddexp(own, children))


def run_keys(buf: np.ndarray, offsets: np.ndarray):
    """Runs of DEPTH context bytes and a byte as numbers, the nearest context
    byte highest and the byte itself lowest, in chunks; with each text's end
    in the whole sequence (one run for each byte and the end symbol)."""
    sizes = np.diff(offsets)
    out = np.full(int(offsets[-1]) + len(sizes) * (DEPTH + 1), PAD, np.uint8)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(buf)) + text * (DEPTH + 1) + DEPTH] = LOWER[buf]
    ends = offsets[1:] + np.arange(1, len(sizes) + 1) * (DEPTH + 1) - 1
    out[ends] = END

    def chunks():
        for a in range(DEPTH, len(out), CHUNK):
            b = min(a + CHUNK, len(out))
            key = np.zeros(b - a, U)
            for j in range(1, DEPTH + 1):
                key = key << U(8) | out[a - j:b - j].astype(U)
            byte = out[a:b]
            yield (key << U(8) | byte.astype(U))[byte != PAD]

    return chunks(), np.cumsum(sizes + 1)


def shard_of(runs: np.ndarray, n: int) -> np.ndarray:
    """Shard of each run, by its three nearest context bytes."""
    return ((mix(runs >> U(8 * (DEPTH - 2))) >> U(32)) * U(n) >> U(32)).astype(np.int64)


def word_shard(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> U(32)) * U(n) >> U(32)).astype(np.int64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays (sorted ones as differences) by byte planes, zstd."""
    blob = b""
    for x in arrays:
        raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
        part = zstandard.ZstdCompressor(level=1).compress(raw)
        blob += len(part).to_bytes(8, "little") + part
    return blob


def spread_out(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at:at + 8], "little")
        raw = zstandard.ZstdDecompressor().decompress(blob[at + 8:at + 8 + n])
        out.append(np.ascontiguousarray(
            np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel())
        at += 8 + n
    return out


class Tally:
    """Distinct keys with how often each occurs in training texts."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, train: np.ndarray, other: np.ndarray):
        k, n = np.unique(train, return_counts=True)
        o = np.unique(other)
        self.keys += [k, o]
        self.counts += [n, np.zeros(len(o), np.int64)]
        self.held += len(k) + len(o)
        if self.held > 2 * CHUNK:
            k, n = self.result()
            self.keys, self.counts, self.held = [k], [n], 0

    def result(self):
        return summed(np.concatenate([*self.keys, np.zeros(0, U)]),
                      np.concatenate([*self.counts, np.zeros(0, np.int64)]))


def summed(keys: np.ndarray, counts: np.ndarray):
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def by_shard(keys: np.ndarray, shard: np.ndarray):
    """Order that puts sorted keys by shard, and where shards begin."""
    order = np.argsort(shard, kind="stable")
    dealt = shard[order]
    return order, np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]])[:len(keys)])


def word_hashes(buf, offsets):
    starts, ends, counts = word_spans(buf, offsets)
    return span_hashes(buf, starts, ends, lower=True), counts


PARTS = "kind int, part long, shard int, data binary, more binary"


def pack_parts(docs: DataFrame, n_shards: int, part_bytes: int = PART) -> DataFrame:
    """Rows of doc_id, text, held_out as parts: the packed texts, and what each
    part asks of each shard.  A part's number is random; the table is written
    once, and all later steps read it."""

    def send(rows: list[pa.RecordBatch]):
        part = int.from_bytes(os.urandom(8), "little") >> 1
        table = pa.Table.from_batches(rows)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        packed = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
        runs, words = Tally(), Tally()
        for b in pieces(table.to_batches(), "text", CHUNK):
            buf, offsets = text_bytes(b.column("text"))
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            chunks, ends = run_keys(buf, offsets)
            at = 0
            for keys in chunks:
                own = held[np.searchsorted(ends, np.arange(at, at + len(keys)), "right")]
                runs.add(keys[~own], keys[own])
                at += len(keys)
            h, counts = word_hashes(buf, offsets)
            own = np.repeat(held, counts)
            words.add(h[~own], h[own])
        rows = [(TEXT, -1, packed, None)]
        for kind, tally, place in ((RUNS, runs, shard_of), (WORDS, words, word_shard)):
            keys, counts = tally.result()
            if not len(keys):
                continue
            shard = place(keys, n_shards)
            order, starts = by_shard(keys, shard)
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                own = order[a:b]
                rows.append((kind, int(shard[own[0]]), squeeze(
                    np.diff(keys[own], prepend=U(0)), counts[own]), None))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()),
             pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()),
             pa.array([r[3] for r in rows], pa.binary())],
            ["kind", "part", "shard", "data", "more"])

    def pack(batches):
        held, size = [], 0
        for b in pieces(batches, "text"):
            held.append(b)
            size += len(text_bytes(b.column("text"))[0])
            if size >= part_bytes:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return docs.mapInArrow(pack, PARTS)


def asked(table: pa.Table):
    """Each request's keys, and all requests' summed counts."""
    found = [spread_out(x.as_py()) for x in table["data"]]
    keys = [np.cumsum(d, dtype=U) for d, _ in found]
    return keys, summed(np.concatenate(keys), np.concatenate([n for _, n in found]).astype(np.int64))


def level_nodes(runs: np.ndarray, counts: np.ndarray, bit: int):
    """(key, n0, n1) of one level's nodes for the ``bit``-th decision.  Runs
    are context << 8 | byte, sorted; a key is context << 8 | known bits."""
    one = (runs >> U(7 - bit) & U(1)).astype(np.int64)
    known = U(1 << bit) | (runs & U(255)) >> U(8 - bit)
    key = (runs >> U(8)) << U(8) | known
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n1 = np.add.reduceat(counts * one, first)
    return key[first], np.add.reduceat(counts, first) - n1, n1


def subtrees(runs: np.ndarray, counts: np.ndarray):
    """For each decision, the levels DEPTH to 3 as (key, n0, n1, kt, weight, log
    probability), over trained runs."""
    tables = {DEPTH: (runs, counts)}
    for d in range(DEPTH - 1, 2, -1):
        k, n = tables[d + 1]
        tables[d] = summed((k >> U(16)) << U(8) | k & U(255), n)
    for bit in range(8):
        levels, below = [], None
        for d in range(DEPTH, 2, -1):
            key, n0, n1 = level_nodes(*tables[d], bit)
            children = None
            if below is not None:
                parent = (below[0] >> U(16)) << U(8) | below[0] & U(255)
                children = np.bincount(np.searchsorted(key, parent), below[1], minlength=len(key))
            kt, weight, log_p = weigh(n0, n1, children)
            below = key, log_p
            levels.append((key, n0, n1, kt, weight, log_p))
        yield levels


def find(keys: np.ndarray, wanted: np.ndarray):
    """(position, whether it is there) of each wanted key in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def grow(requests: DataFrame) -> DataFrame:
    """The level 3 nodes of every shard: key, n0, n1, log_p."""

    def one(table: pa.Table) -> pa.Table:
        _, (runs, counts) = asked(table)
        seen = counts > 0
        out = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if seen.any():
            out += [(v[0], v[1], v[2], v[5]) for *_, v in subtrees(runs[seen], counts[seen])]
        key, n0, n1, log_p = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"key": pa.array(key.astype(np.int64)), "n0": pa.array(n0),
                         "n1": pa.array(n1), "log_p": pa.array(log_p)})

    return requests.groupBy("shard").applyInArrow(one, "key long, n0 long, n1 long, log_p double")


def upper_levels(nodes: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, kt, weight) of levels 2, 1 and 0, from the level 3 nodes."""

    def mix_up(batches):
        for b in batches:
            kt, weight, log_p = weigh(*(b.column(c).to_numpy() for c in ("n0", "n1", "children")))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("n0"), b.column("n1"), pa.array(log_p), pa.array(kt),
                 pa.array(weight)], ["key", "n0", "n1", "log_p", "kt", "weight"])

    out = []
    for _ in range(3):
        parent = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(255))
        nodes = cut_lineage(
            nodes.groupBy(parent.alias("key"))
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_p").alias("children"))
            .mapInArrow(mix_up, "key long, n0 long, n1 long, log_p double, kt double, weight double"))
        t = nodes.select("key", "kt", "weight").orderBy("key").toArrow()
        out.append((t["key"].to_numpy().astype(U), t["kt"].to_numpy(), t["weight"].to_numpy()))
    return out


def run_scores(wanted: np.ndarray, runs: np.ndarray, counts: np.ndarray, upper) -> np.ndarray:
    """log10 probability of each wanted run's byte in its context."""
    total = np.zeros(len(wanted))
    trees = subtrees(runs, counts) if len(runs) else iter([[]] * 8)
    for bit, levels in enumerate(trees):
        known = U(1 << bit) | (wanted & U(255)) >> U(8 - bit)
        p = np.full(len(wanted), 0.5)  # what a node never seen says
        found = [(v[0], v[3], v[4]) for v in levels] or [None] * (DEPTH - 2)
        for d, level in zip(range(DEPTH, -1, -1), [*found, *upper], strict=True):
            if level is None:
                continue
            keys, kt, weight = level
            at, there = find(keys, (wanted >> U(8 * (DEPTH - d + 1))) << U(8) | known)
            if there.any():
                mixed = weight[at] * kt[at] + (1 - weight[at]) * p
                p = np.where(there, mixed, 0.5)
        one = (wanted >> U(7 - bit) & U(1)).astype(bool)
        total += np.log10(np.where(one, p, 1 - p))
    return total


def answer_runs(requests: DataFrame, upper) -> DataFrame:
    """To each request the scores of its runs, in its order."""

    def one(table: pa.Table) -> pa.Table:
        keys, (runs, counts) = asked(table)
        seen = counts > 0
        score = run_scores(runs, runs[seen], counts[seen], upper)
        data = [score[np.searchsorted(runs, k)].tobytes() for k in keys]
        return pa.table({"part": table["part"], "kind": table["kind"], "shard": table["shard"],
                         "data": pa.array(data, pa.binary())})

    return requests.groupBy("shard").applyInArrow(
        one, "part long, kind int, shard int, data binary")


def answer_words(requests: DataFrame) -> DataFrame:
    """To each request the training counts of its words; and a row a shard
    (part null) with its distinct and all training words."""

    def one(table: pa.Table) -> pa.Table:
        keys, (words, counts) = asked(table)
        data = [squeeze(counts[np.searchsorted(words, k)]) for k in keys]
        n = len(data)
        return pa.table({
            "part": pa.array([*table["part"].to_pylist(), None], pa.int64()),
            "kind": pa.array([WORDS] * (n + 1), pa.int32()),
            "shard": pa.array([*table["shard"].to_pylist(), -1], pa.int32()),
            "data": pa.array([*data, None], pa.binary()),
            "n_distinct": pa.array([0] * n + [int((counts > 0).sum())], pa.int64()),
            "n_all": pa.array([0] * n + [int(counts.sum())], pa.int64())})

    return requests.groupBy("shard").applyInArrow(
        one, "part long, kind int, shard int, data binary, n_distinct long, n_all long")


class Lookup:
    """Values by key: a table of slots, and a search for what it cannot hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = U(64 - max(10, int(len(keys) * 4).bit_length()))
        self.slots = np.zeros(1 << int(64 - int(self.shift)), np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys):
        return (keys * U(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return np.zeros(0, self.values.dtype)
        at = self.slots[self._slot(wanted)]
        wrong = np.flatnonzero(self.keys[at] != wanted)
        at[wrong] = np.searchsorted(self.keys, wanted[wrong])
        return self.values[at]


def part_lookup(keys: np.ndarray, shard: np.ndarray, answers: dict[int, np.ndarray]) -> Lookup:
    """The part's keys with their answers; shards answered in key order."""
    order, _ = by_shard(keys, shard)
    kinds = [answers[s] for s in sorted(answers)]
    got = np.concatenate(kinds) if kinds else np.zeros(0)
    if len(got) != len(keys):
        raise ValueError(f"{len(keys)} keys asked, {len(got)} answered")
    values = np.empty(len(keys), got.dtype)
    values[order] = got
    return Lookup(keys, values)


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, bits_per_byte double")


def score_parts(texts: DataFrame, answers: DataFrame, n_shards: int, n_all: int, n_distinct: int,
                end_count: int) -> DataFrame:
    """Scores of every document of every part."""
    floor = n_all + 0.5 * (n_distinct + 1)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in left["data"]:
            table = pa.ipc.open_stream(
                zstandard.ZstdDecompressor().decompress(packed.as_py())).read_all()
            got = {RUNS: {}, WORDS: {}}
            for kind, shard, data in zip(right["kind"].to_pylist(), right["shard"].to_pylist(),
                                         right["data"].to_pylist(), strict=True):
                got[kind][shard] = (np.frombuffer(data, np.float64) if kind == RUNS
                                    else spread_out(data)[0].astype(np.int64))
            runs, words, none = [], [], np.zeros(0, U)
            for b in pieces(table.to_batches(), "text", CHUNK):
                buf, offsets = text_bytes(b.column("text"))
                runs += [np.unique(c) for c in run_keys(buf, offsets)[0]]
                words.append(np.unique(word_hashes(buf, offsets)[0]))
            runs, words = (np.unique(np.concatenate([*x, none])) for x in (runs, words))
            run_at = part_lookup(runs, shard_of(runs, n_shards), got[RUNS])
            word_at = part_lookup(words, word_shard(words, n_shards), got[WORDS])
            for b in pieces(table.to_batches(), "text", CHUNK):
                buf, offsets = text_bytes(b.column("text"))
                chunks, ends = run_keys(buf, offsets)
                score = np.zeros(b.num_rows)
                at = 0
                for keys in chunks:
                    value = run_at.get(keys).astype(float)
                    own = np.searchsorted(ends, np.arange(at, at + len(keys)), "right")
                    score += np.bincount(own, value, minlength=b.num_rows)
                    at += len(keys)
                h, counts = word_hashes(buf, offsets)
                c = word_at.get(h)
                own = np.repeat(np.arange(b.num_rows), counts)
                base = np.bincount(own, np.log10((c + 0.5) / floor), minlength=b.num_rows) \
                    + np.log10((end_count + 0.5) / floor)
                known = np.bincount(own, c > 0, minlength=b.num_rows).astype(np.int64) \
                    + (end_count > 0)
                size = np.diff(offsets)
                length = -score / np.log10(2) / np.maximum(size, 1)
                out.append(pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(counts + 1),
                     pa.array(known), pa.array(np.full(b.num_rows, n_all)), pa.array(base),
                     pa.array(np.round(score, 6)), pa.array(np.round(length, 6), mask=size == 0)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                     "score", "bits_per_byte"]))
        return pa.Table.from_batches(out)

    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(one, RESULT)


def score_texts(docs: DataFrame, held_out, part_bytes: int = PART) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text) for which the Column
    ``held_out`` is false, and score all.

    ``bits_per_byte`` is a text's code length, with its end, over its bytes
    (null for an empty text).  A null text is empty: it has the end token alone.
    Repeated rows train and are scored each; without training rows every
    decision is even (score: 8 bits a byte); an empty table gives an empty one."""
    n_shards = groups_for(docs, SHARD)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    parts = cut_lineage(pack_parts(rows, n_shards, part_bytes))
    runs = parts.filter(F.col("kind") == RUNS).select("kind", "part", "shard", "data")
    words = parts.filter(F.col("kind") == WORDS).select("kind", "part", "shard", "data")
    upper = upper_levels(grow(runs))
    counted = cut_lineage(answer_words(words))
    sums = counted.agg(F.sum("n_distinct"), F.sum("n_all")).first()
    trained = rows.filter(~F.col("held_out")).count()
    n_distinct, n_all = (sums[0] or 0) + (trained > 0), (sums[1] or 0) + trained
    answers = answer_runs(runs, upper).unionByName(
        counted.filter("part IS NOT NULL").drop("n_distinct", "n_all"))
    texts = parts.filter(F.col("kind") == TEXT).select("part", "data")
    return score_parts(texts, answers, n_shards, n_all, n_distinct, trained)


def lm_scores(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document, trained where crc32(doc_id) mod 5 is
    not 1 (a null id counts as the empty text)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
                                     .cast("binary")) % 5 == 1)
