"""Operator 11, cross-tokenizer alignment over distinct texts.

Texts are shuffled whole, so each distinct text is tokenised and aligned once,
by both tokenizers; its pair counts are weighted by how many documents hold it,
and its measures are joined back to their doc_ids by the text's SHA-256.

A text's tokens are cut into groups where a token of either side ends at the
same byte.  Distinct linked pairs are kept packed, one row for a run of texts;
counting adds them up inside a task before anything is shuffled.  The counts of
the HEAD most frequent pairs are told to the tasks (a fixed bound); the other
pairs of a text meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..config import cut_lineage
from .bpe import vocabulary
from .frames import pieces, read_table, take_columns

#: Pairs whose counts are told to every task (17 bytes each).
HEAD = 200_000
#: Linked token pairs written out at once, and distinct ones gathered in a
#: task before they are added up.
LINKS = 1 << 21
SPACE = "▁"


@lru_cache(1)
def steady() -> np.ndarray:
    """Whether a code point has been of one kind since Unicode 3.2, so that
    libraries with tables of any age split texts of it alike."""
    old = unicodedata.ucd_3_2_0.category
    return np.array([(kind := unicodedata.category(c)) != "Cn" and kind == old(c)
                     for c in map(chr, range(0x110000))])


class ByteLevel:
    """Ids and token bytes of a byte-level BPE file; strings of special tokens
    are plain text.  Texts of long-known characters go through tiktoken, which
    needs a quarter of the time; it is used where ids are merge orders."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocab = vocabulary(path)
        ranks = {text.encode("latin-1"): i for text, i in vocab.token.items()}
        self.bytes = [b""] * (max(vocab.names) + 1)
        for text, i in ranks.items():
            self.bytes[i] = text
        made = [vocab.rank[i] for i in sorted(ranks.values())]
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={}) if made == sorted(made) else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            plain = t.isascii() or steady()[np.frombuffer(
                t.encode("utf-32-le", "surrogatepass"), np.uint32)].all()
            out.append(self.fast.encode_ordinary(" " + t) if self.fast and plain else
                       self.whole.encode(" " + t, add_special_tokens=False).ids)
        return out


class Pieces:
    """Ids and token bytes of a sentencepiece file, which adds the space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.replace(SPACE, " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Written:
    """Decimal ids with each sign that can follow one, in one buffer."""

    def __init__(self, size: int, between: str, last: str):
        names = [f"{i}{sign}".encode() for sign in (between, last) for i in range(size)]
        self.size, self.start = size, np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.buffer = np.frombuffer(b"".join(names), np.uint8)


class Aligner:
    """Both tokenizers of one pair of files, and their tables."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.len_a = np.array([len(x) for x in self.a.bytes])
        self.len_b = np.array([len(x) for x in self.b.bytes])
        self.size_b = len(self.len_b)
        a, b = Written(len(self.len_a), ",", "|"), Written(self.size_b, ",", ";")
        self.names = (a, b)
        self.buffer = np.concatenate([a.buffer, b.buffer])
        self.start = np.concatenate([a.start, b.start[1:] + a.start[-1]])

    def tokens(self, texts: list[str]):
        """Id lists of both sides; none for a text that either changes."""
        out = []
        for t, a, b in zip(texts, self.a.ids(texts), self.b.ids(texts), strict=True):
            want = (" " + t).encode()
            good = t and b"".join(map(self.a.bytes.__getitem__, a)) == want \
                and b"".join(map(self.b.bytes.__getitem__, b)) == want
            out.append((a, b) if good else ([], []))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray):
        """The group of each token of either side, and the bytes at which
        groups end."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return np.searchsorted(both, ends_a), np.searchsorted(both, ends_b), both

    def written(self, a, b, group_a, group_b, n: int) -> np.ndarray:
        """Bytes of ``a1,a2|b1;a3|b2,b3;`` and where each group's begin."""
        p, q = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        last_a, last_b = np.cumsum(p) - 1, np.cumsum(q) - 1
        name = np.empty(len(a) + len(b), np.int64)
        code_a, code_b = a.copy(), b + 2 * self.names[0].size
        code_a[last_a] += self.names[0].size
        code_b[last_b] += self.size_b
        name[np.arange(len(a)) + (last_b - q + 1)[group_a]] = code_a
        name[np.arange(len(b)) + (last_a + 1)[group_b]] = code_b
        begin, size = self.start[name], self.start[name + 1] - self.start[name]
        to = np.cumsum(size)
        at = np.arange(to[-1]) + np.repeat(begin - (to - size), size)
        return self.buffer[at], np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(p + q)])]

    def pairs(self, a, b, group_a, group_b, text_of_group):
        """(text << 40 | pair code, occurrences) of the distinct linked pairs."""
        n = len(text_of_group)
        q = np.bincount(group_b, minlength=n)
        times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        if q[group_a].sum() > LINKS:  # equal tokens of a group are one
            group_a, a, times_a = counted(group_a, a)
            group_b, b, times_b = counted(group_b, b)
            q = np.bincount(group_b, minlength=n)
        begin, each = np.cumsum(q) - q, q[group_a]
        upto = np.cumsum(each)
        found, held, at = [], 0, 0
        while at < len(a):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + LINKS, "right")))
            own = each[at:to]
            other = np.arange(own.sum()) + np.repeat(begin[group_a[at:to]] - (np.cumsum(own) - own), own)
            key = (text_of_group[np.repeat(group_a[at:to], own)] << 40) \
                | (np.repeat(a[at:to], own) * self.size_b + b[other])
            found.append(added(key, np.repeat(times_a[at:to], own) * times_b[other]))
            held += len(found[-1][0])
            if held > LINKS:
                found = [added(*map(np.concatenate, zip(*found, strict=True)))]
                held = 0
            at = to
        return added(*map(np.concatenate, zip(*found, strict=True)))


def counted(group: np.ndarray, ids: np.ndarray):
    key, n = np.unique(group << 20 | ids, return_counts=True)
    return key >> 20, key & (1 << 20) - 1, n


def added(keys: np.ndarray, n: np.ndarray):
    """Each key once, in order, its numbers added."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


MEASURES = ("n_a", "n_b", "n_groups", "n_links")
PACKED = ("keys array<binary>, copies array<long>, " + ", ".join(f"{m} array<long>" for m in MEASURES)
          + ", digests array<string>, texts array<int>, codes binary, times binary")


def measured(own: Aligner, texts: list[str]):
    """Of each text: MEASURES and the digest; of all together: text, pair code
    and occurrences of the distinct linked pairs."""
    tokens = own.tokens(texts)
    n_a, n_b = (np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1))
    zero = np.zeros(len(texts), np.int64)
    a, b = (np.concatenate([np.array(t[side], np.int64) for t in tokens]) for side in (0, 1))
    none = np.zeros(0, np.int64)
    if not len(a):
        return (n_a, n_b, zero, zero), [""] * len(texts), none, none, none
    group_a, group_b, both = own.groups(a, b)
    upto = np.cumsum(n_a)
    text_of_a = np.repeat(np.arange(len(texts)), n_a)
    text_of = np.zeros(len(both), np.int64)
    text_of[group_a] = text_of_a
    p, q = np.bincount(group_a), np.bincount(group_b)
    n_groups = np.bincount(text_of, minlength=len(texts))
    n_links = zero.copy()
    np.add.at(n_links, text_of, p * q)
    written, at = own.written(a, b, group_a, group_b, len(both))
    group_at = np.concatenate([[0], np.cumsum(n_groups)])
    digests = [hashlib.sha256(written[at[group_at[i]]:at[group_at[i + 1]] - 1].tobytes()).hexdigest()
               if n_a[i] else "" for i in range(len(texts))]
    key, times = own.pairs(a, b, group_a, group_b, text_of)
    return (n_a, n_b, n_groups, n_links), digests, key >> 40, key & (1 << 40) - 1, times


def align_distinct(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``texts`` (text, key, copies) as PACKED rows, each a run of texts."""

    def rows(batches):
        own = aligner(path_a, path_b)
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in pieces(batches, "text"):
            values, digests, text, code, times = measured(own, b.column("text").to_pylist())
            row = {"keys": b.column("key").to_pylist(), "copies": b.column("copies").to_pylist(),
                   **{m: v.tolist() for m, v in zip(MEASURES, values, strict=True)}, "digests": digests,
                   "texts": np.bincount(text, minlength=b.num_rows).tolist(),
                   "codes": pack(np.diff(code, prepend=0).astype(np.int64).tobytes()),
                   "times": pack(times.astype(np.uint32).tobytes())}
            yield pa.RecordBatch.from_pylist([row], schema=_packed_schema())

    return texts.select("text", "key", "copies").mapInArrow(rows, PACKED)


def _packed_schema() -> pa.Schema:
    kinds = {"keys": pa.list_(pa.binary()), "digests": pa.list_(pa.string()),
             "texts": pa.list_(pa.int32()), "codes": pa.binary(), "times": pa.binary()}
    return pa.schema([(name, kinds.get(name, pa.list_(pa.int64()))) for name in
                      ("keys", "copies", *MEASURES, "digests", "texts", "codes", "times")])


def unpacked(row):
    """(text, pair code, occurrences) of a PACKED row."""
    unpack = zstandard.ZstdDecompressor().decompress
    return (np.repeat(np.arange(len(row["texts"])), row["texts"]),
            np.cumsum(np.frombuffer(unpack(row["codes"]), np.int64)),
            np.frombuffer(unpack(row["times"]), np.uint32).astype(np.int64))


def pair_counts(packed: DataFrame) -> DataFrame:
    """code, n: in how many documents each pair is linked."""

    def rows(batches):
        held, size = [], 0
        for b in batches:
            for row in b.select(["texts", "copies", "codes", "times"]).to_pylist():
                text, code, _ = unpacked(row)
                if not len(code):
                    continue
                held.append(added(code, np.array(row["copies"], np.int64)[text]))
                size += len(held[-1][0])
                if size > LINKS:
                    held = [added(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > LINKS // 2:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["code", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(
                list(map(pa.array, added(*map(np.concatenate, zip(*held, strict=True))))), ["code", "n"])

    return packed.select("texts", "copies", "codes", "times").mapInArrow(
        rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def ranked_pairs(counts: DataFrame, size_b: int) -> DataFrame:
    """``counts`` and whether each pair is the most frequent of its A id."""
    with_a = counts.withColumn("a", F.expr(f"code div {size_b}"))
    most = with_a.groupBy("a").agg(F.max("n").alias("most"))
    return (with_a.join(F.broadcast(most), "a")  # at most one row an id of the vocabulary
            .select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def text_measures(packed: DataFrame, ranked: DataFrame, head: int = HEAD) -> DataFrame:
    """key, MEASURES, groups_sha256, n_best, count_sum of each distinct text."""
    told = ranked.orderBy(F.desc("n"), "code").limit(head).toArrow()
    order = np.argsort(told["code"].to_numpy())
    codes, n, best = (told[c].to_numpy()[order] for c in ("code", "n", "best"))
    struct = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))

    def rows(batches):
        for b in batches:
            for row in b.to_pylist():
                text, code, times = unpacked(row)
                size = len(row["keys"])
                sums, bests, rest = np.zeros(size, np.int64), np.zeros(size, np.int64), [[]] * size
                if len(code):
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    known = codes[at] == code
                    np.add.at(sums, text[known], (times * n[at])[known])
                    np.add.at(bests, text[known], (times * best[at])[known])
                    if not known.all():
                        rest = [[] for _ in range(size)]
                        for t, c, k in zip(text[~known].tolist(), code[~known].tolist(),
                                           times[~known].tolist(), strict=True):
                            rest[t].append({"code": c, "times": k})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.binary()), *[pa.array(row[m], pa.int64()) for m in MEASURES],
                     pa.array(row["digests"], pa.string()), pa.array(bests), pa.array(sums),
                     pa.array(rest, struct)],
                    ["key", *MEASURES, "groups_sha256", "n_best", "count_sum", "rest"])

    known = packed.mapInArrow(rows, "key binary, " + ", ".join(f"{m} long" for m in MEASURES)
                              + ", groups_sha256 string, n_best long, count_sum long, "
                                "rest array<struct<code:long,times:long>>")
    if len(codes) < head:  # every pair was told
        return known.drop("rest")
    more = (known.select("key", F.explode("rest").alias("r")).select("key", "r.code", "r.times")
            .join(ranked, "code").groupBy("key")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
                 F.sum(F.col("times") * F.col("n")).alias("_sum")))
    return (known.drop("rest").join(more, "key", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
            .drop("_best", "_sum"))


def alignments(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD):
    """(one row a document: doc_id, MEASURES, n_best, count_sum, groups_sha256;
    the corpus table of pairs: code (A id times B's vocabulary size plus B id),
    n, best).

    Null and empty texts, and texts that either tokenizer changes, have no
    tokens: zeros and ''.  Rows of equal texts have equal measures and count
    each; ties for an A id's highest count are all best.  Long texts are
    aligned whole; groups of many tokens are counted by distinct ids."""
    docs = take_columns(docs, "doc_id", "text")
    some = F.col("text").isNotNull() & (F.col("text") != "")
    texts = (docs.filter(some).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
             .withColumn("key", F.unhex(F.sha2("text", 256))))
    packed = cut_lineage(align_distinct(texts, path_a, path_b))
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    ranked = cut_lineage(ranked_pairs(pair_counts(packed), size_b))
    measures = text_measures(packed, ranked, head)
    own = docs.select("doc_id", F.when(some, F.unhex(F.sha2("text", 256))).alias("key"))
    whole = own.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c)
                    for c in (*MEASURES, "n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return whole, ranked


def alignment(spark, sf_dir: str) -> DataFrame:
    """Contract query: byte_bpe_50k.json against piece_bpe_32k.model."""
    return alignments(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                      public_tokenizers.path("byte_bpe_50k.json"),
                      public_tokenizers.path("piece_bpe_32k.model"))[0]
