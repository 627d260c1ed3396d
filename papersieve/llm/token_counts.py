"""Operator 3, token counts by prefix dynamic programming.

For each word that the tokenizer's pattern finds, a dynamic programme stores
the exact token count of every prefix of its bytes.  A text's counts are sums
over words, and the count at a cut inside a word is read from the word's
table: truncation and budget questions need no second encoding.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .bpe import Memo, Vocabulary, vocabulary
from .frames import pieces, read_table, take_columns

LIMIT = 512


class Counter:
    """Token counts of texts under a byte-level BPE file."""

    def __init__(self, vocab: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.vocab = vocab
        self.find = regex.compile(pattern).findall
        self.words = Memo(lambda w: vocab.count(w.encode()))
        self.specials = (regex.compile("|".join(map(regex.escape, sorted(
            vocab.special, key=len, reverse=True)))) if vocab.special else None)

    def parts(self, text: str):
        """(words, whether they are one special token) along the text."""
        at = 0
        if self.specials is not None:
            for m in self.specials.finditer(text):
                if m.start() > at:
                    yield self.find(text[at:m.start()]), False
                yield [m.group()], True
                at = m.end()
        if at < len(text):
            yield self.find(text[at:] if at else text), False

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """(token count, UTF-8 bytes of the longest prefix of the text, cut
        between characters, whose tokens of this encoding are at most
        ``limit``)."""
        total, fits, over = 0, 0, False
        known = self.words.__getitem__
        for words, special in self.parts(text):
            counts = [1] * len(words) if special else list(map(known, words))
            part = sum(counts)
            if not over and total + part > limit:
                over = True
                fits += self._fit(words, counts, limit - total, special)
            elif not over:
                fits += len("".join(words).encode())
            total += part
        return total, fits

    def _fit(self, words, counts, room, special) -> int:
        used = bytes_in = 0
        for word, n in zip(words, counts, strict=True):
            data = word.encode()
            if used + n > room:
                if special:
                    return bytes_in
                table = self.vocab.prefix_counts(data)
                cuts = [i for i in range(len(data)) if (data[i] & 0xC0) != 0x80
                        and used + table[i] <= room]
                return bytes_in + max(cuts, default=0)
            used += n
            bytes_in += len(data)
        return bytes_in

    def prefix_table(self, text: str) -> np.ndarray:
        """Token count of every byte prefix, as the words of the whole text
        are cut there: prefix i counts all words before byte i and the prefix
        of the word around it."""
        out, total = [0], 0
        for words, special in self.parts(text):
            for w in words:
                data = w.encode()
                table = ([0] + [1] * len(data)) if special else self.vocab.prefix_counts(data)
                out.extend(total + n for n in table[1:])
                total += table[-1]
        return np.array(out, np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes (bytes of the longest
    prefix within ``limit`` tokens) of every row.

    A null or empty text has no bytes and no tokens; repeated rows are counted
    each; no shuffle, a lost executor's rows are counted again elsewhere."""

    def rows(batches):
        measure = counter(path).measure
        for b in pieces(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = [measure(t, limit) for t in texts]
            n = np.array([x for x, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n), pa.array(n > limit), pa.array([x for _, x in found], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    return take_columns(docs, "doc_id", "text").mapInArrow(
        rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token count at every byte prefix of its text."""

    def rows(batches):
        table = counter(path).prefix_table
        for b in pieces(batches, "text"):
            for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(),
                            strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([table(t or "")], pa.list_(pa.int64()))],
                    ["doc_id", "prefix_tokens"])

    return take_columns(docs, "doc_id", "text").mapInArrow(
        rows, "doc_id long, prefix_tokens array<long>")


def budget_documents(counts: DataFrame, budget: int) -> DataFrame:
    """Rows whose whole text fits ``budget`` tokens."""
    return counts.filter(counts["n_tokens"] <= budget)


def token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: byte_bpe_50k.json counts of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                        public_tokenizers.path("byte_bpe_50k.json"))
