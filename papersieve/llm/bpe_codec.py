"""Operator 6, BPE encoding and decoding.

Encoding backtracks over Aho-Corasick matches checked against the pair table
(:meth:`bpe.Vocabulary.encode`); decoding gathers from an offset table
(:class:`bpe.Offsets`).  Each distinct word is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe import Memo, Offsets, Vocabulary, byte_letters, vocabulary
from .frames import give_back, pieces, read_table, take_columns

#: Fixed value: how the word vocabulary's file splits a normalised text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def unassigned() -> np.ndarray:
    """Whether Python's Unicode tables lack a code point.  The tables of
    Python, regex and tokenizers differ in age and so differ there."""
    return np.array([unicodedata.category(chr(i)) == "Cn"
                     for i in range(sys.maxunicode + 1)])


class Codec:
    """Encoder and decoder of one word-suffix BPE file (NFC, lower case,
    white space dropped)."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.offsets = Offsets(vocab)
        self.find = regex.compile(WORDS).findall
        self.whole = None
        # ids of a word as the bytes of 32-bit numbers
        self.words = Memo(lambda w: array("i", vocab.encode(w.encode())).tobytes())
        self.specials = (regex.compile("|".join(map(regex.escape, sorted(
            vocab.special, key=len, reverse=True)))) if vocab.special else None)

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if unassigned()[points].any():
                return self._split_by_file(text)
            # lower-casing is letter by letter: no final sigma rule
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def _split_by_file(self, text: str) -> list[str]:
        """The same with the file's own normaliser and splitter, for texts
        with code points newer than Python's tables."""
        if self.whole is None:
            self.whole = Tokenizer.from_file(self.vocab.path)
        letters = byte_letters()
        return ["".join(map(letters.__getitem__, w)).encode("latin-1").decode()
                for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(
                    self.whole.normalizer.normalize_str(text))]

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens become those tokens."""
        out, at = [], 0
        if self.specials is not None:
            for m in self.specials.finditer(text):
                out.append(self._words(text[at:m.start()]))
                out.append(array("i", [self.vocab.special[m.group()]]).tobytes())
                at = m.end()
        out.append(self._words(text[at:] if at else text))
        return np.frombuffer(b"".join(out), np.intc)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: token names joined by one space, as a
        file without a decoder gives them."""
        return self.offsets.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(vocabulary(path))
    return _codecs[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` of every row.  A null or empty text has no ids;
    repeated rows are encoded each; no shuffle."""

    def rows(batches):
        encode = codec(path).encode
        for b in pieces(batches, "text"):
            found = [encode(t or "") for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return take_columns(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of :func:`encode_texts` with ``decoded``; null ids give ''."""

    def rows(batches):
        decode = codec(path).decode
        for b in batches:
            ids = b.column("ids")
            texts = [decode(np.asarray(x.values, np.int64)).decode() if x.is_valid else ""
                     for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), ids, pa.array(texts, pa.string())],
                ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


def encode_decode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` and ``decoded`` of every row in one pass, as
    :func:`encode_texts` and :func:`decode_ids` give them."""

    def rows(batches):
        own = codec(path)
        for b in pieces(batches, "text"):
            found = [own.encode(t or "") for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))
            texts = pa.array([own.decode(x) for x in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, texts],
                                             ["doc_id", "ids", "decoded"])
        own.words.forget()
        give_back()

    return take_columns(docs, "doc_id", "text").mapInArrow(
        rows, "doc_id long, ids array<int>, decoded string")


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode and digest in one pass over the rows."""

    def rows(batches):
        own = codec(path)
        for b in pieces(batches, "text"):
            out = []
            for t in b.column("text").to_pylist():
                ids = own.encode(t or "")
                out.append((len(ids),
                            hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest(),
                            hashlib.sha256(own.decode(ids)).hexdigest()))
            n, i, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i), pa.array(d)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return take_columns(docs, "doc_id", "text").mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Contract query: word_bpe_49k.json over every document."""
    return encode_decode_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                 public_tokenizers.path("word_bpe_49k.json"))
