"""Operator 11 against plain Python over the libraries' own ids."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from papersieve.llm import align
from papersieve.llm.bpe import byte_letters
from papersieve.llm.frames import read_table, take_columns

from . import edge

SMALL = "/root/testdata/sf0.001"
PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "a▁b", "<|endoftext|> and </s> <unk> <0x41>", "🙂🙂 \U0001fae8 x", "  two  spaces ",
       "tab\tand\nline\r\n", "\x00nul", "ÀÉ ﬁ ½ Ⅳ", "中文字符没有空格" * 40, "=" * 5000, "ab" * 3000,
       "İstanbul ß ΑΣ", "​᠎­", "é ẛ̣", "1234567890" * 50, "\U00010d50x"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def plain(text, a, b):
    """Groups of a text as lists of (A ids, B ids)."""
    letters = byte_letters()
    if not text:
        return []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = ["".join(map(letters.__getitem__, a.id_to_token(i))).encode("latin-1") for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
               else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
    ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        ni, nj = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((ids_a[i:ni], ids_b[j:nj]))
        i, j = ni, nj
    return out


def brute(rows, libraries):
    grouped = [(d, plain(t, *libraries)) for d, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in grouped]
    count = Counter(p for one in links for p in one)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (d, g), own in zip(grouped, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), own.total(),
                    sum(n for p, n in own.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                    r.groups_sha256) for r in df.collect()), key=str)


def test_query_equals_plain_python(spark, libraries):
    rows = [tuple(r) for r in read_table(spark, SMALL, "documents", "doc_id", "text").collect()]
    assert as_rows(align.alignment(spark, SMALL)) == brute(rows, libraries)


def test_odd_texts_and_edges(spark, libraries):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, ODD[3]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, libraries)
    for head in (align.HEAD, 7):  # 7: most pairs meet their counts in the join
        assert as_rows(align.alignments(docs, PATH_A, PATH_B, head)[0]) == want
    edges = edge.documents(spark)
    rows = [tuple(r) for r in take_columns(edges, "doc_id", "text").collect()]
    assert as_rows(align.alignments(edges, PATH_A, PATH_B)[0]) == brute(rows, libraries)
    none, pairs = align.alignments(edge.empty(spark), PATH_A, PATH_B)
    assert none.count() == 0 and pairs.count() == 0


def test_long_groups_in_parts(libraries, monkeypatch):
    own = align.aligner(PATH_A, PATH_B)
    texts = ["中文字符没有空格" * 200 + "x" * 700, "=-" * 900, "plain words here"]
    whole = align.measured(own, texts)
    monkeypatch.setattr(align, "LINKS", 50)
    parts = align.measured(own, texts)
    for x, y in zip(whole[2:], parts[2:], strict=True):
        assert x.tolist() == y.tolist()


def test_pair_table_counts_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "one")], "doc_id long, text string")
    _, pairs = align.alignments(docs, PATH_A, PATH_B)
    assert sorted(r.n for r in pairs.collect()) == [2, 3]
