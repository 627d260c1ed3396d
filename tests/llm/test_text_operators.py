"""Operators that handle each text by itself: 3, 6, 9, 4."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from papersieve.llm import bpe, bpe_codec, quality, token_counts, toxicity
from papersieve.llm.frames import read_table

from . import edge

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = read_table(spark, SMALL, "documents", "doc_id", "text").collect()
    odd = ["", " ", "\n\n  a", "it's 'LL we'LL", "<|endoftext|>x<|startoftext|> <|endoftext|>",
           "á İ ΑΣ σς \x1c\x85 b 　", "0x1F 12345", "🙂🙂", "\U00010d50 \U000107bb",
           "zzzz" * 3000]
    return {r[0]: r[1] or "" for r in rows} | {10**6 + i: t for i, t in enumerate(odd)}


def test_token_counts_equal_library(texts):
    lib = Tokenizer.from_file(BYTE)
    own = token_counts.counter(BYTE)
    for t in texts.values():
        ids = lib.encode(t, add_special_tokens=False)
        n, cut = own.measure(t, 64)
        assert n == len(ids.ids)
        if n <= 64:
            assert cut == len(t.encode())


def test_every_prefix_of_a_word_is_exact():
    lib, own = Tokenizer.from_file(BYTE), bpe.vocabulary(BYTE)
    for word in ("internationalization", " unbelievable", "aaaaaaaaab", "xyzzyplugh", "!!!???"):
        counts = own.prefix_counts(word.encode())
        for i in range(1, len(word) + 1):
            assert counts[i] == len(lib.encode(word[:i], add_special_tokens=False).ids)


def test_budget_cut_is_the_longest_prefix():
    own = token_counts.counter(BYTE)
    text = "An unbelievable internationalization of words"
    table = own.prefix_table(text)
    for limit in (1, 3, 5):
        _, cut = own.measure(text, limit)
        assert table[cut] <= limit and (cut == len(text) or table[cut + 1] > limit)


def test_count_tokens_edges(spark):
    rows = token_counts.count_tokens(edge.documents(spark), BYTE).collect()
    assert len(rows) == len(edge.ROWS)
    for r in rows:
        assert r.over_limit == (r.n_tokens > 512) and r.limit_bytes <= r.n_bytes
    assert sorted((r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (3, 4)) == [(0, 0), (0, 0)]
    assert token_counts.count_tokens(edge.empty(spark), BYTE).count() == 0


def test_codec_equals_library(texts):
    lib, own = Tokenizer.from_file(WORD), bpe_codec.codec(WORD)
    for t in texts.values():
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got.tolist() == want
        assert own.decode(got).decode() == lib.decode(want, skip_special_tokens=False)


def test_codec_query_and_edges(spark):
    docs = edge.documents(spark)
    lib = Tokenizer.from_file(WORD)
    want = sorted((r[0] is None, r[0] or 0, len(i),
                   hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256(lib.decode(i, skip_special_tokens=False).encode()).hexdigest())
                  for r in edge.ROWS
                  for i in [lib.encode(r[1] or "", add_special_tokens=False).ids])
    got = bpe_codec.encode_decode_digests(docs, WORD).collect()
    assert want == sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got)
    coded = bpe_codec.decode_ids(bpe_codec.encode_texts(docs, WORD), WORD).collect()
    assert len(coded) == len(edge.ROWS)
    assert all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in coded)
    assert bpe_codec.encode_texts(edge.empty(spark), WORD).count() == 0


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) for j in range(3)
              if windows[tuple(words[i:i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside), failed)


def test_quality_base_and_verdict(spark):
    docs = read_table(spark, SMALL, "documents", "doc_id", "text")
    labels = read_table(spark, SMALL, "labels", "doc_id", "quality")
    text = dict(docs.collect())
    good = dict(labels.collect())
    rows = quality.fitted_quality(docs, labels).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == base_by_hand(text[r.doc_id])
        if not r.base_failed and r.doc_id in good:
            assert r.kept == bool(good[r.doc_id])


def test_quality_scores_by_hand():
    rng = np.random.default_rng(0)
    ratio = np.round(rng.normal(size=quality.BUCKETS) * 2**20) / 2**20
    raw = ["abc", "", "é", "hello world", "xx"]
    data = [t.encode() for t in raw]
    buf = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    got = quality.ngram_scores(buf, offsets, ratio)
    for d, score in zip(data, got, strict=True):
        values = []
        for w in quality.WIDTHS:
            for i in range(len(d) - w + 1):
                h = 0
                for b in d[i:i + w]:
                    h = (h * 257 + b) % 2**32
                values.append(ratio[((h + w) * 2654435769 % 2**32) >> 16])
        assert score == pytest.approx(sum(values) / len(values) if values else 0, abs=1e-8)


def test_quality_edges(spark):
    rows = quality.fitted_quality(edge.documents(spark), edge.labels(spark)).collect()
    assert len(rows) == len(edge.ROWS)
    assert all(r.kept == (not r.base_failed) for r in rows)  # nothing trusted: base rules alone
    trusted = edge.labels(spark, [(0, 1, 0), (3, None, None), (None, 1, 1)])
    assert quality.fitted_quality(edge.empty(spark), trusted).count() == 0
    kept = quality.passing(edge.documents(spark), trusted)
    verdicts = quality.fitted_quality(edge.documents(spark), trusted)
    assert kept.columns == edge.documents(spark).columns
    assert kept.count() == verdicts.filter("kept").count()


def test_toxicity_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.toxicity(spark, d).toPandas()
    known = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    both = rows.merge(known, on="doc_id")
    both = both[both.held_out]
    yes, no = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    auc = (yes[:, None] > no).mean() + 0.5 * (yes[:, None] == no).mean()
    assert len(rows) == 10000 and auc > 0.93
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    x = (rng.random((4000, 6)) < np.where(y[:, None], 0.7, 0.2)).astype(np.float32)
    w, b = toxicity.nnpu_fit(x[y][:300], x[300:], 0.2)
    assert (((x @ w + b) > 0) == y).mean() > 0.9


def test_toxicity_edges(spark):
    docs = edge.documents(spark)
    weight, bias = toxicity.fit_toxicity(docs, edge.labels(spark))
    rows = toxicity.score_toxicity(docs, weight, bias).collect()
    assert len(rows) == len(edge.ROWS) and {r.predicted for r in rows} == {0}
    some = edge.labels(spark, [(i, 1, int(i == 13)) for i in range(14)] + [(None, None, 1)])
    weight, bias = toxicity.fit_toxicity(docs, some)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, weight, bias).collect())
    assert toxicity.score_toxicity(edge.empty(spark), weight, bias).count() == 0
    weight, bias = toxicity.fit_toxicity(edge.empty(spark), some)
    assert not weight.any()


def test_toxic_copies_leave_other_toxic_words(spark):
    """A third of the positives are copies of one text of 1,500 words; words of
    the other toxic texts, more than 512, keep their weight."""
    rng = np.random.default_rng(6)
    long = " ".join(f"c{i}" for i in range(1500))
    rows, toxic = [], []
    for i in range(3000):
        kind = "copy" if i % 30 == 0 else "bad" if i % 30 in (1, 2) else "clean"
        own = " ".join(f"w{j}" for j in rng.integers(0, 400, 20))
        bad = " ".join(f"bad{j}" for j in rng.choice(700, 60, replace=False))
        rows.append((i, {"copy": long, "bad": own + " " + bad, "clean": own}[kind]))
        toxic.append((i, 0, int(kind != "clean")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weight, bias = toxicity.fit_toxicity(docs, edge.labels(spark, toxic))
    assert np.count_nonzero(weight) > 600
    fresh = spark.createDataFrame([(i, f"w1 w2 bad{i} bad{i + 100} bad{i + 200} bad{i + 300} bad{i + 400} bad{i + 500}")
                                   for i in range(100)] + [(1000, "w1 w2 w3 w4")],
                                  "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(fresh, weight, bias).collect()}
    clean = got.pop(1000)
    assert clean < 0.5 and min(got.values()) > clean


def test_toxicity_scores_equal_plain_python(spark):
    """Scores of given weights, word by word."""
    import math

    import pyarrow as pa
    docs = read_table(spark, SMALL, "documents", "doc_id", "text")
    rng = np.random.default_rng(1)
    weight = np.where(rng.random(1 << toxicity.BUCKET_BITS) < .3,
                      rng.normal(0, 2, 1 << toxicity.BUCKET_BITS), 0).astype(np.float32)
    bucket = {}

    def of(word):
        if word not in bucket:
            bucket[word] = int(toxicity.word_buckets(pa.array([word]))[1][0])
        return bucket[word]

    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, weight, -1.5).collect()}
    for r in docs.collect():
        low = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        words = {of(w) for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", low)}
        z = -1.5 + sum(float(weight[b]) for b in words)
        want = 1 / (1 + math.exp(-max(-500, min(500, z))))
        assert abs(got[r.doc_id][0] - want) < 1e-6
        assert got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.5)


def test_nnpu_fit_equals_plain_python():
    """The corrected risk and its steps, written out for single numbers."""
    import math
    rng = np.random.default_rng(3)
    xp, xu = (rng.random((n, 3)) < p for n, p in ((12, .7), (20, .3)))
    xp, xu, prior, steps = xp.astype(float), xu.astype(float), 0.2, 40
    w, m, v = [0.0] * 4, [0.0] * 4, [0.0] * 4  # the last one is the bias
    w[3] = math.log(prior / (1 - prior))

    def score(x):
        return sum(a * b for a, b in zip(x, w)) + w[3]

    for t in range(1, steps + 1):
        clean = sum(math.log1p(math.exp(score(x))) for x in xu) / len(xu) \
            - prior * sum(math.log1p(math.exp(score(x))) for x in xp) / len(xp)

        def slope(rows, of, i):
            return sum(of(1 / (1 + math.exp(-score(x)))) * (x[i] if i < 3 else 1) for x in rows) / len(rows)
        g = []
        for i in range(4):
            g_clean = slope(xu, lambda s: s, i) - prior * slope(xp, lambda s: s, i)
            own = prior * slope(xp, lambda s: s - 1, i) + g_clean if clean >= 0 else -g_clean
            g.append(own + (toxicity.RIDGE * w[i] if i < 3 else 0))
        for i in range(4):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] -= toxicity.RATE * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    got, bias = toxicity.nnpu_fit(xp, xu, prior, steps)
    assert np.allclose([*got, bias], w, atol=1e-9)
