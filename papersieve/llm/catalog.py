"""Registered queries of the training-data operators: name -> (query, SQL or
None where SQL cannot express it)."""

from __future__ import annotations

import corpus_pipeline

from .align import alignment
from .bpe_codec import bpe_codec
from .ctw import lm_scores
from .mixing import mixed
from .ngram_join import NGRAM_SQL, ngram_join
from .quality import quality_rules
from .secret_scan import secret_scan
from .sharding import sharding
from .simhash import simhash_dedup
from .token_counts import token_counts
from .toxicity import toxicity
from .turns import conversation_repair
from .vptree import NEAREST_SQL, nearest_vectors

REGISTRY = {
    "op1_secret_scan": (secret_scan, None),
    "op2_ngram_join": (ngram_join, NGRAM_SQL),
    "op3_token_counts": (token_counts, None),
    "op4_toxicity": (toxicity, None),
    "op5_mixing": (mixed, None),
    "op6_bpe_codec": (bpe_codec, None),
    "op7_lm_scores": (lm_scores, None),
    "op8_nearest": (nearest_vectors, NEAREST_SQL),
    "op9_quality_rules": (quality_rules, None),
    "op10_sharding": (sharding, None),
    "op11_alignment": (alignment, None),
    "op12_conversation_repair": (conversation_repair, None),
    "op13_simhash": (simhash_dedup, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
