"""Text cleaning: HTML to text and ASCII folding.

Markup is removed by native expressions.  Character references and the ASCII
fold are the one place where Python runs per batch: Spark has neither the
standard's table of references nor a Unicode normaliser, so one Arrow-batched
UDF decodes the texts that hold an ampersand and calls pyarrow's vectorised
NFKD.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import give_back

#: Bytes of a batch of texts after which its memory is given back at once.
LARGE_BATCH = 1 << 20

# Markup removed before tags, to its end or that of the text; the references that
# the SQL twin decodes (FIXED VALUES: those of the test tables; ``&amp;`` last).
# A quoted attribute value may hold '>'; groups are possessive, so that long
# tags are matched without recursion (RE2, which has none, reads the plain ones).
_INSIDE = r"""(?:[^>=]{P}|=\s*{P}"[^"]*{P}"|=\s*{P}'[^']*{P}'|=)*{P}>"""
_DROP_BLOCKS = [
    r"(?s)<!--.*?(?:-->|\z)",
    r"(?is)<script\b{IN}.*?(?:</script\s*>|\z)",
    r"(?is)<style\b{IN}.*?(?:</style\s*>|\z)",
    r"(?is)<template\b{IN}.*?(?:</template\s*>|\z)",
]
# a tag needs '<' followed by a letter, '/', '!' or '?', so "p < 0.05" survives
_TAG = r"<[A-Za-z/!?]{IN}"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
             ("&middot;", "·"), ("&amp;", "&")]
_NON_ASCII = r"[^\x00-\x7F]"


def _pattern(pattern: str, possessive: bool) -> str:
    inside = _INSIDE.replace("[^>=]{P}", "[^>=]++" if possessive else "[^>=]")
    return pattern.replace("{IN}", inside.replace("{P}", "+" if possessive else ""))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_text(col) -> Column:
    """A missing title or abstract is the empty string."""
    return F.coalesce(_c(col), F.lit(""))


def _unescape_array(arr: pa.Array) -> pa.Array:
    """Numeric and named character references to characters in one pass (what
    decoding makes is not decoded again), as the HTML standard reads them: the
    longest name also without its semicolon; unknown names stay."""
    some = pc.fill_null(pc.match_substring(arr, "&"), False)
    if not pc.any(some).as_py():
        return arr
    decoded = pa.array([unescape(t) for t in pc.filter(arr, some).to_pylist()], arr.type)
    return pc.replace_with_mask(arr, some, decoded)


@F.arrow_udf(T.StringType())
def _unescape_udf(s: pa.Array) -> pa.Array:
    return _unescape_array(s)


def decode_references(col) -> Column:
    """Character references decoded (Arrow batch UDF)."""
    return _unescape_udf(_c(col))


def strip_markup(col) -> Column:
    """Comments, script/style/template blocks and tags dropped: native."""
    out = _c(col)
    for pat in [*_DROP_BLOCKS, _TAG]:
        out = F.regexp_replace(out, _pattern(pat, True), "")
    return out


def html_to_text(col) -> Column:
    """markup dropped, character references decoded."""
    return decode_references(strip_markup(col))


def html_title(col) -> Column:
    """Content of the first ``<title>`` element ('' when absent)."""
    return F.regexp_extract(_c(col), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)


def _fold_array(arr: pa.Array) -> pa.Array:
    norm = pc.utf8_normalize(arr, form="NFKD")
    return pc.replace_substring_regex(norm, pattern=_NON_ASCII, replacement="")


@F.arrow_udf(T.StringType())
def _ascii_fold_udf(s: pa.Array) -> pa.Array:
    return _fold_array(s)


def ascii_fold(col) -> Column:
    """NFKD then drop every non-ASCII character (Arrow batch UDF)."""
    return _ascii_fold_udf(_c(col))


@F.arrow_udf(T.StringType())
def _unescape_fold_udf(s: pa.Array) -> pa.Array:
    out = _fold_array(_unescape_array(s))
    if s.nbytes > LARGE_BATCH:
        give_back()
    return out


def clean_text(col) -> Column:
    """Screening text: null to '', HTML to text, then ASCII fold (one batch
    function for both of its halves)."""
    return _unescape_fold_udf(strip_markup(null_text(col)))


# ---- SQL (DuckDB) twins used by the oracle -------------------------------

def sql_html_to_text(expr: str) -> str:
    out = expr
    for pat in [*_DROP_BLOCKS, _TAG]:
        sql = _pattern(pat, False).replace("'", "''")
        out = f"regexp_replace({out}, '{sql}', '', 'g')"
    for ent, rep in _ENTITIES:
        rep_sql = rep.replace("'", "''")
        out = f"replace({out}, '{ent}', '{rep_sql}')"
    return out


def sql_ascii_fold(expr: str) -> str:
    return f"regexp_replace(strip_accents({expr}), '{_NON_ASCII}', '', 'g')"


def sql_clean_text(expr: str) -> str:
    return sql_ascii_fold(sql_html_to_text(f"coalesce({expr}, '')"))
