"""A byte-pair vocabulary as tables: token strings, the merge each came from,
and when two tokens may stand side by side.

Token strings are written one character a byte (latin-1), with one extra
character END for a vocabulary whose words end in a suffix; matching and
tables then need no other case.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np

END = "Ā"
WORD_SUFFIX = "</w>"
#: Entries of a worker's memo of words before it starts anew; this bounds
#: memory and changes no result.
MEMO = 150_000
#: Bits of a token id in a pair's key.
PAIR_BITS = 24


class Memo(dict):
    """What a function gave for a key.  At MEMO entries it starts anew and
    keeps the entries so far as ``old``, from which those still in use return;
    so frequent words are never made twice in a row."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self):
        """Empty, as a task ends: the worker lives on."""
        self.clear()
        self.old = {}


@lru_cache(1)
def byte_letters() -> dict[str, str]:
    """The printable letter that byte-level vocabularies write for a byte,
    back to that byte as a latin-1 character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one tokenizers file of kind BPE."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        self.suffix = END if model.get("end_of_word_suffix") else ""

        def plain(token: str) -> str:
            end = ""
            if self.suffix and token.endswith(WORD_SUFFIX):
                token, end = token[:-len(WORD_SUFFIX)], END
            return "".join(map(letters.__getitem__, token)) + end

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        written = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.names = {i: t for t, i in written.items()} | {i: t for t, i in self.special.items()}
        self.token = {plain(t): i for t, i in written.items()}
        size = max(self.names) + 1
        #: Order of the merge that makes a token (-1: none, a single symbol),
        #: and the two tokens that it joins.
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merge: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = plain(a), plain(b)
            whole = self.token[left + right]
            if self.rank[whole] >= 0:
                raise ValueError(f"{path}: two merges make token {whole}")
            both = (self.token[left], self.token[right])
            self.rank[whole], self.parts[whole], self.merge[both] = order, both, order
        self.automaton = ahocorasick.Automaton()
        for text, i in self.token.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.length = [0] * size
        for text, i in self.token.items():
            self.length[i] = len(text)
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = [-1] * size
        for text, i in self.token.items():
            for n in range(len(text) - 1, 0, -1):
                if (found := self.token.get(text[:n])) is not None:
                    self.shorter[i] = found
                    break
        self.pairs = Memo(lambda key: self._compatible(
            key >> PAIR_BITS, key & (1 << PAIR_BITS) - 1))

    def symbols(self, word: bytes) -> str:
        return word.decode("latin-1") + self.suffix

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined text ends in just these two.

        The merges of both sides are undone from the last to the first, always
        at the seam; were two neighbours at the seam a merge that comes before
        the one undone last, it would have been made across the seam."""
        return self.pairs[left << PAIR_BITS | right]

    def _compatible(self, a: int, b: int) -> bool:
        rank, parts, merge = self.rank, self.parts, self.merge
        # a merge at the seam of equal age as the right side's would start
        # further left and so comes first: undoing the right side admits it
        before = len(merge) * 2 + 2
        while True:
            order = merge.get((a, b))
            if order is not None and 2 * order < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = 2 * rank[a], parts[a][1]
            else:
                before, b = 2 * rank[b] + 1, parts[b][0]

    def prefix_counts(self, word: bytes) -> list[int]:
        """Exact token count of every prefix of ``word`` (index 0: empty).

        The last token of each prefix is the one token ending there that is
        compatible with the last token of what precedes it.  For a vocabulary
        without word suffix."""
        text = word.decode("latin-1")
        last, count = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0 and ((start := end - n) == 0 or (
                    (left := last[start]) >= 0 and pairs[left << PAIR_BITS | token])):
                last[end], count[end] = token, count[start] + 1
        return count

    def count(self, word: bytes) -> int:
        """Token count of a whole word: the last entry of its table, which is
        1 at once where the word is a token."""
        return 1 if word.decode("latin-1") in self.token else self.prefix_counts(word)[-1]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word: the longest match at each place, taken back
        to a shorter one, or to the place before, where it is not compatible
        with its left neighbour.  A place once found dead is not tried again,
        so the time is linear in the word."""
        text = self.symbols(word)
        n = len(text)
        if not word:
            return []
        if (one := self.token.get(text)) is not None:
            return [one]
        longest = [-1] * n
        length, shorter, pairs = self.length, self.shorter, self.pairs
        for end, (token, size) in self.automaton.iter(text):
            start = end + 1 - size
            if longest[start] < 0 or size > length[longest[start]]:
                longest[start] = token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                to = at + length[token]
                if alive[to] and (not out or pairs[out[-1] << PAIR_BITS | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this word")
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


class Offsets:
    """Decoding table: all token names in one buffer, and where each begins."""

    def __init__(self, vocab: Vocabulary):
        size = max(vocab.names) + 1
        names = [vocab.names.get(i, "").encode() + b" " for i in range(size)]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.buffer = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The names of ``ids`` joined by one space."""
        if not len(ids):
            return b""
        begin, size = self.start[ids], self.start[ids + 1] - self.start[ids]
        to = np.cumsum(size)
        at = np.arange(to[-1]) + np.repeat(begin - (to - size), size)
        return self.buffer[at[:-1]].tobytes()
