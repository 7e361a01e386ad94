"""Byte-pair vocabularies and their pre-tokens, shared by the counting and the replay operator."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

# Fixed value: the published pattern that cuts text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The same cuts for Python's faster matcher, whose ``[^\W\d_]`` holds letters and the six characters below.
_LATIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_ANY = regex.compile(PATTERN).findall
#: Numbers that are no decimal digits, and separators that ``re`` takes for white space, below U+0250.
_ODD = frozenset("\u00b2\u00b3\u00b9\u00bc\u00bd\u00be\x1c\x1d\x1e\x1f")


def pre_tokens(text: str) -> list[str]:
    """Texts in the Latin range take the faster matcher; all others the pattern itself."""
    letters = set(text)
    return _LATIN(text) if not letters or (max(letters) < "\u0250" and _ODD.isdisjoint(letters)) else _ANY(text)


#: Pairs of ids are kept as one integer, the left id shifted by this; ids stay below 2 ** SHIFT.
SHIFT = 20
NO_ID = (1 << SHIFT) - 1
NEVER = 1 << 60
#: From this many bytes on a pre-token is merged with a heap.
SHORT = 64


class Ranks:
    """A byte-level vocabulary: ids and bytes of tokens, the rank of each pair that merges, and the id made.

    ``pairs`` (from a merge list) names the pairs by rank; without it any two tokens whose joined bytes are a
    token merge, at that token's id.
    """

    def __init__(self, tokens: dict[bytes, int], pairs: list[tuple[int, int, int]] | None = None):
        self.ids = tokens
        self.bytes = {i: b for b, i in tokens.items()}
        self.single = [tokens[bytes([b])] for b in range(256)]
        if pairs is None:
            self.made = {i: i for i in tokens.values()}
            self.rank = {
                tokens[t[:k]] << SHIFT | tokens[t[k:]]: i
                for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens
            }
        else:
            self.made = [m for _, _, m in pairs]
            self.rank = {a << SHIFT | b: r for r, (a, b, _) in enumerate(pairs)}

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-token: lowest rank first, leftmost on ties."""
        ids = [self.single[b] for b in word]
        if len(ids) > SHORT:
            return self._long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << SHIFT | ids[i + 1], NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n for a pre-token of any length."""
        get, n = self.rank.get, len(ids)
        ids.append(NO_ID)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j >= n or get(ids[i] << SHIFT | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], NO_ID
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            for left, right in ((h, i), (i, k)):
                if left >= 0 and (r := get(ids[left] << SHIFT | ids[right])) is not None:
                    heappush(heap, (r, left))
        return [x for x in ids if x != NO_ID]


@lru_cache(maxsize=2)
def tiktoken_ranks(path: str) -> Ranks:
    """Ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies stored as text: printable Latin-1 characters are
    themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def json_ranks(path: str) -> tuple[Ranks, list[str]]:
    """Ranks from a byte-level BPE vocabulary in JSON, and its special strings, longest first."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    letters = byte_letters()
    special = [t["content"] for t in held["added_tokens"]]
    vocab = {k: i for k, i in held["model"]["vocab"].items() if k not in special}
    merges = [p.split(" ") if isinstance(p, str) else p for p in held["model"]["merges"]]
    pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
    tokens = {bytes(letters[c] for c in k): i for k, i in vocab.items()}
    return Ranks(tokens, pairs), sorted(special, key=len, reverse=True)
