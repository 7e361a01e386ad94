"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is put through the merges on its own; those that come out as exactly one
token, and are one pre-token, form the table of whole tokens. A document's count is then the number of its
pre-tokens found in the table, plus the merged lengths of the rest.

Null and empty texts have 0 tokens and 0 bytes; repeated rows each get their own row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from leadmill.llm.bpe import json_ranks, pre_tokens
from leadmill.llm.common import map_batches, texts_of

#: Merged lengths that a Python worker remembers at most; it forgets all of them when full.
REMEMBERED = 1_000_000


def prove_whole(path: str) -> list[str]:
    """Vocabulary strings that alone are one pre-token and encode as their own single token."""
    ranks, _ = json_ranks(path)
    proven = []
    for data, own in ranks.ids.items():
        try:
            string = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pre_tokens(string) == [string] and ranks.encode(data) == [own]:
            proven.append(string)
    return proven


class _Lengths(dict):
    """Tokens by pre-token: 1 for the proven strings; others are merged when first met."""

    def __init__(self, path: str):
        self.proven = dict.fromkeys(prove_whole(path), 1)
        super().__init__(self.proven)
        self.ranks, special = json_ranks(path)
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        n = len(self.ranks.encode(word.encode("utf-8", "surrogatepass")))
        if len(self) >= REMEMBERED + len(self.proven):
            self.clear()
            self.update(self.proven)
        self[word] = n
        return n

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each and cut it into parts."""
        parts = self.cut.split(text) if self.cut else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, pre_tokens(p))) for p in parts if p)


@lru_cache(maxsize=1)
def lengths(path: str) -> _Lengths:
    return _Lengths(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count is over ``limit``."""

    def count(batch, held):
        texts = texts_of(batch, "text")
        tokens = [held.count(t) for t in texts]
        return {
            "doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": tokens, "over_limit": [n > limit for n in tokens],
        }

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return map_batches(rows, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", lambda: lengths(path))
