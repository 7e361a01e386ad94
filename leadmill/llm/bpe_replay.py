"""Byte-level BPE by replaying the merges over a whole block of text at once.

The distinct pre-tokens of a block of documents form its lexicon. An inverted index leads from a mergeable
pair (named by the token it makes) to the places where it stands in the lexicon. Merges are taken in rank
order from a heap; each touches only the places in its list and re-indexes only their two neighbours. The
documents of the block are then written as the ids of their pre-tokens.

A block is what one task reads, cut after ``BLOCK_BYTES`` of text, so a task holds one block at a time and a
lost task repeats its own blocks only. Null and empty texts give no ids; repeated rows each get a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from leadmill.llm.bpe import NEVER, NO_ID, SHIFT, Ranks, pre_tokens, tiktoken_ranks
from leadmill.llm.common import arrow_schema, map_batches, texts_of

#: Text of a block and distinct pre-tokens that a task remembers from block to block.
BLOCK_BYTES = 8_000_000
REMEMBERED = 1_000_000


def replay(words: Iterable[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of each word. Equal to merging each word alone, lowest rank first and leftmost on ties."""
    get, made, single = ranks.rank.get, ranks.made, ranks.single
    ids: list[int] = [NO_ID]  # NO_ID stands between words, pairs with nothing, and marks merged-away places
    starts = []
    for word in words:
        starts.append(len(ids))
        ids.extend([single[b] for b in word])
        ids.append(NO_ID)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(ids, ids[1:])):
        rank = get(a << SHIFT | b)
        if rank is not None:
            if rank in index:
                index[rank].append(i)
            else:
                index[rank] = [i]
    heap = list(index)
    heapify(heap)
    while heap:
        rank = heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        token = made[rank]
        for at, i in enumerate(places):
            j = after[i]
            if get(ids[i] << SHIFT | ids[j]) != rank:
                continue  # a neighbour has changed since the place was listed
            ids[i], ids[j] = token, NO_ID
            k = after[i] = after[j]
            h = before[i]
            before[k] = i
            low = NEVER
            left = get(ids[h] << SHIFT | token)
            if left is not None:
                low = left
                if left in index:
                    index[left].append(h)
                else:
                    index[left] = [h]
                    heappush(heap, left)
            right = get(token << SHIFT | ids[k])
            if right is not None:
                if right < low:
                    low = right
                if right in index:
                    index[right].append(i)
                else:
                    index[right] = [i]
                    heappush(heap, right)
            if low <= rank:  # the merge made a pair that comes before the rest of this list
                rest = places[at + 1 :]
                if rest:
                    if rank in index:
                        index[rank].extend(rest)
                    else:
                        index[rank] = rest
                        heappush(heap, rank)
                break
    ends = [*(s - 1 for s in starts[1:]), n - 1]
    return [[x for x in ids[s:e] if x != NO_ID] for s, e in zip(starts, ends)]


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    """(doc_id, text) rows in blocks of about ``BLOCK_BYTES``; a longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            held.append((doc, text))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each document."""
    schema = "doc_id bigint, n_tokens bigint, ids binary"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        ranks, lexicon = tiktoken_ranks(path), {}
        for block in blocks(batches):
            cut = [pre_tokens(t) for _, t in block]
            fresh = list(set().union(*cut).difference(lexicon))
            if len(lexicon) + len(fresh) > REMEMBERED:
                lexicon.clear()
                fresh = list(set().union(*cut))
            made = replay((w.encode("utf-8", "surrogatepass") for w in fresh), ranks)
            lexicon.update((w, array("I", ids).tobytes()) for w, ids in zip(fresh, made, strict=True))
            del made, fresh
            for at in range(0, len(block), 256):
                part = [b"".join(map(lexicon.__getitem__, words)) for words in cut[at : at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in block[at : at + 256]], pa.int64()), pa.array([len(x) // 4 for x in part], pa.int64()), pa.array(part, pa.binary())],
                    schema=target,
                )

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids of each row stand for."""

    def run(batch, ranks):
        of = ranks.bytes.__getitem__
        return {"doc_id": batch.column("doc_id"), "data": [b"".join(map(of, array("I", x))) for x in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, data binary", lambda: tiktoken_ranks(path))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the bytes they decode to; one pass over ``encoded``."""

    def run(batch, ranks):
        of = ranks.bytes.__getitem__
        ids = batch.column("ids").to_pylist()
        return {
            "doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(b"".join(map(of, array("I", x)))).hexdigest() for x in ids],
        }

    return map_batches(encoded, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda: tiktoken_ranks(path))
