"""Token operators against the libraries, on odd texts and given documents."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from leadmill.llm import bpe, bpe_replay, queries, token_counts, token_files

LETTERS = ["a", "b", " ", "  ", "\n", "é", "1", "½", "²", "_", "-", "'s", "'", "\x1c", "\x85", "　", "中", "一", "Ⅷ", "😀", "<|endoftext|>", "the", "The",
           "́", "ǅ", "٣", "!!", "\t", "<|ENDOFTEXT|>", "İ", "Σ", "er", "er"]


@pytest.fixture(scope="module")
def odd():
    pick = random.Random(7)
    return ["".join(pick.choices(LETTERS, k=pick.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, " " * 2000, "ab" * 2000, "ererer" * 50, ""]


@pytest.fixture(scope="module")
def frame(spark, odd):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*odd, None])], "doc_id bigint, text string").repartition(5).cache()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_pattern_is_the_given_one():
    assert bpe.PATTERN == P.PATTERN


def test_whole_tokens_are_proved_by_the_library():
    lib = library("byte_bpe_50k.json")
    proven = token_counts.prove_whole(P.path("byte_bpe_50k.json"))
    assert len(proven) > 49_000
    for string in random.Random(1).sample(proven, 2000):
        assert len(lib.encode(string, add_special_tokens=False).ids) == 1


def test_counts_equal_the_library(frame, odd):
    lib = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_counts.count_tokens(frame, P.path("byte_bpe_50k.json"), limit=20).collect()}
    for i, t in enumerate([*odd, ""]):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 20), t[:80]


def test_counts_forget_when_full(odd, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    lib, held = library("byte_bpe_50k.json"), token_counts._Lengths(P.path("byte_bpe_50k.json"))
    for t in odd[:300]:
        assert held.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def tiktoken_of():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_library_and_decodes(frame, odd):
    path, lib = P.path("byte_bpe_50k.tiktoken"), tiktoken_of()
    encoded = bpe_replay.encode(frame, path)
    ids = {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in encoded.collect()}
    data = {r.doc_id: bytes(r.data) for r in bpe_replay.decode(encoded, path).collect()}
    shas = {r.doc_id: r for r in bpe_replay.digests(encoded, path).collect()}
    for i, t in enumerate([*odd, ""]):
        want = lib.encode_ordinary(t)
        assert ids[i] == want, t[:80]
        assert data[i] == t.encode()
        assert shas[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert shas[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and shas[i].n_tokens == len(want)


def test_replay_follows_rank_order_in_any_vocabulary():
    """Vocabularies whose merges make pairs of lower rank, against merging each word alone."""
    pick = random.Random(3)
    for _ in range(60):
        tokens = {bytes([b]): b for b in range(256)}
        while len(tokens) < 290:
            word = bytes(pick.choices(b"abc", k=pick.randint(2, 5)))
            tokens.setdefault(word, len(tokens))
        ranks = bpe.Ranks(tokens)
        words = [bytes(pick.choices(b"abc", k=pick.randint(0, 90))) for _ in range(60)]
        assert bpe_replay.replay(words, ranks) == [plain_merge(w, tokens) for w in words]
        assert [ranks.encode(w) for w in words] == [plain_merge(w, tokens) for w in words]


def plain_merge(word, tokens):
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [tokens.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return [tokens[p] for p in parts]
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("held", [1_000_000, 30])
def test_word_encoder_equals_the_library(odd, monkeypatch, held):
    """Any code points, by the words where the tokenizer agrees on the cuts."""
    monkeypatch.setattr(token_files, "REMEMBERED", held)
    pick, lib, made = random.Random(held), library("word_bpe_49k.json"), token_files.WordEncoder(P.path("word_bpe_49k.json"))
    assert made.cuts and len(made.proved) > 30_000
    planes = [(0, 0x250), (0x80, 0x3000), (0x3000, 0xD7FF), (0xE000, 0x1FFFF)]
    texts = ["".join(pick.choice(["a", " ", "!", "1", "'", "Word", chr(pick.randint(*pick.choice(planes)))]) for _ in range(pick.randint(1, 12))) for _ in range(6000)]
    texts += odd + ["(word) word's 3.14 e.g. <b>x</b> a|startoftext|", "x <|startoftext|>y", "Ὀδυσσεύς ΟΔΥΣΣΕΥΣ", "straße STRASSE Čeština"]
    for t, ids in zip(texts, made.encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_token_files_equal_the_library(spark, frame, odd):
    lib = library("word_bpe_49k.json")
    got = {r.doc_id: r for r in token_files.write_and_read(frame, P.path("word_bpe_49k.json"), 2).collect()}
    start = 0
    for i, t in enumerate([*odd, ""]):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)), t[:80]
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), t[:80]
        start += len(ids)


def test_shards_give_views_of_equal_sequences(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH", 4)
    writer = token_files.ShardWriter(str(tmp_path), "one", "H", 8)
    pick, docs = random.Random(5), []
    for i in range(40):
        ids = [pick.randrange(1 << 16) for _ in range(pick.choice([1, 3, 30, 100]))]
        docs.append(ids)
        writer.add(i, np.array(ids, np.uint16).tobytes())
    writer.close()
    shard, flat = token_files.Shard(str(tmp_path), "one"), [x for d in docs for x in d]
    assert len(shard) == -(-len(flat) // 8)
    for i in (0, 3, 4, 7, len(shard) - 1):
        ids, mask = shard.sequence(i)
        want = flat[8 * i : 8 * i + 8]
        assert ids.tolist() == want + [0] * (8 - len(want)) and not ids.flags.owndata
        assert mask.to_pylist() == [k < len(want) for k in range(8)]
    rows = [r for b in shard.documents() for r in b.to_pylist()]
    for r, ids in zip(rows, docs, strict=True):
        assert [x for part in shard.tokens(r["start"], r["n_tokens"]) for x in part.tolist()] == ids


def test_messy_and_empty_tables(messy, empty):
    json, ranks, words = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
    for docs, n in ((messy, 12), (empty, 0)):
        assert token_counts.count_tokens(docs, json).count() == n
        assert bpe_replay.digests(bpe_replay.encode(docs, ranks), ranks).count() == n
        assert token_files.write_and_read(docs, words, 2).count() == n
    assert token_counts.count_tokens(messy, json).where("doc_id <= 2").agg(F.sum("n_tokens")).first()[0] == 0


@pytest.mark.parametrize("name", ["op3_token_files", "op5_token_counts", "op6_bpe_replay"])
def test_queries_cover_the_table(spark, name):
    folder = "/root/testdata/sf0.001"
    assert queries.QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()
