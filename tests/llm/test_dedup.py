"""Duplicate operators against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadmill.llm import common, exact_dedup, simhash
from leadmill.llm.common import Cuts

FOLD = str.maketrans(common.UPPER, common.UPPER.lower())


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """doc -> smallest doc reachable, by comparing all pairs."""
    docs, root = list(fps), {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def test_fingerprints_and_components_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.link(docs).withColumn("hex", simhash.hex_of(F.col("fp"))).collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: r.hex for d, r in got.items()} == {d: f"{x:016x}" for d, x in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == plain_components(fps)


def near(pick, n, spread):
    """Fingerprints in chains and crowds: each new one flips a few bits of an old one."""
    fps = [pick.getrandbits(64) for _ in range(5)]
    while len(fps) < n:
        x = pick.choice(fps)
        for b in pick.sample(range(64 if spread else 14), pick.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    return fps


@pytest.mark.parametrize("tile, spread", [(4096, True), (4096, False), (16, True), (16, False)])
def test_components_equal_all_pairs(spark, monkeypatch, tile, spread):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = dict(enumerate(near(random.Random(tile + spread), 700, spread)))
    nodes = defaultdict(lambda: 1 << 60)
    for d, x in fps.items():
        nodes[x] = min(nodes[x], d)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x), d) for x, d in nodes.items()], "fp bigint, node bigint").repartition(3)
    cuts = Cuts(spark, "test")
    roots = {r.node: r.root for r in simhash.components(simhash.edges(frame, cuts), cuts).collect()}
    want = plain_components(fps)
    assert {d: roots.get(nodes[x], nodes[x]) for d, x in fps.items()} == want


def test_long_chain_of_edges(spark):
    order = list(range(400))
    random.Random(2).shuffle(order)
    pairs = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:])], "a bigint, b bigint")
    assert {(r.node, r.root) for r in simhash.components(pairs, Cuts(spark, "test")).collect()} == {(i, 0) for i in range(1, 400)}


def test_unary_counts_bound_the_distance(spark):
    pick = random.Random(4)
    a = np.array([pick.getrandbits(64) for _ in range(500)], np.uint64)
    b = a ^ np.array([pick.getrandbits(64) & pick.getrandbits(64) for _ in range(500)], np.uint64)
    counts = lambda x: [(int(x) >> 2 * i & 3).bit_count() for i in range(32)]
    far = np.bitwise_count(simhash._embed(a) ^ simhash._embed(b))
    for x, y, d in zip(a, b, far):
        assert d == sum(abs(p - q) for p, q in zip(counts(x), counts(y))) <= int(x ^ y).bit_count()
    rows = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp bigint")
    assert [r[0] for r in rows.select(simhash.embed(F.col("fp"))).collect()] == simhash._embed(a).view(np.int64).tolist()


def plain_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(FOLD)].append(d)
    return sorted((d, max(groups[k]), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for d, t in rows for k in [(t or "").translate(FOLD)])


def test_exact_groups_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = exact_dedup.deduplicate(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == plain_dedup([tuple(r) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_state_lasts_over_micro_batches(spark):
    rows = [(i, f"Text {i % 37}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = exact_dedup.deduplicate(docs, files=1, fold=3).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == plain_dedup(rows)


def test_hits_are_checked_on_full_bytes(spark):
    """A digest of 2 bits: every hit but true copies is told apart by the texts."""
    rows = [(i, f"text {i % 23}" if i % 2 else f"TEXT {i % 23}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    weak = lambda t: F.unhex(F.format_string("%02x", F.crc32(t) % 4))
    got = exact_dedup.deduplicate(docs, digest=weak).collect()
    want = {d: (k, n) for d, k, n, _ in plain_dedup(rows)}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want and len(got) == 200
    assert sum(r.kept for r in got) == 23


def test_messy_and_empty_tables(messy, empty):
    got = exact_dedup.deduplicate(messy).collect()
    assert len(got) == 12
    by = {(r.doc_id, r.kept): r for r in got}
    assert by[3, True].group_size == 3 and (3, False) in by and by[None, False].keep_id == 3
    assert by[1, False].keep_id == 2 and by[2, True].group_size == 2
    kept = exact_dedup.kept_rows(messy)
    assert kept.columns == messy.columns and kept.count() == 9
    linked = simhash.link(messy).collect()
    assert len(linked) == 12 and {r.component_id for r in linked if r.doc_id in (1, 2, 7)} == {1}
    assert {r.component_id for r in linked if r.doc_id is None} == {3}
    thin = simhash.kept_rows(messy)
    assert thin.columns == messy.columns and thin.where("doc_id in (2, 7)").isEmpty()
    for f in (exact_dedup.deduplicate, exact_dedup.kept_rows, simhash.link, simhash.kept_rows):
        assert f(empty).count() == 0
