"""Chat repair, packing and the pipeline against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadmill.llm import chat_repair, packing, queries

NAMES = ("", *chat_repair.ROLES)


def plain_cost(roles, new, merged, put):
    """Cost of a repair, or None if its result is not legal."""
    cost, seq = 0, []
    for r, t, m, p in zip(roles, new, merged, put):
        cost += 0 if r == t else chat_repair.RELABEL if r else chat_repair.UNKNOWN
        if m:
            if not seq or seq[-1] != t or p:
                return None
            cost += chat_repair.MERGE
            continue
        seq += [*p, t]
        cost += chat_repair.INSERT * len(p)
    chain = [0, *seq]
    legal = all((a, b) in chat_repair.LEGAL for a, b in zip(chain, chain[1:])) and chain[-1] in (2, 3)
    return cost if legal else None


def plain_best(roles):
    best = None
    puts = [(), (2,), (3,), (2, 3), (3, 2)]
    ways = [(t, m, p) for t in (1, 2, 3) for m in (False, True) for p in puts if not (m and p)]
    for way in itertools.product(ways, repeat=len(roles)):
        c = plain_cost(roles, *zip(*way))
        if c is not None and (best is None or c < best):
            best = c
    return best


def cost_of(roles):
    states = chat_repair.repair(roles)
    told = [chat_repair.action(r, b, a) for r, b, a in zip(roles, [0, *states], states)]
    merged = ["merge" in k for k, _ in told]
    return plain_cost(roles, states, merged, [p for _, p in told])


def test_repairs_are_cheapest():
    for n in (1, 2, 3):
        for roles in itertools.product(range(4), repeat=n):
            assert cost_of(list(roles)) == plain_best(list(roles)), roles


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, " User ", "x"), (2, 1, "ASSISTANT", None)]
    got = chat_repair.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("seq").collect()
    assert [r.action for r in got] == ["keep"] * 5
    assert "".join(r.rendered for r in got[:3]) == "<|system|>\ns\n<|user|>\nu\n<|assistant|>\na\n"


def test_long_conversation_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK", 8)
    monkeypatch.setattr(chat_repair, "FAN", 4)
    pick = random.Random(6)
    roles = {c: [pick.randrange(4) for _ in range(n)] for c, n in ((1, 700), (2, 1), (3, 40), (4, 9), (5, 333))}
    rows = [(c, i, NAMES[r] if r else pick.choice([None, "tool"]), f"{c}/{i}") for c, rs in roles.items() for i, r in enumerate(rs)]
    pick.shuffle(rows)
    got = defaultdict(list)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    for r in chat_repair.format_chats(frame).orderBy("seq").collect():
        got[r.conv_id].append(r)
    for c, rs in roles.items():
        assert [r.turn for r in got[c]] == list(range(len(rs)))
        states = [NAMES.index(r.new_role) for r in got[c]]
        told = [chat_repair.action(x, b, a) for x, b, a in zip(rs, [0, *states], states)]
        assert [t[0] for t in told] == [r.action for r in got[c]] and [len(t[1]) for t in told] == [r.n_inserted for r in got[c]]
        cost = plain_cost(rs, states, ["merge" in k for k, _ in told], [p for _, p in told])
        assert cost is not None and cost == cost_of(rs)


def test_rendering_of_repairs(spark):
    rows = [(1, 0, "assistant", "a"), (1, 1, "user", "b"), (1, 2, "user", "c")]
    got = chat_repair.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("seq").collect()
    assert "".join(r.rendered for r in got) == "<|user|>\n\n<|assistant|>\na\n<|user|>\nb\nc\n"
    assert [(r.action, r.n_inserted) for r in got] == [("insert", 1), ("keep", 0), ("merge", 0)]


def test_messy_and_empty_chats(spark):
    rows = [(1, None, None, None), (1, 1, "user", "x"), (1, 1, "user", "x"), (None, 0, "user", ""), (2, 0, "system", "s" * 100000), (2, 0, "assistant", "t")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.withColumns({c: F.lit("extra") for c in ("seq", "block", "conv", "code", "before", "after")})
    got = chat_repair.format_chats(frame).collect()
    assert len(got) == 6 and all(r.new_role for r in got)
    assert chat_repair.format_chats(frame.limit(0)).count() == 0


def plain_pack(items, capacity):
    """Best fit over all bins, tightest compatible first, oldest on ties; items are (length, source, cluster)."""
    bins, placed = [], []
    for length, source, cluster in items:
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= length and source not in b[1] and (cluster is None or cluster not in b[2])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        placed.append((i, capacity - bins[i][0]))
        bins[i][0] -= length
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return placed


@pytest.mark.parametrize("frequent", [[], ["s0"], ["s0", "s1", "s2"]])
def test_packer_finds_the_tightest_compatible_bin(frequent):
    pick = random.Random(len(frequent))
    for _ in range(30):
        items = [(pick.randint(1, 40), f"s{min(pick.randrange(9), pick.randrange(9))}", pick.choice([None, None, pick.randrange(6)])) for _ in range(200)]
        items.sort(key=lambda x: (-x[0], x[2] is not None, x[2] or 0, x[1]))
        packer = packing.Packer(64, frequent)
        assert [packer.place(*x) for x in items] == plain_pack(items, 64)


def held_rules(rows, sources, clusters, capacity):
    """No bin overfull, no overlap, no conflict; every word of every document placed once."""
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        at = 0
        for r in b:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        assert max(Counter(sources[r.doc_id] for r in b).values()) == 1
        assert max(Counter(clusters[r.doc_id] for r in b).values()) == 1
    return bins


def test_packing_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, shard_rows=300).collect()
    known = {r.doc_id: r for r in docs.select("doc_id", "source", packing.words(F.col("text")).alias("n"), packing.same_words(F.col("text")).alias("c")).collect()}
    held_rules(rows, {d: r.source for d, r in known.items()}, {d: r.c for d, r in known.items()}, packing.CAPACITY)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
    for d, r in known.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == r.n
    assert len({r.bin_id >> 32 for r in rows if r.bin_id is not None}) == 4


def test_shard_equals_plain_packing(spark):
    pick = random.Random(8)
    rows = [(i, pick.randint(0, 150), f"s{min(pick.randrange(5), pick.randrange(5))}", pick.choice([None, pick.randrange(20)])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, n bigint, source string, c bigint").withColumn("text", F.lit(""))
    got = {(r.doc_id, r.piece): r for r in packing.pack(frame, capacity=64, length=F.col("n"), cluster=F.col("c")).collect()}
    many = {c for c, n in Counter(r[3] for r in rows).items() if n > 1}
    items = sorted(((n if n <= 64 else n % 64, c if c in many else None, s, i) for i, n, s, c in rows), key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2], x[3]))
    items = [x for x in items if x[0]]
    plain = plain_pack([(n, s, c) for n, c, s, _ in items], 64)
    names = {}
    for (n, c, s, i), (b, offset) in zip(items, plain, strict=True):
        r = got[i, dict((x[0], x[1]) for x in rows)[i] // 64 if dict((x[0], x[1]) for x in rows)[i] > 64 else 0]
        assert r.offset == offset and names.setdefault(b, r.bin_id) == r.bin_id


def test_messy_and_empty_packing(messy, empty):
    rows = packing.pack(messy).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None, 4, 5, 6, 7, 8, 9, 10}
    assert all(r.bin_id is None and r.length == 0 for r in rows if r.doc_id in (1, 2, 7))
    assert sum(r.length for r in rows if r.doc_id == 5) == 30000
    assert packing.pack(empty).count() == 0


def test_pipeline_keeps_the_right_documents(spark):
    """The stages on given documents, each against what it must do to its input."""
    folder = "/root/testdata/sf0.01"
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.Cuts(spark, "test").write(stage(spark, docs, folder), "x")
        assert docs.columns == first.columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum(1 for d, q in good.items() if q and d not in seen[1]) == 0
    assert sum(1 for d, q in good.items() if not q and d in seen[1]) <= 3
    from tests.llm.test_dedup import FOLD, plain_components, plain_fingerprint

    last = {}
    for d, t in seen[1].items():
        last[t.translate(FOLD)] = max(d, last.get(t.translate(FOLD), d))
    assert set(seen[2]) == set(last.values())
    roots = plain_components({d: plain_fingerprint(t) for d, t in seen[2].items()})
    assert set(seen[3]) == {d for d, r in roots.items() if d == r}
    from tests.llm.test_text_rules import plain_spans

    assert set(seen[4]) == set(seen[3])
    for d, t in seen[4].items():
        assert not plain_spans(t) and (t == seen[3][d]) <= (not plain_spans(seen[3][d]))
    rows = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {r.doc_id for r in rows} == set(seen[4])
    held_rules(rows, {r.doc_id: r.source for r in docs.collect()}, {d: d for d in seen[4]}, packing.CAPACITY)


def test_pipeline_runs_on_messy_and_empty_tables(spark, messy, empty, tmp_path):
    for name, docs in (("messy", messy), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "messy")


def test_queries_are_registered(spark):
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{n}" for n in range(1, 11)]
    folder = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{folder}/conversations.parquet").count()
    assert queries.QUERIES["op7_chat_repair"](spark, folder).count() == turns


def test_marks_at_the_ends_do_not_part_clusters(spark):
    texts = ["Hello world.", "Hello world", " hello, WORLD!", "Hello word"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.col("doc_id").cast("string"))
    found = {r.doc_id: r.c for r in rows.select("doc_id", packing.same_words(F.col("text")).alias("c")).collect()}
    assert found[0] == found[1] == found[2] != found[3]
    bins = {r.doc_id: r.bin_id for r in packing.pack(rows).collect()}
    assert len({bins[0], bins[1], bins[2]}) == 3
