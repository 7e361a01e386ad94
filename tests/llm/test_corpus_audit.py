"""Whitening, licence scan and divergence audit against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadmill.llm import common, license_scan, source_divergence, whitening

FOLD = str.maketrans(common.UPPER, common.UPPER.lower())

# ---- whitening


def plain_whitening(x, wanted):
    n, sums = len(x), x.sum(axis=0)
    away = x - sums / n
    v = np.atleast_2d(np.cov(away.T, bias=True))
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:wanted], basis[:, ::-1][:, :wanted]
    return away @ basis / np.sqrt(values), values / v.trace(), ((n * x - sums) ** 2).sum(axis=1)


def frame_of(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(parts)


@pytest.mark.parametrize("d, n, parts", [(48, 300, 3), (5, 40, 40), (1, 9, 2)])
def test_whitening_equals_dense_eigenvectors(spark, d, n, parts):
    pick = np.random.default_rng(d)
    entries = (pick.standard_normal((n, d)) * np.linspace(0.2, 3, d)).astype(np.float32)
    rows = whitening.whiten(frame_of(spark, entries.tolist(), parts)).toPandas()
    k = min(32, d)
    want, explained, deviation = plain_whitening(np.floor(64 * entries.astype(float)).astype(np.int64) + 1_000_000, k)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == (n, k)
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    first = rows[rows.vec_id == 0].sort_values("component")
    assert np.allclose(first.explained, explained, rtol=1e-10)
    assert rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation.tolist()
    assert set(rows.n) == {n} and rows.identity_error.nunique() == 1 and rows.identity_error.max() < 1e-10


def test_whitening_drops_broken_vectors_and_keeps_the_rest(spark):
    pick = random.Random(3)
    good = [[pick.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    broken = [None, [None, 1.0, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [], [1.0, 2.0]]
    rows = frame_of(spark, broken + good + good[:1]).withColumns({c: F.lit("x") for c in ("v", "key", "n", "component", "d", "label")})
    out = whitening.whiten(rows).toPandas()
    assert sorted(out.vec_id.unique()) == list(range(6, 37)) and set(out.n) == {31} and len(out) == 31 * 4
    same = out[out.vec_id.isin([6, 36])].pivot(index="component", columns="vec_id", values="whitened")
    assert (same[6] == same[36]).all()


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_whitening_without_variance_is_empty(spark, vectors):
    out = whitening.whiten(frame_of(spark, vectors))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_whitening_of_flat_and_huge_entries(spark):
    pick = random.Random(5)
    flat = [[1.0, x := pick.gauss(0, 1), 2 * x, pick.gauss(0, 1)] for _ in range(25)]  # two directions have no variance, but for the grid
    out = whitening.whiten(frame_of(spark, flat)).toPandas()
    assert out.component.max() == 3 and out.identity_error.max() < 1e-4
    huge = whitening.whiten(frame_of(spark, [[3e38, 1.0], [-3e38, 2.0], [1.0, 5.0]])).toPandas()
    assert huge.deviation.isna().sum() == 2 and len(huge) == 3


def test_equal_eigenvalues_come_as_one_interval():
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((20, 20)))[0]
    values = np.array([9.0] * 5 + [8.0] + [3.0] * 10 + [1.0, 0.5, 0.0, 0.0])
    v = (turn * values) @ turn.T
    diagonal, off = whitening.tridiagonal(v)
    assert whitening.inertia(diagonal, off, np.array([0.1, 2.0, 8.5, 10.0])).tolist() == [2, 4, 15, 20]
    parts = whitening.slices(diagonal, off, 16, 1e-9, size=2)
    assert sum(p[2] for p in parts) >= 16
    for low, high, count in parts:
        found = whitening.feast(v, low, high, count)
        assert found.shape == (20, count) and np.abs(v @ found - found * (found * (v @ found)).sum(axis=0)).max() < 1e-10
        assert np.abs(found.T @ found - np.eye(count)).max() < 1e-12


def test_moments_join_exactly():
    rows = np.random.default_rng(1).integers(-(10**6), 10**6, (500, 6))
    held = whitening.Moments(6)
    for part in np.array_split(rows, 13):
        more = whitening.Moments(6)
        more.add(part)
        held.join(whitening.Moments.of(more.row(0)))
    assert held.sums == rows.sum(axis=0).tolist() and held.n == 500
    assert np.allclose(held.covariance, np.cov(rows.T, bias=True), rtol=1e-12)


# ---- licence scan


def plain_words(text):
    return re.findall(license_scan.BREAKS.replace("[", "[^", 1), (text or "").translate(FOLD))


def plain_scan(texts, known=license_scan.KNOWN):
    """Every template held against every place of every text."""
    words = [plain_words(t) for t in texts]
    df = Counter(w for ws in words for w in set(ws) & set(known.vocabulary))
    idf = {w: math.log(1 + len(texts) / (df[w] + 1)) for w in known.vocabulary}
    out = []
    for ws in words:
        places, labels, score = [], set(), 0.0
        for t, template in enumerate(known.words):
            total = sum(idf[w] for _, w, _ in template)
            for o in range(-len(template) - 30, len(ws)):
                at = [(w, m, 0 <= o + i < len(ws) and ws[o + i] == w) for i, w, m in template]
                share = sum(idf[w] for w, _, hit in at if hit) / total
                if all(hit for _, m, hit in at if m) and share >= license_scan.SHARE - 1e-9:
                    if t < known.n_base:
                        places.append((o, known.labels[t]))
                        score = max(score, license_scan.BASE_SCORE)
                    else:
                        labels.add(known.labels[t])
                        score = max(score, min(share, 1.0))
        base = {b for _, b in places}
        starts = [o for o, _ in places]
        out.append((len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    return out


FILES = [
    "Released under the MIT License.", "MIT-license\nmit LICENSE mit license", "mit licenses", "the license of MIT", "", None, "...", "a\x00b", "ÀMIT license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')",
    "hereby granted free of charge", "Licensed under CC BY-NC 4.0.", "cc by nc", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU Lesser General Public License",
    "general public public license general public license", "Redistribution and use in source and binary forms, without change",
    "// Redistribution and use in source and binary\n// forms, with or without modification, are permitted", "word " * 4000 + "mit license " * 300,
    "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "free and unencumbered software released into the public domain", "license mit license",
]


def test_scan_equals_all_places(spark):
    pick = random.Random(11)
    bits = [w for _, p, _ in license_scan.TEMPLATES for w in p.split()] + ["zebra", "Été", ",", "-", "MIT license", "general public license"]
    texts = FILES + [" ".join(pick.choices(bits, k=pick.randint(0, 60))) for _ in range(40)] + [
        " ".join(w if pick.random() > 0.15 else "other" for w in pick.choice(license_scan.TEMPLATES)[1].split()) for _ in range(60)]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts)
    for i, want in enumerate(plain_scan(texts)):
        assert got[i][:-1] == want[:-1], texts[i][:200]
        assert got[i][-1] == pytest.approx(want[-1], abs=1e-9)


def test_scan_labels_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    marks = {"Released under the MIT License": "mit", "Licensed under the Apache License": "apache", "GNU General Public License": "gpl", "Licensed under CC BY-NC": "cc-by-nc"}
    for r in docs.select("doc_id", "text").collect():
        want = {v for k, v in marks.items() if k in (r.text or "")}
        assert set(got[r.doc_id].labels.split(",")) - {""} == want
        assert got[r.doc_id].n_words == len(plain_words(r.text))


def test_scan_of_messy_rows(messy, empty):
    rows = license_scan.scan(messy).collect()
    assert len(rows) == 12 and {r.labels for r in rows} == {""} and {r.score for r in rows} == {0.0}
    assert license_scan.scan(empty).count() == 0


# ---- divergence audit


def plain_audit(rows, top=200):
    docs = [(x or "", s or "", Counter(re.findall(source_divergence.TERM, (t or "").translate(FOLD)))) for t, x, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in df.items() if n >= 3)
        held = {s: Counter() for _, s, _ in mine}
        for _, s, c in mine:
            held[s].update({t: n for t, n in c.items() if df[t] >= 3})
        whole = sum(held.values(), Counter())

        def shares(counts):
            return {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts.values()) + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in held.items()}, shares(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in held:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in held if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if held[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top}
    return out


def corpus():
    pick = random.Random(17)
    words = [chr(97 + i % 26) * (1 + i // 26) for i in range(60)] + ["É", "é", "Ab", "aB", "中文", "😀"]
    rows = [("x", None, "lone"), (None, "en", "none"), ("", "de", "a"), ("x1y_z'w", "de", "b")]
    for _ in range(150):
        source = pick.choice(["a", "a", "a", "b", "c", "d", None, "é"])
        rows.append((" ".join(pick.choices(words[: pick.choice([4, 30, 66])], k=pick.randint(0, 80))), pick.choice(["en", "en", "fr", None]), source))
    return rows + rows[:5]


@pytest.mark.parametrize("limits", [{}, {"entries": 40, "pairs": 3, "tile": 2, "open_entries": 5}])
def test_audit_equals_plain_sums(spark, limits):
    rows = corpus()
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).withColumns({c: F.lit("x") for c in ("term", "shard", "p", "q", "value", "rank", "head", "a", "b")})
    got = source_divergence.audit(frame, **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows)


def test_audit_cuts_ranks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "PIECE", 7)
    assert [t for part in source_divergence.terms_of("aa bbbbbbbbbbbb cc-dd EE " * 9) for t in part] == ["aa", "bbbbbbbbbbbb", "cc", "dd", "ee"] * 9
    rows = [(" ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(250)), "en", s) for s in "aaab"] + [("zz " * 500, "en", "b")] * 3
    got = source_divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert {tuple(r) for r in got.collect()} == plain_audit(rows)


@pytest.mark.parametrize("open_entries", [1, 7, 1000])
def test_merge_gives_whole_terms_in_order(open_entries):
    pick = random.Random(4)
    want, pieces = Counter(), []
    for _ in range(40):
        terms = sorted(pick.choices("abcdefghij", k=pick.randint(1, 8)))
        pieces.append((pick.choice(["x", "y"]), [pa.array(terms), pa.array(["s"] * len(terms)), pa.array([2] * len(terms)), pa.array([1] * len(terms))]))
        want.update((pieces[-1][0], t) for t in terms)
    got, done, now = Counter(), set(), set()
    for lang, part in source_divergence.merge(iter(sorted(pieces, key=lambda p: (p[0], p[1][0][0].as_py()))), open_entries):
        if part is None:
            done |= now
            now = set()
        else:
            now |= {(lang, t) for t in part[0].to_pylist()}
            got.update((lang, t) for t in part[0].to_pylist())
        assert not now & done  # a term is never given out again behind a mark
    assert got == want and (open_entries > 100 or len(done) == len(want))


def test_shares_of_large_counts_are_exact(spark):
    n = [0, 8_999_999_999, 9_000_000_000, 10**15]
    rows = spark.createDataFrame([(x, 3 * 10**15, 7) for x in n], "n bigint, total bigint, v bigint")
    got = [r[0] for r in rows.select(source_divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (x + 1) // (3 * 10**15 + 7) for x in n]


def test_audit_of_messy_rows(messy, empty):
    assert {(r.lang, r.part) for r in source_divergence.audit(messy).collect()} >= {("en", "pair")}
    assert source_divergence.audit(empty).count() == 0
