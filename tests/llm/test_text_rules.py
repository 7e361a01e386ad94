"""Personal data, quality rules and the line field against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import pii, quality_crf, quality_rules, queries
from leadmill.llm.common import Cuts

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def named(spans):
    return ",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in spans)


def odd_texts():
    pick = random.Random(11)
    bits = ["a", "b.c", "@", ".", "x-y", "1", "22", "255", "256", "007", "+", " ", "-", "(", ")", "_", "%", "😀", "é", "\n", "4111 1111 1111 1111", "a@b.co", "4111-1111-1111-1111", "+1 (375) 555-4393", "1.2.3.4"]
    return ["".join(pick.choices(bits, k=pick.randint(1, 25))) for _ in range(1500)] + [
        "a@b.com_c@d.com", "1.2.3.4.5.6.7.8.9", "+1 222 333 4444+1 222 333 4444", "9" * 50_000, "a." * 30_000, "a@" + "b." * 20_000 + "c", "1." * 30_000, "+1 (" * 100 + "2", "+1 (",
    ]


def test_base_spans_equal_the_patterns(spark):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string").repartition(4)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.base_spans(rows).select("doc_id", "base").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t[:120]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"10.0.{i % 256}.{i % 200}" for i in range(5000))
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, t string")
    assert [tuple(s) for s in pii.base_spans(rows).first().base] == plain_spans(text)


def test_a_million_digits(spark):
    rows = spark.createDataFrame([(1, "7" * 1_000_000), (2, "+1 (" * 100_000), (3, "1." * 300_000 + " a@b.co")], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.report(rows).collect()}
    assert got[1] == "" and got[2] == "" and got[3].endswith("email:600001:600007")


def test_report_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        counts = Counter(pii.KINDS[k] for _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(named(spans).encode()).hexdigest()
        assert set(filter(None, named(spans).split(","))) <= set(r.spans.split(","))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    pick, rows = random.Random(1), []
    for i in range(40):
        rows.append((i, f"For help please call +1 (512) 555-{1000 + i} during the day."))
    rows.append((100, "Or please call 512 555 7777 during the day."))  # no plus sign: not a base phone
    rows.append((101, "Chapter about the 512 555 7777 bricks we counted."))
    rows += [(200 + i, f"The year {1900 + i} was number {pick.randint(100, 999)} of all.") for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == "phone:15:27" and got[101] == ""
    assert all(got[200 + i] == "" for i in range(30)) and got[0] == named(plain_spans(rows[0][1]))


def test_neighbouring_identifiers_are_found_one_by_one(spark):
    """Lists of identifiers a space, a comma or a sentence apart, with and without a base span among them."""
    rows = [(i, f"For help please call +1 (512) 555-{1000 + i} during the day.") for i in range(40)]
    rows += [(100 + i, f"Then write to u{i}@site.org, +1 (375) 555-{4000 + i} for answers.") for i in range(40)]
    given = {
        200: ("Please call 512 555 7777, 512 555 8888 during the day.", "512 555 7777|512 555 8888"),
        201: ("Please call 512 555 7777, 512 555 8888; 512 555 9999 during the day.", "512 555 7777|512 555 8888|512 555 9999"),
        202: ("Please call +1 (512) 555-1000, 512 555 8888 during the day.", "512 555 8888"),
        203: ("Then write to jane@x.org, 555-123-4567 for answers.", "555-123-4567"),
        204: ("Please call 512-555-7777 512-555-8888 during the day.", "512-555-7777|512-555-8888"),
        205: ("Then write to jane@localhost 555-123-4567 for answers.", "jane@localhost|555-123-4567"),
        206: ("Please call 512 555 7777. 2024 was a good year.", "512 555 7777"),
        207: ("In 2019, 2020 and 1024 768 there were 12, 13 or 14 of them.", ""),
    }
    rows += [(i, t) for i, (t, _) in given.items()]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (text, want) in given.items():
        base = set(filter(None, named(plain_spans(text)).split(",")))
        more = [s.split(":") for s in got[i].split(",") if s and s not in base]
        assert [text[int(a) : int(b)] for _, a, b in more] == list(filter(None, want.split("|"))), (text, got[i])
    assert all(got[i] == named(plain_spans(t)) for i, t in rows if i < 200)


def test_found_identifiers_open_further_contexts(spark):
    """Two hops: seeds teach one context, the bare numbers found there a second one, where no base span ever stands."""
    rows = [(i, f"You can call me at +1 (512) 555-{1000 + i} all day.") for i in range(6)]
    rows += [(10 + i, f"You can call me at 512 555 {7770 + i} all day.") for i in range(4)]
    rows += [(20 + i, f"Please ring office desk 512 555 {7770 + i} before noon.") for i in range(5)]
    rows += [(30 + i, f"Then count office chairs {100 + i} 555 {7000 + i} before lunch.") for i in range(5)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows[6:15]:
        (found,) = got[i].split(",")
        kind, a, b = found.split(":")
        assert kind == "phone" and text[int(a) : int(b)].startswith("512 555 777"), (i, got[i])
    assert all(got[30 + i] == "" for i in range(5))


def test_recall_of_planted_identifiers(spark):
    """Sentences with identifiers put into given documents: a part is written as no base pattern has it. Numbers and words with
    digits stand in contexts of their own. (The identifiers that the documents bring stand among random words.)"""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) < 3000").orderBy("doc_id").collect()
    pick, rows, planted = random.Random(8), [], {}
    frames = [("phone", "you may call us at {} until noon"), ("phone", "our desk answers on {} most days"), ("email", "write a letter to {} with questions"),
              ("email", "send the form to {} by Friday"), ("ip", "the host listens on address {} for now")]
    traps = ["the report of {} lists parts", "chapter {} has the tables", "we counted {} bricks there", "model x{} is sold out"]
    for i, r in enumerate(docs):
        kind, frame = frames[i % 5]
        n = [pick.randint(200, 999), pick.randint(200, 999), pick.randint(1000, 9999)]
        base = {"phone": "+1 ({}) {}-{}", "email": "u{}.{}@mail{}.org", "ip": "10.{}.{}.7"}[kind].format(*n)
        base = f"10.{n[0] % 256}.{n[1] % 256}.7" if kind == "ip" else base
        other = {"phone": "{} {} {}".format(*n), "email": "u{}.{}@mailhost{}".format(*n), "ip": f"10.{n[0] % 256}.{n[1] % 256}.7:{n[2]}"}[kind]
        unseen = kind != "ip" and pick.random() < 0.3
        head = (r.text or "") + "\n" + pick.choice(traps).format(pick.randint(100, 9999)) + ".\nHere "
        before = head + frame[: frame.index("{")]
        value = other if unseen else base
        rows.append((i, before + value + frame[frame.index("}") + 1 :] + "."))
        if unseen:
            planted[i] = (len(before), len(before) + len(value))
    texts, hit, wrong = dict(rows), 0, 0
    for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        base = set(filter(None, named(plain_spans(texts[r.doc_id])).split(",")))
        more = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s and s not in base}
        hit += planted.get(r.doc_id) in more
        wrong += len(more - {planted.get(r.doc_id)})
    print(f"recall {hit}/{len(planted)}, wrong {wrong}")
    assert len(planted) > 100 and hit / len(planted) >= 0.9 and wrong <= 0.02 * hit


def test_every_base_span_is_a_seed(spark):
    texts = odd_texts()[:1500] + ["card 4111 1111 1111 1111 a@b.co end", "+1  222 333 4444 tail", " ".join(f"10.0.{i % 256}.{i % 200}" for i in range(5000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    cuts = Cuts(spark, "test")
    scanned = pii.scan(docs, cuts)
    seeds = {(r.doc_id, r.start, r.seed, r.end, r.value) for r in pii._mentions(scanned).where("seed is not null").join(scanned.select("row", "doc_id"), "row").collect()}
    assert seeds == {(i, s, k, e, t[s:e]) for i, t in enumerate(texts) for s, k, e in plain_spans(t)}


def test_redaction(spark):
    rows = [(1, "mail x@y.fr, call +1 (375) 555-4393 😀 10.0.0.1!", 48), (2, "nothing", 7), (3, None, None), (1, "other a@b.co", 12), (2, "nothing", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in pii.redacted(docs).collect())
    assert got == [(1, "mail [EMAIL], call [PHONE] 😀 [IP]!", 34), (1, "other [EMAIL]", 13), (2, "nothing", 7), (2, "nothing", 7), (3, "", 0)]


def test_overlapping_spans_leave_nothing(spark):
    row = spark.createDataFrame([("ab 123456 cd", [(3, 2, 7), (5, 3, 9)])], "t string, s array<struct<start:int,rank:int,end:int>>")
    assert row.select(pii.redact(F.col("t"), F.col("s"))).first()[0] == "ab [CARD] cd"


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rules(spark):
    pick = random.Random(9)
    texts = [" ".join(pick.choices(["a", "b", "c", "<d>", "é😀", "\n", "\t", "x\x0by", "\x85", "||"], k=pick.randint(0, 120))) for _ in range(400)]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts += [r.text for r in given] + ["", "one", "one two", "a b c a b c", None]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    for r in quality_rules.judge(docs).collect():
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_limits_adapt_to_the_group(spark):
    """A source that always writes tables keeps them; the same text is rejected where nobody else does."""
    pick = random.Random(2)
    word = lambda: "".join(pick.choices("abcdefghij", k=pick.randint(3, 7)))
    prose = lambda: " ".join(word() for _ in range(80))
    sheet = lambda: " | ".join(word() for _ in range(80))
    rows = [(i, prose(), "en", "news") for i in range(400)] + [(1000 + i, sheet(), "en", "tables") for i in range(400)] + [(5000, sheet(), "en", "news"), (5001, prose(), "en", "rare")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[5000] and got[5001] and all(got[i] for i in range(400)) and all(got[1000 + i] for i in range(400))


def test_small_groups_take_merged_sketches(spark):
    rows = spark.createDataFrame([(i, "en" if i < 300 else None, f"s{i % 100}") for i in range(310)], "doc_id bigint, lang string, source string")
    rows = rows.withColumns({m: F.col("doc_id").cast("double") for m in quality_rules.SKETCHED})
    found = {(r.lang, r.source): r.limit for r in quality_rules.limits(rows, Cuts(spark, "test")).collect()}
    assert len(found) == 110
    assert found["en", "s1"]["word_len"]["high"] == pytest.approx(269 + 4 * (269 - 149), abs=12)  # of the language
    assert found[None, "s1"]["word_len"]["high"] == pytest.approx(278 + 4 * (278 - 154), abs=12)  # of all


def brute_marginals(node, pair):
    n = len(node)
    p, total = np.zeros(n), 0.0
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(node[i] for i in range(n) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
    return p / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        node, pair = rng.normal(size=n) * 3, rng.normal(size=(2, 2)) * 2
        want = brute_marginals(node, pair)
        assert np.allclose(quality_crf.marginals(node, pair), want)
        p, both = quality_crf._expect(node[None], np.ones((1, n), bool), pair)
        assert np.allclose(p[0], want) and np.isclose(both.sum(), n - 1)


def test_neighbours_decide_an_unclear_line():
    pair = np.array([[1.5, -1.5], [-1.5, 1.5]])
    assert quality_crf.marginals(np.array([4.0, 0.0, 4.0]), pair)[1] > 0.9
    assert quality_crf.marginals(np.array([-4.0, 0.0, -4.0]), pair)[1] < 0.1


def test_lines_of_other_quality_stand_out(spark):
    """A block of junk inside a good text: labels of lines follow the lines, not the document."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.learn(docs, labels)
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).where(F.length("text") > 300).orderBy("doc_id")
    prose, junk = ([r.text.replace("\n", " ")[:300] for r in held.where(F.col("quality") == q).limit(40).collect()] for q in (1, 0))
    good = lambda lines: quality_crf.marginals(quality_crf.widen(quality_crf.line_features("\n".join(lines))[0]) @ field.weights, field.pair)
    apart = []
    for i in range(0, 36, 4):
        p = good(prose[i : i + 4] + junk[i : i + 4] + prose[:4])
        apart.append(np.delete(p, range(4, 8)).mean() - p[4:8].mean())
    assert np.mean(np.array(apart) > 0.3) > 0.8, np.round(apart, 2)


def test_blocks_of_long_texts_have_their_true_neighbours(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "BLOCK_LINES", 3)
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda docs, good: seen.extend(docs))
    text = "\n".join(f"line {'word ' * i}" for i in range(9))
    quality_crf.learn(spark.createDataFrame([(1, text), (2, "a\nb")], "doc_id bigint, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"))
    whole = quality_crf.widen(quality_crf.line_features(text)[0])
    begin = zlib.crc32(text.encode()) % 7
    assert any(np.array_equal(wide, whole[begin : begin + 3]) for wide, _ in seen) and sorted(len(n) for _, n in seen) == [2, 3]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.learn(docs, labels)
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    good = {r.doc_id: r.quality for r in held.select("doc_id", "quality").collect()}
    said = {r.doc_id: int(r.score >= 0.3) for r in quality_crf.score(held, field).collect()}
    assert len(good) > 300 and sum(good[d] == said[d] for d in good) / len(good) > 0.98
    clean = [d for d in good if good[d]]
    assert sum(said[d] for d in clean) / len(clean) > 0.99


def test_labels_of_held_out_rows_are_not_read(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_crf.learn(docs, labels, sample=100), quality_crf.learn(docs, flipped, sample=100)
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope
    got = queries.QUERIES["op1_quality_crf"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)


def test_messy_and_empty_tables(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (5, 0), (6, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    none = labels.limit(0)
    for marked in (labels, none):
        field = quality_crf.learn(messy, marked)
        scores = [r.score for r in quality_crf.score(messy, field).collect()]
        assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    kept = quality_crf.keep_good(messy, field)
    assert kept.columns == messy.columns and kept.count() == 12
    assert quality_rules.judge(messy).count() == 12 and pii.report(messy).count() == 12
    clean = pii.redacted(messy)
    assert clean.columns == messy.columns and clean.count() == 12
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[4].startswith("Écrire à [EMAIL] ou [PHONE].") and texts[9] == "10.0.0.256: [CARD], [IP]" and texts[2] is None
    for f in (quality_rules.judge, pii.report, pii.redacted, lambda d: quality_crf.score(d, field), lambda d: quality_crf.keep_good(d, quality_crf.learn(d, none))):
        assert f(empty).count() == 0
