"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are short licence passages, each with a mandatory key phrase; the base phrases are templates that are key
phrase and nothing else. One pass over the texts takes from each the licence words (words of a template that are no
``COMMON`` words, and all words of key phrases) with their positions; all later steps work on these hits.

1. A licence word's IDF comes from the documents of the whole corpus.
2. The index holds, for each template, postings (template, position) of its words of highest IDF, just so many that
   the other words cannot reach the template's ``SHARE`` of weight without one of them; of a key phrase the rarest word
   is enough. So a passage that counts is always looked up: nothing is lost to the choice of words.
3. The licence words of a file that stand in the index are looked up. For the templates found so, the postings of all the
   file's hits are intersected by relative position: (template, place where its first word would stand).
4. An alignment counts if the weight of the words in place is at least ``SHARE`` of the template's, and if the words of
   the key phrase all stand, one behind the other. Base phrases are key phrase throughout: their places are exact.

``score`` is the largest share among the alignments that count; a base phrase alone gives ``BASE_SCORE``, nothing 0.

Null and empty texts have no words, no labels and score 0. Very long texts are read whole; their hits become rows of
their own, so no step holds more than one text. Overlapping places all count; ties in IDF go to the smaller word. Repeated
rows and ids each get their own row (rows are told apart by a number in a written table); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts, fold

#: Fixed value: what parts words, once A-Z are lower-cased.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Label, passage as published with the licence, and the phrase in it that must stand.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Words that tell nothing of a licence; they count in key phrases only.
COMMON = set("a an and are any as at be by can for from in into is it may not of on or the this to under use with you".split())
#: Weight in place, of a template's whole, from which an alignment counts.
SHARE = 0.6
BASE_SCORE = 0.5


class Templates:
    """Templates as lists of (position, word, mandatory); the base phrases come first."""

    def __init__(self, templates: list[tuple[str, str, str]], base: list[tuple[str, str]]):
        self.labels, self.words, self.n_base = [], [], len(base)
        for label, passage, phrase in [(a, b, b) for a, b in base] + templates:
            whole, key = passage.split(), phrase.split()
            at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
            inside = range(at, at + len(key))
            self.labels.append(label)
            self.words.append([(i, w, i in inside) for i, w in enumerate(whole) if i in inside or w not in COMMON])
        self.vocabulary = sorted({w for t in self.words for _, w, _ in t})

    def postings(self, idf: dict[str, float]) -> list[list[tuple[int, int, float, int, bool]]]:
        """By word number: (template, position, share of weight, 1 if mandatory, whether the index holds it)."""
        number = {w: i for i, w in enumerate(self.vocabulary)}
        out: list[list] = [[] for _ in number]
        for t, words in enumerate(self.words):
            total = sum(idf[w] for _, w, _ in words)
            rarest = sorted({w for _, w, _ in words}, key=lambda w: (-idf[w], w))
            rare, left = set(), 1.0
            for w in rarest:  # what is left out of the index must not reach SHARE by itself
                if left < SHARE - 1e-9:
                    break
                rare.add(w)
                left -= sum(idf[v] for _, v, _ in words if v == w) / total
            key = max((w for _, w, m in words if m), key=lambda w: (idf[w], w))
            rare = {key} if len(rare) > 1 else rare  # the key phrase must stand whole: its rarest word is enough
            for at, w, must in words:
                out[number[w]].append((t, at, idf[w] / total, int(must), w in rare))
        return out


KNOWN = Templates(TEMPLATES, BASE)


def hits(docs: DataFrame, known: Templates, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_words and the licence words (number, position) of each text."""
    words, listed = F.col("words"), ", ".join(f"'{w}'" for w in known.vocabulary)
    lead = F.when(words[0] == "", 1).otherwise(0)
    tail = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    found = F.expr(
        f"filter(transform(words, (w, i) -> if(w in ({listed}), named_struct('w', int(array_position(array({listed}), w) - 1), 'at', i), null)), x -> x is not null)"
    )
    return (
        docs.select(docs[doc_id].cast("bigint").alias("doc_id"), fold(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("folded"))
        .select("doc_id", F.split("folded", BREAKS, -1).alias("words"))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id", (F.size(words) - lead - tail).cast("bigint").alias("n_words"),
            lead.alias("lead"), found.alias("hits"),
        )
    )


def frequencies(rows: DataFrame, known: Templates) -> dict[str, float]:
    """IDF of each licence word over the whole corpus; as many numbers as the templates have words."""
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    held = {r.w: r["count"] for r in df.collect()}
    return {w: math.log(1 + n / (held.get(i, 0) + 1)) if n else 1.0 for i, w in enumerate(known.vocabulary)}


def _literal(postings: list[list[tuple]], only_rare: bool) -> Column:
    """The postings by word number as one constant."""
    entry = lambda p: {"t": p[0], "at": p[1], "share": p[2], "must": p[3]}
    held = json.dumps([[entry(p) for p in ps if p[4] or not only_rare] for ps in postings])
    return F.from_json(F.lit(held), "array<array<struct<t:int,at:int,share:double,must:int>>>")


def align(rows: DataFrame, known: Templates, postings: list[list[tuple]]) -> DataFrame:
    """row, template, place and share of each alignment that counts."""
    index, whole = _literal(postings, True), _literal(postings, False)
    # the templates that a file's indexed words look up; files without any are done
    looked = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.get(index, h["w"])["t"])))
    placed = (
        rows.where(F.size("hits") > 0).select("row", "lead", "hits", looked.alias("looked")).where(F.size("looked") > 0)
        .select("row", "lead", "looked", F.explode("hits").alias("h"))
        .select("row", "lead", "looked", F.col("h.at").alias("at"), F.explode(F.get(whole, F.col("h.w"))).alias("p"))
        .where(F.array_contains("looked", F.col("p.t")))
        .select("row", F.col("p.t").alias("template"), (F.col("at") - F.col("lead") - F.col("p.at")).cast("bigint").alias("place"), "p.share", "p.must")
    )
    musts = F.from_json(F.lit(json.dumps([sum(m for _, _, m in t) for t in known.words])), "array<int>")
    return (
        placed.groupBy("row", "template", "place").agg(F.sum("share").alias("share"), F.sum("must").alias("must"))
        .where((F.col("must") == F.get(musts, F.col("template"))) & (F.col("share") >= SHARE - 1e-9))
        .select("row", "template", "place", F.least("share", F.lit(1.0)).alias("share"))
    )


def scan(docs: DataFrame, known: Templates = KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, base places, base_labels, labels and score."""
    cuts = Cuts(docs.sparkSession, "license-scan")
    rows = cuts.write(hits(docs, known, doc_id, text), "hits")
    labels = F.from_json(F.lit(json.dumps(known.labels)), "array<string>")
    base = F.col("template") < known.n_base
    found = (
        align(rows, known, known.postings(frequencies(rows, known)))
        .withColumn("label", F.get(labels, F.col("template")))
        .groupBy("row").agg(
            F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("place"))).alias("first_word"),
            F.max(F.when(base, F.col("place"))).alias("last_word"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
            F.max(F.when(base, F.lit(BASE_SCORE)).otherwise(F.col("share"))).alias("score"),
        )
    )
    return rows.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
