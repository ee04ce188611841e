"""License scans as an exact set-similarity join of text blocks with templates, with DataFrame functions only.

A text is cut into blocks of 2 * STRIDE words, one every STRIDE words, so that a run of up to STRIDE words lies whole in some block. A
template is a short phrase, all of whose words must be in the block (and then stand consecutively), or a notice, of whose distinct
words the block must have the share THRESHOLD. Words that no template has cannot count, so a block is its set of template words, in the
order of their counts over all documents, rarest first. Blocks and templates of m words that must share o meet on words among the first
m - o + 1 of the template and all but the last o - 1 of the block (prefix filter); blocks of fewer than o words do not meet it
(length filter), nor do those where too few words follow the shared one on either side (positional filter). A pair counts once, at its
first shared word, and the intersection decides. The templates are a fixed list, so their table is broadcast; no word, however
frequent, is a join key of a shuffle.

Defined results: a null or empty text has no words and no labels, and its score is 0; a text is scanned whole, whatever its length;
words that are equally frequent go by code points; rows are keyed by doc_id (null is a key too) and text, so repeated rows get the same
result each and texts that share a doc_id their own; extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words between the starts of blocks; no template may have more.
STRIDE = 32
THRESHOLD = 0.8
# Fixed value: what parts words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases, by label.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
# The opening sentences of public license notices, by label.
NOTICES = {
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: bool

    def __post_init__(self) -> None:
        if not 0 < len(self.words) <= STRIDE:
            raise ValueError(f"a template has 1 to {STRIDE} words: {' '.join(self.words)}")

    def shared(self, threshold: float) -> int:
        """Distinct words that a block must share with it."""
        m = len(set(self.words))
        return m if self.phrase else math.ceil(threshold * m - 1e-9)


def _words(text: str) -> Column:
    """The words, in lower case. The one sign beyond ASCII whose lower case is ASCII becomes another; all else beyond ASCII is in no template,
    so that its case does not matter. Words are what stands between separators: much faster than runs of a negated class."""
    plain = F.lower(F.replace(F.col(text), F.lit("\u212a"), F.lit("\u00e5")))
    return F.array_remove(F.split(plain, BETWEEN), "")


def templates() -> list[Template]:
    return [Template(k, tuple(t.split()), p) for p, texts in ((True, PHRASES), (False, NOTICES)) for k, t in texts.items()]


def word_order(docs: DataFrame, known: list[Template]) -> list[str]:
    """The words of the templates, rarest first by their counts over all documents. At most as many rows as they have words are collected."""
    own = sorted({w for t in known for w in t.words})
    counts = docs.select(F.explode_outer(_words("text")).alias("w")).where(F.col("w").isin(own)).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}
    return sorted(own, key=lambda w: (found.get(w, 0), w))


def _blocks(words: str, order: list[str], rare: list[str]) -> Column:
    """array<struct<block, words, known>>: the blocks that hold a word of some template's prefix, with their template words in order."""
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    starts = F.sequence(F.lit(0), F.call_function("div", F.size(words) - 1, F.lit(STRIDE)).cast("int"))
    starts = F.when(F.arrays_overlap(words, listed(rare)), starts).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda b: F.struct(b.alias("block"), F.slice(words, b * STRIDE + 1, F.lit(2 * STRIDE)).alias("words")))
    met = F.filter(cut, lambda x: F.arrays_overlap(x["words"], listed(rare)))
    return F.transform(met, lambda x: F.struct(x["block"].alias("block"), x["words"].alias("words"), F.array_intersect(listed(order), x["words"]).alias("known")))


def find(docs: DataFrame, known: list[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_words (on one row of each row of docs alone), block, template (its number), label, phrase, shared, size, places
    (starts of a phrase, each in one block alone): the blocks and the templates that they meet. A phrase whose words do not stand
    consecutively from the block's first STRIDE words is no row."""
    known = templates() if known is None else known
    order = word_order(docs, known)
    rank = {w: k for k, w in enumerate(order)}
    rows = [(None, -1, None, None, None, None, 0, 1, 0)]  # met by the row that tells the number of words
    for k, t in enumerate(known):
        words, o = sorted(set(t.words), key=rank.__getitem__), t.shared(threshold)
        rows += [(w, k, t.label, t.phrase, list(t.words), words, i, len(words), o) for i, w in enumerate(words[: len(words) - o + 1])]
    rare = sorted({r[0] for r in rows[1:]})
    schema = "token string, template int, label string, phrase boolean, text array<string>, set array<string>, i int, size int, need int"
    table = F.broadcast(docs.sparkSession.createDataFrame([("", *r[1:]) if r[0] is None else r for r in rows], schema))

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), _words("text").alias("w"))
    mark = F.array(F.struct(F.lit(-1).alias("block"), F.array().cast("array<string>").alias("words"), F.array(F.lit("")).alias("known")))
    blocks = base.select("doc_id", "text_hash", F.size("w").alias("n"), F.explode_outer(F.concat(_blocks("w", order, rare), mark)).alias("x")).select("doc_id", "text_hash", "n", "x.*")
    tokens = blocks.select("*", F.posexplode("known").alias("j", "token"))
    enough = (F.size("known") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("known") - F.col("j")) >= F.col("need"))
    met = tokens.join(table, "token").where(enough)
    marked = F.col("template") < 0
    both = F.array_intersect("known", "set")
    met = met.withColumn("both", F.when(~marked, both)).where(marked | ((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("token"))))
    starts = F.filter(F.sequence(F.lit(0), F.lit(STRIDE - 1)), lambda s: F.slice("words", s + 1, F.size("text")) == F.col("text"))
    met = met.withColumn("places", F.when(F.col("phrase"), F.transform(starts, lambda s: (s + F.col("block") * STRIDE).cast("long"))))
    met = met.where(marked | ~F.col("phrase") | (F.size("places") > 0))
    return met.select("doc_id", "text_hash", F.when(marked, F.col("n").cast("long")).alias("n_words"), "block", "template", "label", "phrase", F.size("both").alias("shared"), "size", "places")


def scan(docs: DataFrame, known: list[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template that a block has)."""
    met = find(docs, known, threshold)
    places = F.coalesce(F.size("places"), F.lit(0))
    listed = lambda kept: F.array_join(F.array_sort(F.collect_set(kept)), ",")
    rows = met.groupBy("doc_id", "text_hash").agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("phrase"), places)).alias("places"),
        F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max(F.col("shared") / F.col("size")).alias("score"),
    )
    rows = rows.withColumn("copy", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    n_base = F.coalesce(F.call_function("div", F.col("places"), F.col("copies")), F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", n_base.alias("n_base"), "first_word", "last_word", "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql() -> str:
    known = templates()
    values = ", ".join(f"({k}, '{t.label}', {t.phrase}, {list(t.words)!r}, {sorted(set(t.words))!r}, {t.shared(THRESHOLD)})" for k, t in enumerate(known))
    return rf"""
WITH t(k, label, phrase, words, distinct_words, need) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BETWEEN[1:]}'), []) AS w FROM documents),
blocks AS (SELECT doc_id, b, w[b * {STRIDE} + 1:(b + 2) * {STRIDE}] AS words FROM (SELECT doc_id, w, unnest(range((len(w) + {STRIDE - 1}) // {STRIDE})) AS b FROM d)),
met AS (
  SELECT doc_id, b, label, phrase, t.words, len(list_intersect(blocks.words, distinct_words)) AS shared, len(distinct_words) AS size, blocks.words AS own
  FROM blocks, t WHERE len(list_intersect(blocks.words, distinct_words)) >= need),
placed AS (SELECT *, CASE WHEN phrase THEN list_filter(range({STRIDE}), lambda s: own[s + 1:s + len(words)] = words) ELSE [0] END AS places FROM met),
kept AS (SELECT doc_id, label, phrase, shared / size AS share, b * {STRIDE} + list_min(places) AS a, b * {STRIDE} + list_max(places) AS z, len(places) AS n FROM placed WHERE len(places) > 0),
found AS (
  SELECT doc_id, sum(n) FILTER (phrase) AS n_base, min(a) FILTER (phrase) AS first_word, max(z) FILTER (phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM kept GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""


# Each pair of a block and a template is tried here.
OP13_SQL = _sql()
