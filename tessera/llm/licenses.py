"""License scans as an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is ``BLOCK`` consecutive words, a new one every ``STRIDE`` words, so that any run of
``BLOCK - STRIDE + 1`` words lies in one block whole. A template of t distinct tokens is found in
a block that contains ``need = ceil(threshold * t)`` of them. Tokens are ordered by how many
documents have them, rarest first. Such a block must contain one of the template's
``t - need + 1`` rarest tokens (prefix filter), must have ``need`` template tokens at all (length
filter), and after the first token in common enough must be left on both sides (positional
filter). What passes is verified by intersection; phrases are then looked up word by word.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import words_of
from tessera.llm.scratch import cut

BLOCK, STRIDE = 40, 20


class Template(NamedTuple):
    """Words whose presence means ``label``: as a phrase, or as a share ``threshold`` of its distinct words in a block."""

    label: str
    words: str
    threshold: float = 0.8
    phrase: bool = False


#: Phrases that name a license.
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)
#: The notices by which works are put under a license.
NOTICES = (
    Template("gpl-notice", "this work is licensed under the gnu general public license version"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _begins(words: list[str]):
    """Whether the words stand at a place of the column ``words``."""
    return lambda i: F.slice("words", i + 1, F.lit(len(words))) == F.array(*(F.lit(x) for x in words))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per row of ``docs``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Base: the places
    where the words of a ``phrase`` template stand consecutively; ``first_word`` and ``last_word``
    are the smallest and largest of their starts (from 0, null without any). ``labels`` adds those
    of the other templates found. ``score`` is the largest share of a template found in a block.

    Templates have ``BLOCK - STRIDE + 1`` words at most. Null and empty texts have no words and
    score 0. Null ids are carried, rows that repeat an id are scanned on their own, and no other
    column is read.
    """
    spark = docs.sparkSession
    rules = [(k, t, t.words.split()) for k, t in enumerate(templates)]
    if any(len(w) > BLOCK - STRIDE + 1 for _, _, w in rules):
        raise ValueError(f"a template has over {BLOCK - STRIDE + 1} words")
    need = {k: ceil(round(t.threshold * len(set(w)), 9)) for k, t, w in rules}
    vocabulary = sorted({x for _, _, w in rules for x in w})
    literal = lambda xs: F.array(*(F.lit(x) for x in xs))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("present", F.array_intersect("words", literal(vocabulary)))
    enough = F.lit(False)
    for k, _, w in rules:
        enough = enough | (F.size(F.array_intersect("present", literal(sorted(set(w))))) >= need[k])
    scanned = cut(rows.select("row", "doc", F.size("words").cast("bigint").alias("n_words"), "present", F.when(enough, F.col("words")).alias("words")), "scanned")

    # The order: one count for each template token.
    df = {r["token"]: r["n"] for r in scanned.select(F.explode("present").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda x: (df.get(x, 0), x))
    place = {x: k for k, x in enumerate(order)}
    ranked = [(k, sorted({place[x] for x in w})) for k, _, w in rules]
    prefixes = [(k, r, p, ranks, need[k]) for k, ranks in ranked for p, r in enumerate(ranks[: len(ranks) - need[k] + 1])]
    probe = F.broadcast(spark.createDataFrame(prefixes, "template int, rank int, pt int, ranks array<int>, need int"))  # a few rows a template

    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 1, F.lit(0)), F.lit(STRIDE))
    cut_blocks = F.transform(starts, lambda b: F.struct(b.alias("at"), F.slice("words", b + 1, F.lit(BLOCK)).alias("words")))
    blocks = scanned.where("words is not null").select("row", F.explode(cut_blocks).alias("block")).select("row", "block.*")
    tokens = F.array_intersect("words", literal(order))
    own = F.array_sort(F.transform(tokens, lambda x: (F.array_position(literal(order), x) - 1).cast("int")))
    blocks = blocks.select("row", "at", "words", own.alias("own")).where("size(own) > 0")
    entries = blocks.select("row", "at", "words", "own", F.posexplode("own").alias("pb", "rank"))
    met = entries.join(probe, "rank").where("size(own) >= need and least(size(ranks) - pt, size(own) - pb) >= need")
    verified = met.withColumn("shared", F.size(F.array_intersect("own", "ranks"))).where("shared >= need")
    found = verified.groupBy("row", "at", "template").agg(F.first("words").alias("words"), F.max(F.col("shared") / F.size("ranks")).alias("share"))

    hits = F.array().cast("array<int>")
    for k, t, w in rules:
        if t.phrase:
            last = F.size("words") - len(w)
            here = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), _begins(w))
            hits = F.when((F.col("template") == k) & (last >= 0), here).otherwise(hits)
    label = F.element_at(literal([t.label for _, t, _ in rules]), F.col("template") + 1)
    phrase = F.element_at(literal([t.phrase for _, t, _ in rules]), F.col("template") + 1)
    found = found.select("row", "at", "template", "share", label.alias("label"), phrase.alias("phrase"), hits.alias("hits")).where("not phrase or size(hits) > 0")
    places = found.select("row", "template", "label", "phrase", "share", F.explode_outer(F.transform("hits", lambda i: i + F.col("at"))).alias("place")).distinct()
    per_row = places.groupBy("row").agg(
        F.countDistinct(F.when(F.col("phrase"), F.struct("template", "place"))).alias("n_base"),
        F.min("place").cast("bigint").alias("first_word"),
        F.max("place").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    out = scanned.select("row", "doc", "n_words").join(per_row, "row", "left")
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"))
