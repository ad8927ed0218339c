"""License scans: an exact set-similarity join of text blocks with license templates.

A template is the set of words of a notice.  A block is the set of words of a line, or of a run of
SPAN times the notice's words across line breaks, so that wrapped notices are found.  A block matches
when it holds at least the threshold's share of the template's words, `need` of them.  All words of
templates have one order, by their document frequency over all documents, rarest first; others
cannot match and leave a block.  Three filters come before the intersection:

* prefix: a template shows its first size - need + 1 words only, a block its first
  size - least need + 1; blocks and templates that match share one of these;
* length: a block has at least `need` words;
* position: with the first word in common at place p of a block, no more than size - p words of it
  can be shared, which must be `need` at least.

What remains is decided by exact intersection.  Base phrases are places where their words stand
consecutively.

Only DataFrame functions run.  The template table is a constant; blocks are only made of
documents with a prefix word, and equal blocks of a document are joined once.  Runs of words are
only tried for a template of which the whole document holds enough words, and begin at its words.

Defined results: null or empty text has no words, no labels and score 0.  A line's words are
runs of 0-9, a-z (of letters only A-Z are lower-cased) and characters beyond ASCII.  Rows that share
a doc_id share the labels found by templates; a null doc_id gets its base labels only.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices and their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8
#: Words of a run, in lengths of the notice: texts hold words that the notice has not.
SPAN = 2
WORD_GAP = "[\\x00-/:-`{-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """The words of a text, lower-cased, joined by one space."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), WORD_GAP, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(plain: Column, phrase: str) -> Column:
    """Where a phrase's words begin, as numbers of the words before: the text is cut before each
    place, and the spaces of the pieces so far are the words so far."""
    pieces = F.split(F.concat(F.lit("^ "), plain, F.lit(" ")), f"(?= {phrase} )")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    run = F.aggregate(pieces, start, lambda s, p: F.struct((s.n + _spaces(p)).alias("n"), F.concat(s.at, F.array(s.n)).alias("at")))
    return F.slice(run.at, F.lit(2), F.size(run.at))


def _needs(n: int, threshold: float) -> int:
    return max(1, -int(-n * threshold // 1))


def prefix_table(words: dict[str, list[str]], order: list[str], threshold: float) -> list[tuple]:
    """(label, word, size, need, notice): the prefix words of every template, in the order given."""
    rows = []
    for label, some in words.items():
        ordered, need = sorted(some, key=order.index), _needs(len(some), threshold)
        rows += [(label, w, len(some), need, some) for w in ordered[: len(some) - need + 1]]
    return rows


def candidates(blocks: DataFrame, prefix: DataFrame, least: int, by_place: bool = True) -> DataFrame:
    """(doc_id, block, label, size, need, notice) that pass the filters; a block's words are in order."""
    some = F.slice("block", F.lit(1), F.greatest(F.size("block") - (least - 1), F.lit(0)))
    probes = blocks.where(F.size("block") >= least).select("doc_id", "block", F.posexplode(some).alias("place", "word"))
    met = probes.join(F.broadcast(prefix), "word").where(F.size("block") >= F.col("need"))
    return (met.where(F.size("block") - F.col("place") >= F.col("need")) if by_place else met).drop("word", "place")


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); the score is the
    largest share of a template found in a block, 1 with a base phrase."""
    spark = docs.sparkSession
    # made by a generator, so that the optimiser does not repeat it in every expression that uses it
    texts = id_and_text(docs, id_col, text_col).select("doc_id", "text", F.explode(F.array(plain_words(F.col("text")))).alias("plain"))
    words = {label: sorted(set(notice.split())) for label, notice in templates}
    every = sorted({w for s in words.values() for w in s})

    # document frequency of the templates' words, over all documents: one row a word
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])
    held = texts.select(F.explode(F.array_intersect(F.split("plain", " "), literal(every))).alias("word"))
    df = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(every, key=lambda w: (df.get(w, 0), w))
    rows = prefix_table(words, order, threshold)
    prefix = spark.createDataFrame(rows, "label string, word string, size int, need int, notice array<string>")
    rare, least = sorted({r[1] for r in rows}), min(r[3] for r in rows)

    # blocks of the documents that hold a prefix word: the templates' words of a line, in order
    some = texts.where(F.col("doc_id").isNotNull() & F.arrays_overlap(F.split("plain", " "), literal(rare)))
    in_order = lambda line: F.array_intersect(literal(order), F.split(plain_words(line), " "))
    blocks = some.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), in_order))).alias("block"))
    common = F.size(F.array_intersect("block", "notice"))
    by_line = candidates(blocks, prefix, least).withColumn("common", common).where(F.col("common") >= F.col("need")).select("doc_id", "label", "common", "size")

    # runs of words across line breaks; a run that matches can begin at a word of the template
    span = {label: SPAN * len(notice.split()) for label, notice in templates}
    plans = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(len(s)).alias("size"), F.lit(_needs(len(s), threshold)).alias("need"), F.lit(span[label]).alias("span"), literal(s).alias("notice")) for label, s in words.items()])
    whole = some.where(F.contains("text", F.lit("\n"))).select("doc_id", F.split("plain", " ").alias("words")).withColumn("known", F.array_intersect("words", literal(every)))
    tried = whole.select("doc_id", "words", F.explode(F.filter(plans, lambda t: F.size(F.array_intersect("known", t.notice)) >= t.need)).alias("t")).select("doc_id", "words", "t.*")
    held = F.transform("words", lambda w, i: F.when(F.array_contains("notice", w), F.size(F.array_intersect(F.slice("words", i + 1, F.col("span")), "notice"))).otherwise(0))
    by_run = tried.withColumn("common", F.array_max(held)).where(F.col("common") >= F.col("need")).select("doc_id", "label", "common", "size")
    found = by_line.unionByName(by_run)
    found = found.groupBy("doc_id").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("share"))

    padded = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    has = {label: F.contains(padded, F.lit(f" {phrase} ")) for phrase, label in PHRASES}
    any_base = has["cc-by"] | has["gpl"] | has["reserved"]
    none = F.array().cast("array<int>")
    places = F.when(any_base, F.concat(*[F.when(has[label], _places(F.col("plain"), phrase)).otherwise(none) for phrase, label in PHRASES])).otherwise(none)
    base = texts.select(
        "doc_id",
        F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        places.alias("places"),
        F.array_compact(F.array(*[F.when(has[label], F.lit(label)) for _, label in sorted(PHRASES, key=lambda x: x[1])])).alias("base"),
    )
    out = base.join(found, "doc_id", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
