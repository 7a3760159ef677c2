"""Licence scans by diagonal voting.

All rolling word bigrams of all texts are hashed and joined to the positions that the same bigram
has in licence templates. A match at text position p and template position t votes for the diagonal
p - t. Each diagonal with votes is merged with the neighbours after it, which bridges inserted and
left-out words; a merged span that has enough of the template's bigrams is verified against the words
of the text that it covers. Every diagonal begins a span of its own, so stray partial matches before a
notice cannot hide it. A phrase of the base list is a template all of whose bigrams must stand on one
diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, small

# Phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices as their licences print or suggest them, lower case, words only.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-notice", "this work is licensed under the gnu general public license version"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-notice", "licensed under a creative commons attribution"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
)
#: Bigrams of these words alone are too common to vote for a notice; the notice is still verified whole.
COMMON = frozenset("the of and to a in is it for with or be by are on that this as at under you".split())
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Diagonals so far after one are merged with it: so many words may be inserted in a notice.
DRIFT = 8
#: Verified spans that begin so near to each other are one notice.
NEIGHBOUR = 3
#: Least share of a notice's voting bigrams, and of its words, that a span must have.
LEAST_VOTES, LEAST_WORDS = 0.6, 0.7
END = -1
#: Bits of a span's record of the template bigrams that it has.
BITS = 62


def words_of(text: F.Column) -> F.Column:
    """Words of a text: runs of a-z, 0-9 and anything beyond ASCII after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATOR), "")


def _templates(spark: SparkSession, notices: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """Voting bigrams (hash -> template positions) and templates (words, label, whether base).

    Each bigram has a bit of its own, so that a repeated one counts once; in a notice of over BITS
    bigrams neighbours share a bit, which can only let more spans through to verification.
    """
    grams, templates = [], []
    for k, (text, label, base) in enumerate([(t, lab, True) for t, lab in BASE] + [(t, lab, False) for lab, t in notices]):
        words = text.split()
        at = [i for i in range(len(words) - 1) if base or not {words[i], words[i + 1]} <= COMMON]
        bit = {i: n * BITS // max(len(at), BITS) for n, i in enumerate(at)}
        grams += [(words[i], words[i + 1], k, i, 1 << bit[i]) for i in at]
        templates.append((k, label, base, words, len(words), len(set(bit.values()))))
    table = spark.createDataFrame(grams, "a string, b string, template int, t int, bit long")
    table = table.select(F.xxhash64("a", "b").alias("g"), "template", "t", "bit").groupBy("g").agg(F.collect_list(F.struct("template", "t", "bit")).alias("at"))
    end = spark.range(1).select(F.lit(END).cast("long").alias("g"), F.array(F.struct(F.lit(END).alias("template"), F.lit(0).alias("t"), F.lit(0).cast("long").alias("bit"))).alias("at"))
    return table.unionByName(end), spark.createDataFrame(templates, "template int, label string, base boolean, t_words array<string>, t_len int, t_bits int")


def license_scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, start word, number of words, share of template words found). score is the
    largest share, 1 for a base phrase, 0 without a span. Null text has no words. Repeated rows get
    equal results each; a null doc_id is a document like any other. Whole texts are read, however
    long; columns other than doc_id and text are not read, whatever their names. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    grams, templates = _templates(spark, notices)
    # each text also sends one end mark, at the position after its last word, which carries its length
    w = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    bigrams = F.transform("words", lambda x, i: F.xxhash64(x, F.coalesce(F.get("words", i + 1), F.lit(""))))
    rolled = w.select("doc_id", "h", F.posexplode(F.concat(bigrams, F.array(F.lit(END).cast("long")))).alias("p", "g"))
    # the template table is a fixed list of some hundred rows
    votes = rolled.join(F.broadcast(grams), "g").select("doc_id", "h", "p", F.explode("at").alias("x"))
    votes = votes.groupBy("doc_id", "h", F.col("x.template").alias("template"), (F.col("p") - F.col("x.t")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.bit_or("x.bit").alias("bits"), F.min("p").alias("from"), F.max("p").alias("to")
    )
    votes = scratch.table(votes, "votes")
    # rows that repeat (doc_id, text) vote together: the number of end marks tells how many they are
    lengths = votes.filter(F.col("template") == END).select("doc_id", "h", F.col("diagonal").cast("long").alias("n_words"), F.col("votes").alias("copies"))

    per = votes.filter(F.col("template") >= 0).join(F.broadcast(templates), "template")
    # a notice's diagonals are merged with those up to DRIFT after them; base phrases stand on one diagonal
    merged = f"over (partition by doc_id, h, template order by diagonal range between current row and {DRIFT} following)"
    for name, f in (("bits", "bit_or"), ("from", "min"), ("to", "max")):
        per = per.withColumn(f"m_{name}", F.when(F.col("base"), F.col(name)).otherwise(F.expr(f"{f}(`{name}`) {merged}")))
    enough = F.bit_count("m_bits") >= F.when(F.col("base"), F.col("t_bits")).otherwise(LEAST_VOTES * F.col("t_bits"))
    reach = F.col("diagonal") + F.col("t_len")
    spans = per.filter(enough).select(
        "doc_id", "h", "template", "label", "base", "t_words", "diagonal", F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("m_from")).alias("start"),
        F.when(F.col("base"), reach).otherwise(F.least(F.col("m_to") + 2, reach + DRIFT)).alias("end"),
    )
    spans = scratch.table(spans, "spans")

    # verify: only texts with a candidate span are read again
    hit = scratch.table(spans.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).distinct(), "hit")
    again = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    again = again.join(small(hit, hit.count()), again.doc_id.eqNullSafe(hit.k_id) & (again.h == hit.k_h), "left_semi").dropDuplicates(["doc_id", "h"])
    again = again.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), words_of(F.col("text")).alias("words"))
    grouped = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("template", "label", "base", "t_words", "diagonal", "start", "end")).alias("s"))
    read = grouped.join(again, grouped.doc_id.eqNullSafe(again.k_id) & (grouped.h == again.k_h))
    seen = lambda x: F.slice("words", x["start"] + 1, x["end"] - x["start"])
    share = lambda x: F.when(x["base"], F.when(seen(x) == x["t_words"], 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(seen(x), x["t_words"])) / F.size(F.array_distinct(x["t_words"])))
    told = F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("template", "label", "base", "diagonal")], x["start"].cast("long").alias("start"), (x["end"] - x["start"]).cast("long").alias("words"), share(x).alias("share")))
    told = read.select("doc_id", "h", F.explode(F.filter(told, lambda x: x["share"] >= F.when(x["base"], 1.0).otherwise(LEAST_WORDS))).alias("x")).select("doc_id", "h", "x.*")
    # spans of one notice that begin close together are one: the best stays
    island = "partition by doc_id, h, template order by diagonal"
    told = told.withColumn("gap", F.expr(f"case when not base and diagonal - lag(diagonal) over ({island}) <= {NEIGHBOUR} then 0 else 1 end"))
    told = told.withColumn("island", F.expr(f"sum(gap) over ({island} rows between unbounded preceding and current row)"))
    best = F.max(F.struct("share", (-F.col("start")).alias("s"), "words"))
    told = told.groupBy("doc_id", "h", "template", "label", "base", "island").agg(best.alias("b"))
    span = F.struct("label", "base", (-F.col("b.s")).alias("start"), F.col("b.words").alias("words"), F.col("b.share").alias("share"))
    told = told.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct((-F.col("b.s")).alias("at"), span.alias("span")))).alias("s")).select("doc_id", "h", F.transform("s", lambda x: x["span"]).alias("spans"))
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda s: F.array_join(F.array_sort(F.array_distinct(F.transform(s, lambda x: x["label"]))), ",")
    told = told.select(
        F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"), F.transform("spans", lambda x: x.dropFields("base")).alias("spans"),
    )
    out = lengths.join(told, lengths.doc_id.eqNullSafe(told.t_id) & (lengths.h == told.t_h), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
