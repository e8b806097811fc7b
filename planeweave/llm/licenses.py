"""License scans: phrases, and an exact set-similarity join with license templates. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planeweave.plans.storage import materialize

WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, words of a notice); repeated words count once.
TEMPLATES = (
    ("agpl-3.0", "this program is licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_rows(templates, threshold: float) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words, how many of them a block needs, half the words of a block)."""
    out = []
    for label, text in templates:
        said = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        words = sorted(set(said))
        out.append((label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), 1 << max(0, len(said) - 1).bit_length()))
    return out


def _all_of(held: Column, words) -> Column:
    return F.size(F.array_intersect(held, F.array(*[F.lit(w) for w in words])))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z lower-cased. n_base counts the places where
    a phrase's words stand consecutively; first_word and last_word are the smallest and largest of their starts, null if
    none. Blocks run over line ends: for a template of up to h words, h the next power of two, the text is covered by blocks
    of 2h words, one from every hth word, so every run of h words lies in one. A block matches a template if it holds at
    least ``threshold`` of the template's distinct words. blocks lists (first word, template, containment) of every match.
    labels are those of phrases and templates, distinct, sorted, comma-joined, '' if none. score is 1 with a phrase, else the
    best containment of a match, else 0.

    One pass over the texts counts words and finds which template words each text holds; a text that holds too few of every
    template's words, and no phrase's, has no match. The join orders template words by the number of texts that hold them.
    A match holds one of the first ``n - need + 1`` words of its template, so only blocks with such a word come into
    question; pairs that share one are cut further by the number of template words in the block (length filter) and by where
    the shared word stands in both orders (positional filter), and the rest is verified. Null and empty texts have no words;
    repeated rows are scanned each; an empty table gives no rows. Templates are a parameter held in memory, never rows of a
    table.
    """
    spark = docs.sparkSession
    rows = template_rows(templates, threshold)
    vocabulary = sorted({w for _, words, _, _ in rows for w in words})
    spoken = sorted({w for p, _ in phrases for w in p.split()})
    either = sorted({*vocabulary, *spoken})

    # lower() may change what is outside A-Z: which words there are stays the same, and candidates are looked at exactly
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), text.alias("text"), F.split(F.lower(text), GAP, -1).alias("words"))
    edges = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    held = F.array_intersect("words", F.array(*[F.lit(w) for w in either]).cast("array<string>"))
    split = split.select("row_id", "doc_id", (F.size("words") - edges).cast("long").alias("n_words"), "text", held.alias("held"))
    maybe = F.lit(False)
    for words, need in [(w, n) for _, w, n, _ in rows] + [(p.split(), len(set(p.split()))) for p, _ in phrases]:
        maybe |= _all_of(F.col("held"), words) >= need
    scanned = materialize(split.select("row_id", "doc_id", "n_words", "held", F.when(maybe, F.translate("text", UPPER, LOWER)).alias("text")), "scanned")

    counts = {r.word: r.n for r in scanned.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [(label, sorted(rank[w] for w in ws), need, half) for label, ws, need, half in rows]
    candidates = scanned.where("text is not null").select("row_id", F.posexplode(_words(F.col("text"))).alias("at", "word"))
    spots = materialize(candidates.where(F.col("word").isin(either)), "spots")

    label, places = F.lit(None).cast("string"), spots.select("row_id", "at", "word")
    after = W.partitionBy("row_id").orderBy("at")
    for phrase, name in phrases:
        fits = F.lit(True)
        for k, w in enumerate(phrase.split()):
            fits &= F.col("word") == w if not k else (F.lead("word", k).over(after) == w) & (F.lead("at", k).over(after) == F.col("at") + k)
        label = F.when(fits, F.lit(name)).otherwise(label)
    places = places.select("row_id", "at", label.alias("label")).where("label is not null")
    base = places.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"), F.collect_set("label").alias("base"))

    ranks = spark.createDataFrame(list(rank.items()) or [("", -1)], "word string, rank int")
    halves = F.array(*[F.lit(h) for h in sorted({h for *_, h in ordered})]).cast("array<int>")
    tokens = spots.join(F.broadcast(ranks), "word").select("row_id", "at", "rank", F.explode(halves).alias("half"))
    block = F.call_function("div", F.col("at"), F.col("half"))
    tokens = tokens.select("row_id", "half", "rank", F.explode(F.array(block - 1, block)).alias("block")).where("block >= 0")
    blocks = tokens.groupBy("row_id", "half", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))
    prefix = [(label, half, len(r), need, i, r[i], r) for label, r, need, half in ordered for i in range(len(r) - need + 1)]
    index = spark.createDataFrame(prefix or [("", 0, 1, 2, 0, -1, [-1])], "label string, half int, n int, need int, i int, rank int, all array<int>")
    pairs = blocks.select("row_id", "half", "block", "held", F.posexplode("held").alias("j", "rank")).join(F.broadcast(index), ["half", "rank"])
    most = F.least("i", "j") + 1 + F.least(F.col("n") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    pairs = pairs.where((F.size("held") >= F.col("need")) & (most >= F.col("need")))
    overlap = F.size(F.array_intersect("held", "all"))
    matches = pairs.select("row_id", (F.col("block") * F.col("half")).alias("first"), "label", "need", (overlap / F.col("n")).alias("containment"), overlap.alias("overlap")).where("overlap >= need").distinct()
    found = matches.groupBy("row_id").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"),
        F.sort_array(F.collect_list(F.struct("first", "label", "containment"))).alias("blocks"),
    )

    none = F.array().cast("array<string>")
    base_labels, more = F.coalesce("base", none), F.coalesce("more", none)
    joined = scanned.select("row_id", "doc_id", "n_words").join(base, "row_id", "left").join(found, "row_id", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "blocks",
    )


def op3_prefix_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def _sql() -> str:
    templates = ", ".join(f"('{label}', {half}, {need}, [{', '.join(repr(w) for w in ws)}])" for label, ws, need, half in template_rows(TEMPLATES, THRESHOLD))
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{name}')" for p, name in PHRASES)
    return rf"""
with d as (select doc_id, row_number() over () as n, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select n, doc_id, t, regexp_extract_all(t, '{WORD}') as ws from d),
phrases(p, name) as (values {phrases}), templates(name, half, need, words) as (values {templates}),
spots as (select n, ws, unnest(range(len(ws))) as i from w),
places as (select n, i, name from spots join phrases on p[1] = ws[i + 1] and p = ws[i + 1 : i + len(p)]),
base as (select n, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct name) as names from places group by n),
tokens as (select n, i, ws[i + 1] as word, half from spots, (select distinct half from templates)),
held as (select n, half, b, list(distinct word) as h from (select n, half, word, i // half as b from tokens union all select n, half, word, i // half - 1 from tokens) where b >= 0 group by n, half, b),
hit as (select n, name, len(list_intersect(words, h)) as o, len(words) as size from held join templates using (half) where len(list_intersect(words, h)) >= need),
more as (select n, list(distinct name) as names, max(o / size) as best from hit group by n)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.names, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(more.names, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from w left join base using (n) left join more using (n)"""


SQL = _sql()
