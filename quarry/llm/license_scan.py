"""License scans by diagonal voting.

1. All rolling word k-grams of every text are hashed and joined to the places
   of the same k-grams in the license templates (a broadcast of fixed size:
   the templates are constants).  A hit is kept if the words are equal, not
   only their hashes.
2. A hit at word p of the text and word t of a template votes for the
   diagonal ``p - t``.  Votes are summed per text, template and diagonal.
3. Neighbouring diagonals (at most ``MAX_SHIFT`` apart: words put in or left
   out) are merged.
4. A merged span is verified: the template words that its hits cover must be
   at least ``MIN_COVER`` of the template, and it must not be much longer.

Short *phrases* are templates of their own (k = 2) that must stand whole on
one diagonal; they give the base labels.  *Notices* (k = 4) add labels of
license texts, also edited ones; a notice of fewer than four words (k = 2)
must stand whole.  The notices are a parameter; one of fewer than two words
has no k-gram and never matches.

Only hits and one row per text leave the scan, dealt by text; a text's hits
are bounded by its words.

Defined results: null and empty texts have no words, no places and score 0;
texts shorter than a k-gram have no hits; overlapping places all count;
repeated rows each give a row; an empty table gives none; only id and text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii, whole_text, words

# Fixed: a word is a run of ASCII letters and digits and of any non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The opening sentences of well-known license texts, with their labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
            "sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("all-rights-reserved", "All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

PHRASE_GRAM = 2
NOTICE_GRAM = 4
MAX_SHIFT = 3
MIN_COVER = 0.6
MAX_STRETCH = 1.5
DOCUMENT = -1  # the template of the one row that every text has besides its hits


def gram_key(k: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(k), *parts)


def template_words(text: str) -> list[str]:
    """A constant's words, by the rule of the texts."""
    import re

    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def templates(notices=NOTICES) -> list[tuple[int, str, bool, int, list[str]]]:
    """(number, label, is phrase, k, words) of every template."""
    out = [(label, True, PHRASE_GRAM, template_words(t)) for t, label in PHRASES.items()]
    for label, words_ in ((label, template_words(t)) for label, t in notices):
        out.append((label, False, NOTICE_GRAM if len(words_) >= NOTICE_GRAM else PHRASE_GRAM, words_))
    return [(i, *x) for i, x in enumerate(out)]


def template_places(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """(key, template, at, length, k, label, phrase, gram) of every k-gram of
    the templates, and the row that every text meets."""
    rows = [(n, label, phrase, k, w, i, w[i:i + k])
            for n, label, phrase, k, w in templates(notices) for i in range(len(w) - k + 1)]
    grams = spark.createDataFrame(
        [(n, i, len(w), k, label, phrase, g) for n, label, phrase, k, w, i, g in rows],
        "template int, at int, length int, k int, label string, phrase boolean, gram array<string>")
    key = F.when(F.col("k") == PHRASE_GRAM, gram_key(PHRASE_GRAM, *[F.get("gram", F.lit(i)) for i in range(PHRASE_GRAM)]))
    key = key.otherwise(gram_key(NOTICE_GRAM, *[F.get("gram", F.lit(i)) for i in range(NOTICE_GRAM)]))
    every = spark.range(1).select(
        gram_key(0, F.lit("document")).alias("key"), F.lit(DOCUMENT).alias("template"), F.lit(0).alias("at"),
        F.lit(0).alias("length"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("phrase"), F.array().cast("array<string>").alias("gram"))
    return grams.select(key.alias("key"), "template", "at", "length", "k", "label", "phrase", "gram").unionByName(every)


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """One row per text (template -1) and per verified hit, dealt by text:
    __row, ``id_col``, n_words, template, label, phrase, length, k, at, pos."""
    text = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col),
                       words(lower_ascii(whole_text(text_col)), WORD).alias("__w"))
    w, p = F.col("__w"), F.col("pos")
    keys = [gram_key(k, *[F.get(w, p + i) for i in range(k)]) for k in (PHRASE_GRAM, NOTICE_GRAM)]
    each = F.when(p < 0, F.array(gram_key(0, F.lit("document")))).otherwise(F.array(*keys))
    # pos -1 meets the row that every text has
    grams = (text.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.size(w) - 1)))
             .withColumn("key", F.explode(each)))
    places = F.broadcast(template_places(docs.sparkSession, notices))
    found = grams.join(places, "key").where(
        (F.col("template") == DOCUMENT) | (F.slice(w, p + 1, F.greatest(F.col("k"), F.lit(1))) == F.col("gram")))
    return found.select("__row", F.col(id_col), F.size(w).cast("long").alias("n_words"), "template", "label",
                        "phrase", "length", "k", "at", "pos").repartition("__row")


def spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Verified spans from hits: __row, ``id_col``, n_words, template, label,
    phrase, first (word), upto, cover (share of the template's words); and
    the row of template -1 of every text.  Nothing moves: hits are dealt by
    text already."""
    template = ["__row", id_col, "n_words", "template", "label", "phrase", "length", "k"]
    voted = found.groupBy(*template, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("at"), F.min("pos").alias("first"), (F.max("pos") + F.col("k")).alias("upto"))
    # places of one template lie side by side only if their diagonals do
    order = Window.partitionBy("__row", "template").orderBy("diagonal")
    exact = F.col("phrase") | (F.col("length") < NOTICE_GRAM)
    apart = exact | (F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT)
    groups = voted.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = groups.groupBy(*template, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.min("first").alias("first"), F.max("upto").alias("upto"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    checked = merged.withColumn("covered", F.when(F.col("template") == DOCUMENT, F.lit(0)).otherwise(covered))
    whole = exact & (F.col("covered") == F.col("length"))
    near = (~exact & (F.col("covered") >= F.col("length") * MIN_COVER)
            & (F.col("upto") - F.col("first") <= F.col("length") * MAX_STRETCH + MAX_SHIFT))
    return checked.where((F.col("template") == DOCUMENT) | whole | near).select(
        "__row", id_col, "n_words", "template", "label", "phrase", "first", "upto",
        (F.col("covered") / F.greatest("length", F.lit(1))).alias("cover"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_spans per row."""
    base = F.col("phrase")
    result = spans(hits(docs, id_col, text_col, notices), id_col).groupBy("__row", id_col, "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"), F.count(F.when(F.col("template") != DOCUMENT, 1)).alias("n_spans"))
    return result.drop("__row")


def sql() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = ",\n  ".join(f"({n}, '{label}', {phrase}, {k}, [{', '.join(repr(w) for w in words_)}])"
                          for n, label, phrase, k, words_ in templates())
    grams = " UNION ALL ".join(
        f"SELECT row_, {k} AS k, p, array_to_string(w[p:p + {k - 1}], ' ') AS gram "
        f"FROM (SELECT row_, w, unnest(range(1, len(w) - {k - 2})) AS p FROM docs)" for k in (PHRASE_GRAM, NOTICE_GRAM))
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
tpl(template, label, phrase, k, words) AS (VALUES
  {listed}),
places AS (
  SELECT template, label, phrase, exact, k, length, i - 1 AS at_, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, len(words) AS length, phrase OR len(words) < {NOTICE_GRAM} AS exact, unnest(range(1, len(words) - k + 2)) AS i FROM tpl)),
grams AS ({grams}),
hits AS (SELECT row_, template, label, phrase, exact, k, length, p - 1 AS pos, at_ FROM grams JOIN places USING (k, gram)),
voted AS (
  SELECT row_, template, label, phrase, exact, k, length, pos - at_ AS diagonal, list(at_) AS hit, min(pos) AS first_, max(pos) + k AS upto
  FROM hits GROUP BY row_, template, label, phrase, exact, k, length, diagonal),
opened AS (
  SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER o, {MAX_SHIFT + 1}) > {MAX_SHIFT} THEN 1 ELSE 0 END AS new
  FROM voted WINDOW o AS (PARTITION BY row_, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY row_, template ORDER BY diagonal) AS span FROM opened),
merged AS (
  SELECT row_, template, span, label, phrase, exact, k, length, list_distinct(flatten(list(hit))) AS hit, min(first_) AS first_, max(upto) AS upto
  FROM grouped GROUP BY row_, template, span, label, phrase, exact, k, length),
covers AS (SELECT *, len(list_distinct(flatten(list_transform(hit, lambda t: range(t, t + k))))) AS covered FROM merged),
found AS (
  SELECT * FROM covers WHERE (exact AND covered = length)
    OR (NOT exact AND covered >= length * {MIN_COVER} AND upto - first_ <= length * {MAX_STRETCH} + {MAX_SHIFT}))
SELECT any_value(d.doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words,
       count(*) FILTER (WHERE phrase) AS n_base, CAST(min(first_) FILTER (WHERE phrase) AS BIGINT) AS first_word,
       CAST(max(first_) FILTER (WHERE phrase) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(covered / length), 0.0) AS score, count(f.row_) AS n_spans
FROM docs d LEFT JOIN found f USING (row_) GROUP BY row_"""
