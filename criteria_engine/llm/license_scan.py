"""License scan by diagonal voting, with DataFrame functions only.

Texts and templates are cut into words. Every run of GRAM words of a text meets the runs of
the templates in a join on their 64-bit hash; the words of those that meet are compared. A
place p in the text and a place t in the template vote for the diagonal p - t: a template that
stands in the text unchanged has all its votes on one diagonal, one in which words were put in,
left out or changed has them on neighbouring ones. Neighbouring diagonals are merged to a span,
and a span is taken if enough of the template's words stand in it and enough of its own words
are the template's.

Phrases are templates that only count unchanged: all their votes on one diagonal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from criteria_engine.llm.tables import scratch, stored

GRAM = 3
# Diagonals further apart than this are different spans.
DRIFT = 8
# Parts of a template's words, and of a span's words, that must have met.
MIN_COVER, MIN_DENSITY = 0.8, 0.5
# Templates of more characters are not broadcast.
BROADCAST_CHARS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the contract, and license notices as their owners publish them.
PHRASES = {
    "mit": ["under the mit license"],
    "apache-2": ["apache license version 2"],
    "cc-by-nc": ["cc by nc"],
}
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "gpl-2": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

KEY = ["doc_id", "text_hash"]
PLACE = [*KEY, "template"]


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(rows: DataFrame, place: str) -> DataFrame:
    """One row per run of GRAM words: the other columns, its place, w0, w1 .. and their hash."""
    rest = [c for c in rows.columns if c != "words"]
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}") for i in range(GRAM)]
    exploded = rows.select(*rest, F.posexplode(F.arrays_zip(*shifted)).alias(place, "gram"))
    names = [f"w{i}" for i in range(GRAM)]
    whole = exploded.select(*rest, place, "gram.*").where(F.col(names[-1]).isNotNull())
    return whole.withColumn("hash", F.xxhash64(*names))


def _templates(spark: SparkSession, phrases: Mapping[str, Sequence[str]], notices: Mapping[str, Sequence[str]]) -> DataFrame:
    """template, label, is_phrase, n (words), t (place) and w0 .. with their hash, for every run of words."""
    given = [(label, text, kind is phrases) for kind in (phrases, notices) for label in sorted(kind) for text in kind[label]]
    made = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(is_phrase).alias("is_phrase"), words(F.lit(text)).alias("words"))
        for i, (label, text, is_phrase) in enumerate(given)
    ]
    rows = spark.range(1).select(F.explode(F.array(*made)).alias("row")).select("row.*")
    enough = F.when(F.size("words") < GRAM, F.raise_error(F.lit(f"a template has fewer than {GRAM} words")).cast("int"))
    grams = _grams(rows.withColumn("n", F.coalesce(enough, F.size("words"))), "t")
    return F.broadcast(grams) if sum(len(text) for _, text, _ in given) <= BROADCAST_CHARS else grams


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, text_hash, template, label, is_phrase, n, diagonal and the template's places `ts` that vote for it."""
    rows = docs.where("text <> ''").select(*KEY, words(F.col("text")).alias("words"))
    runs = _grams(rows, "p").alias("d")
    met = runs.join(templates.alias("t"), "hash")
    for i in range(GRAM):
        met = met.where(F.col(f"d.w{i}") == F.col(f"t.w{i}"))
    return met.groupBy(*PLACE, "label", "is_phrase", "n", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("ts")
    )


def _covered(starts: Column) -> Column:
    """How many words the runs at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + GRAM - 1)))))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans of notices: doc_id, text_hash, label, first_word, last_word, score.

    The score is the covered part of the template's words. Of spans that overlap, those with
    the most covered words stay, of equal ones those with the best score, so that a notice
    that contains or resembles another is not taken for it.
    """
    along = Window.partitionBy(*PLACE).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(False))
    merged = voted.where("not is_phrase").withColumn("span", F.sum(apart.cast("int")).over(along))
    in_text = F.transform("ts", lambda t: t + F.col("diagonal"))
    found = merged.groupBy(*PLACE, "label", "n", "span").agg(
        _covered(F.flatten(F.collect_list("ts"))).alias("covered"),
        _covered(F.flatten(F.collect_list(in_text))).alias("own"),
        F.min(F.array_min(in_text)).alias("first_word"),
        (F.max(F.array_max(in_text)) + GRAM - 1).alias("last_word"),
    )
    size = F.col("last_word") - F.col("first_word") + 1
    taken = found.where((F.col("covered") >= MIN_COVER * F.col("n")) & (F.col("own") >= MIN_DENSITY * size))
    taken = taken.withColumn("score", F.col("covered").cast("double") / F.col("n"))

    earlier = Window.partitionBy(*KEY).orderBy("first_word", "last_word", "template").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("first_word") > F.max("last_word").over(earlier), F.lit(False))
    upto = earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = taken.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("int")).over(upto))
    rank = F.rank().over(Window.partitionBy(*KEY, "island").orderBy(F.desc("covered"), F.desc("score")))
    return placed.withColumn("rank", rank).where("rank = 1").select(*KEY, "label", "first_word", "last_word", "score")


def scan(
    docs: DataFrame,
    phrases: Mapping[str, Sequence[str]] = PHRASES,
    notices: Mapping[str, Sequence[str]] = NOTICES,
) -> DataFrame:
    """The licenses that each document names, or whose notice it holds.

    Returns per row of `docs`: doc_id, n_words, n_base (places of phrases), first_word and
    last_word (their smallest and largest start, words from 0; null without one), base_labels
    and labels (distinct, sorted, joined by commas; `labels` also has those of notices), score
    (1 with a phrase, else the best covered part of a notice's words, else 0) and spans (label,
    first_word, last_word, score of each notice found, in text order). Null and empty texts
    have no words and no labels; repeated rows each have their result; rows may share a doc_id
    or have none; columns other than doc_id and text are ignored. A template of fewer than
    GRAM words is an error. Notices may be empty, phrases too, but not both.
    """
    if not any(map(len, (*phrases.values(), *notices.values()))):
        raise ValueError("no templates")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spark = docs.sparkSession
    # repeated rows vote for the same places, so they count once; stored, so that texts are cut once for both uses
    voted = stored(votes(rows, _templates(spark, phrases, notices)), scratch(spark))
    # a phrase stands where all its runs vote for one diagonal, its start
    named = voted.where(F.col("is_phrase") & (F.size("ts") == F.col("n") - GRAM + 1))
    named = named.select(*KEY, "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    held = spans(voted)
    none = F.lit(None).cast("int")
    nothing = F.lit(None).cast("struct<first_word:int,last_word:int,label:string,score:double>")
    span = F.struct("first_word", "last_word", "label", "score")
    both = named.select(*KEY, "label", "start", "score", F.col("label").alias("base"), nothing.alias("span")).unionByName(
        held.select(*KEY, "label", none.alias("start"), "score", F.lit(None).cast("string").alias("base"), span.alias("span"))
    )
    found = both.groupBy(*KEY).agg(
        F.count("start").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list("span")).alias("spans"),
    )
    counted = rows.select(*KEY, F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    kind = "array<struct<first_word:int,last_word:int,label:string,score:double>>"
    return counted.join(found.alias("f"), same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast(kind)).alias("spans"),
    )


def _plain(texts: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    return [(label, text.replace("'", "''")) for label in sorted(texts) for text in texts[label]]


def oracle(phrases: Mapping[str, Sequence[str]] = PHRASES, notices: Mapping[str, Sequence[str]] = NOTICES) -> str:
    """The same in DuckDB SQL over `documents`, on the words of the runs in place of their hashes."""
    given = [(label, text, kind) for kind, texts in (("true", phrases), ("false", notices)) for label, text in _plain(texts)]
    rows = ", ".join(f"({i}, '{label}', '{text}', {kind})" for i, (label, text, kind) in enumerate(given))
    cut = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    runs = ", ".join(f"w[i + {j}] as w{j}" for j in range(1, GRAM + 1))
    names = ", ".join(f"w{j}" for j in range(1, GRAM + 1))
    more = ", ".join(f"x + {j}" for j in range(GRAM))

    def covered(starts: str) -> str:
        return f"len(list_distinct(flatten(list_transform({starts}, lambda x: [{more}]))))"

    return f"""
    with given(template, label, text, is_phrase) as (values {rows}),
    tw as (select *, {cut} as w from given),
    tg as (
      select template, label, is_phrase, len(w) as n, i as t, {runs}
      from (select *, unnest(range(len(w) - {GRAM - 1})) as i from tw)
    ),
    dw as materialized (select row_number() over () as r, doc_id, {cut} as w from documents),
    dg as (select r, i as p, {runs} from (select *, unnest(range(len(w) - {GRAM - 1})) as i from dw where len(w) >= {GRAM})),
    voted as materialized (
      select r, template, label, is_phrase, n, p - t as diagonal, list_distinct(list(t)) as ts
      from dg join tg using ({names}) group by all
    ),
    named as (select r, label, diagonal as start from voted where is_phrase and len(ts) = n - {GRAM - 1}),
    steps as (
      select *, diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {DRIFT} as apart
      from voted where not is_phrase
    ),
    merged as (
      select *, count_if(coalesce(apart, false)) over (partition by r, template order by diagonal) as span,
             list_transform(ts, lambda t: t + diagonal) as ps
      from steps
    ),
    found as (
      select r, template, label, n, span, {covered("flatten(list(ts))")} as covered, {covered("flatten(list(ps))")} as own,
             min(list_min(ps)) as first_word, max(list_max(ps)) + {GRAM - 1} as last_word
      from merged group by r, template, label, n, span
    ),
    taken as (
      select *, covered::double / n as score from found
      where covered >= {MIN_COVER} * n and own >= {MIN_DENSITY} * (last_word - first_word + 1)
    ),
    opened as (
      select *, first_word > max(last_word) over (
        partition by r order by first_word, last_word, template rows between unbounded preceding and 1 preceding) as opens
      from taken
    ),
    islands as (
      select *, count_if(coalesce(opens, false)) over (
        partition by r order by first_word, last_word, template rows between unbounded preceding and current row) as island
      from opened
    ),
    held as (
      select r, label, score from islands
      qualify rank() over (partition by r, island order by covered desc, score desc) = 1
    ),
    both_ as (
      select r, label, start, 1.0::double as score, label as base from named
      union all select r, label, null, score, null from held
    ),
    per as (
      select r, count(start) as n_base, min(start) as first_word, max(start) as last_word,
             string_agg(distinct base, ',' order by base) as base_labels,
             string_agg(distinct label, ',' order by label) as labels, max(score) as score
      from both_ group by r
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
           first_word::bigint as first_word, last_word::bigint as last_word,
           coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
    from dw left join per using (r)
    """
