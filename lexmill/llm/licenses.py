"""License scans by diagonal voting, in DataFrame operations only.

Every run of K words of a text is joined, by hash and then word for word, to the places of the same run in the license
templates. A match of text word i with template word j votes for the offset diagonal i - j. Votes are summed by
diagonal, diagonals at most MERGE apart are merged (words inserted or left out move the offset), and a merged span is
verified: the share of the template's words that it covers, its length against the template's, and whether all of the
template's numbers and deciding words are covered, since licenses of one family differ in nothing else. Of verified
spans that overlap, the one that covers its template best and stretches it least stays, so a text with a word more than
a template goes to the template that has the word. A template marked as a phrase counts only where a single
diagonal holds all its words: there they stand consecutively.

A text is split once: a mark after its last word meets a template of its own and brings the text's size along.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.scratch import written

K, MERGE, COVER, STRETCH = 3, 4, 0.7, 1.5
#: template runs that may be broadcast; more are joined by a shuffle
BROADCAST_RUNS = 200_000
#: different words of templates, by place in a run, up to which texts are looked through for them first
LISTED_WORDS = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: number of the template that a text's end meets
SIZE = -1

#: fixed values: phrases whose places are counted, with their labels
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: notices of well-known public licenses, in words; whole texts are read by ``read_notices``
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("lgpl-2.1", "this work is licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-2", "this work is licensed under the gnu library general public license version 2"),
    ("lgpl-2", "it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license"),
]
#: fixed values: words that tell licenses apart or carry a grant; where a template has one, a span must cover it
DECIDING = {"affero", "lesser", "library", "sharealike", "noncommercial", "noderivatives", "granted", "permitted", "released"}


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a phrase, words); each has at least K words."""
    rows = [(label, True, words.split()) for label, words in phrases] + [(label, False, words.split()) for label, words in notices]
    if short := [" ".join(w) for _, _, w in rows if len(w) < K]:
        raise ValueError(f"a template needs at least {K} words: {short}")
    return [(n, *row) for n, row in enumerate(rows)]


def needed(words: list[str], phrase: bool) -> list[int]:
    """Places of a notice's numbers and deciding words; a phrase counts as a whole anyway."""
    return [] if phrase else [j for j, w in enumerate(words) if w.isdigit() or w in DECIDING]


def words_of(text) -> F.Column:
    """The words of a text column, with A-Z in lower case; null counts as empty."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")


def read_notices(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(label, words) of whole license texts: one file each, named after its label. They go to the driver, as templates do."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("label"), F.array_join(words_of(F.col("value")), " ").alias("words"))
    return sorted((r["label"], r["words"]) for r in files.collect())


def _runs(words) -> F.Column:
    """(p, r): each place with the K words from there; beyond the end they are null."""
    return F.posexplode(F.arrays_zip(*(F.slice(words, n, F.size(words)).alias(f"w{n}") if n > 1 else words.alias("w1") for n in range(1, K + 1)))).alias("p", "r")


def _template_runs(spark: SparkSession, rows: list) -> DataFrame:
    """(tid, label, phrase, size, need, j, t1..tK, h); need: places that a span must cover. The mark's row has one empty word."""
    made = [(n, label, phrase, words, len(words), needed(words, phrase)) for n, label, phrase, words in rows]
    made.append((SIZE, "", False, [""], 1, []))
    t = spark.createDataFrame(made, "tid int, label string, phrase boolean, words array<string>, size int, need array<int>")
    t = t.select("tid", "label", "phrase", "size", "need", _runs(F.col("words"))).filter(f"p <= size - {K} or tid = {SIZE}")
    t = t.select("tid", "label", "phrase", "size", "need", F.col("p").alias("j"), *(F.col("r")[f"w{n}"].alias(f"t{n}") for n in range(1, K + 1)))
    t = t.withColumn("h", F.xxhash64(*(f"t{n}" for n in range(1, K + 1))))
    return F.broadcast(t) if sum(len(w) for *_, w in rows) <= BROADCAST_RUNS else t


def _met(rows: list) -> F.Column:
    """Array of (i, w1..wK): the places in ``words`` from which each word stands at its place in a run of some template, and the end's mark.

    No other place can vote, so no other becomes a row. With very many different words all places are taken."""
    at = [{words[j + n] for *_, words in rows for j in range(len(words) - K + 1)} for n in range(K)]
    places, size = F.sequence(F.lit(0), F.size("words") - 1), F.size("words")
    if max(map(len, at)) <= LISTED_WORDS:
        may = lambda i: reduce(and_, (F.get("words", i + n).isin(sorted(own)) for n, own in enumerate(at)))
        places = F.filter(places, lambda i: (i == size - 1) | may(i))
    return F.transform(places, lambda i: F.struct(i.alias("i"), *(F.get("words", i + n).alias(f"w{n + 1}") for n in range(K))))


def _lines(docs: DataFrame, id_col: str, text_col: str, phrases, notices) -> DataFrame:
    """(id, digest, tid, label, phrase, size, need, diagonal, js, n): the votes by diagonal; for the mark, diagonal is the text's number of words and n the number of rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = templates(phrases, notices)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.concat(words_of(text), F.array(F.lit(""))).alias("words"))
    src = src.select("id", "digest", F.explode(_met(rows)).alias("r")).select("id", "digest", "r.*")
    src = src.withColumn("h", F.xxhash64(*(f"w{n}" for n in range(1, K + 1))))
    runs = _template_runs(docs.sparkSession, rows)
    same = [src["h"] == runs["h"], *(F.col(f"w{n}").eqNullSafe(F.col(f"t{n}")) for n in range(1, K + 1))]
    votes = src.join(runs, same).select("id", "digest", "tid", "label", "phrase", "size", "need", (F.col("i") - F.col("j")).alias("diagonal"), "j")
    return votes.groupBy("id", "digest", "tid", "label", "phrase", "size", "need", "diagonal").agg(F.collect_set("j").alias("js"), F.count("*").alias("n"))


def _spans(lines: DataFrame) -> DataFrame:
    """(id, digest, tid, label, phrase, first, last, cover): verified spans, in words from 0, last inclusive; of those that overlap, the best."""
    lines = lines.filter(f"tid <> {SIZE}")
    whole = lines.filter(F.col("phrase") & (F.size("js") == F.col("size") - (K - 1))).select("id", "digest", "tid", "label", "phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("cover"))
    by = Window.partitionBy("id", "digest", "tid").orderBy("diagonal")
    loose = lines.filter("not phrase").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= MERGE, 0).otherwise(1))
    loose = loose.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("js")), lambda j: F.sequence(j, j + (K - 1)))))
    merged = loose.groupBy("id", "digest", "tid", "label", "phrase", "size", "need", "span").agg(
        F.min(F.col("diagonal") + F.array_min("js")).alias("first"), F.max(F.col("diagonal") + F.array_max("js") + (K - 1)).alias("last"), covered.alias("covered")
    )
    merged = merged.withColumns({"cover": F.size("covered") / F.col("size"), "stretch": (F.col("last") - F.col("first") + 1) / F.col("size")})
    merged = merged.filter((F.col("cover") >= COVER) & (F.col("stretch") <= STRETCH) & (F.size(F.array_except("need", "covered")) == 0))
    along = Window.partitionBy("id", "digest").orderBy("first", "last", "tid")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    merged = merged.withColumn("new", F.when(F.col("first") <= reach - K, 0).otherwise(1))
    merged = merged.withColumn("place", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("id", "digest", "place").orderBy(F.desc("cover"), "stretch", F.desc("size"), "tid")
    merged = merged.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return whole.unionByName(merged.select("id", "digest", "tid", "label", "phrase", "first", "last", "cover"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(id, digest, tid, label, phrase, first, last, cover): the spans of ``scan_licenses``.

    digest is the text's hash: rows with equal id and text share their spans. Null and empty texts have none."""
    return _spans(written(_lines(docs, id_col, text_col, phrases, notices), "votes"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    Null and empty texts have no words and no labels; score is the largest share of a template that was found."""
    lines = written(_lines(docs, id_col, text_col, phrases, notices), "votes")
    base = F.col("phrase")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    found = _spans(lines).groupBy(F.col("id").alias("own"), F.col("digest").alias("sum")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.lit(True)).alias("labels"), F.max("cover").alias("score"),
    )
    texts = lines.filter(f"tid = {SIZE}").select("id", "digest", F.col("diagonal").cast("long").alias("n_words"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    out = texts.join(found, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("sum")), "left")
    return out.select("id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    values = ", ".join(f"({n}, '{label}', {str(phrase).lower()}, string_split('{' '.join(words)}', ' '), {needed(words, phrase)}::bigint[])" for n, label, phrase, words in templates())
    eq = " and ".join(f"d.words[d.i + {n}] = t.words[t.j + {n}]" for n in range(2, K + 1))
    return f"""
with t as (select tid, label, phrase, words, need, len(words) as size, unnest(range(0, len(words) - {K - 1})) as j from (values {values}) v(tid, label, phrase, words, need)),
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') as words from documents),
d as (select doc_id, words, unnest(range(0, len(words) - {K - 1})) as i from w where len(words) >= {K}),
lines as (select distinct doc_id, tid, label, phrase, size, need, i - j as diagonal, j from d join t on d.words[d.i + 1] = t.words[t.j + 1] and {eq}),
phrases as (select doc_id, label, true as phrase, diagonal as first, 1.0::double as cover from lines where phrase group by doc_id, tid, label, size, diagonal having count(*) = any_value(size) - {K - 1}),
marked as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, tid order by diagonal, j) <= {MERGE} then 0 else 1 end as new from lines where not phrase),
spans as (select *, sum(new) over (partition by doc_id, tid order by diagonal, j) as span from marked),
covered as (select doc_id, tid, label, size, need, span, min(diagonal + j) as first, max(diagonal + j) + {K - 1} as last, list_distinct(flatten(list(range(j, j + {K})))) as held from spans group by doc_id, tid, label, size, need, span),
verified as (select *, len(held) / size as cover, (last - first + 1) / size as stretch from covered where len(held) / size >= {COVER} and last - first + 1 <= {STRETCH} * size and len(list_filter(need, lambda x: not list_contains(held, x))) = 0),
parted as (select *, case when first <= max(last) over (partition by doc_id order by first, last, tid rows between unbounded preceding and 1 preceding) - {K} then 0 else 1 end as apart from verified),
places as (select *, sum(apart) over (partition by doc_id order by first, last, tid) as place from parted),
best as (select *, row_number() over (partition by doc_id, place order by cover desc, stretch, size desc, tid) as rank from places),
found as (select * from phrases union all select doc_id, label, false, first, cover from best where rank = 1),
per as (select doc_id, count(*) filter (where phrase) as n_base, min(first) filter (where phrase) as first_word, max(first) filter (where phrase) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (where phrase), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(cover) as score from found group by doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6)::double as score from w left join per using (doc_id)"""
