"""License scans, in DataFrame operations only.

Two findings are put together. Base phrases are looked for word by word. Beside them an
exact set-similarity join finds every text block (line) that contains at least
``THRESHOLD`` of a template's distinct words: words of the templates are ordered by the
number of blocks that hold them, rare ones first, over all documents; a block and a template
can only reach the threshold if they share a word of both prefixes (prefix filter), the
block is long enough (length filter) and what follows that first shared word still
suffices (positional filter). What is left is counted exactly. A block never grows beyond
the templates' own words, and templates are a fixed, small table, so that nothing skewed is
shuffled.

Defined cases: a null text counts as empty: no words, labels are empty strings, the score is
0; blocks without template words match nothing; repeated rows (same id and text) get the same
labels; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

#: (label, phrase): fixed values.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: (label, template)
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 2 1"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a template's distinct words, in hundredths.
THRESHOLD = 90

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RAW_WORD = _RAW_GAP.replace("[", "[^", 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other characters never become ASCII, so words keep their bounds.

    Kelvin sign and dotted capital I are the two whose lower case would be ASCII.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), _GAP), lambda w: w != "")


def _needs(templates: list[tuple[str, str]], threshold: int) -> list[tuple[str, list[str], int]]:
    out = []
    for label, text in templates:
        words = list(dict.fromkeys(text.split()))
        out.append((label, words, -(-threshold * len(words) // 100)))
    return out


def _base(words: Column) -> Column:
    """struct<labels, starts>: base labels found and all start places."""

    def starts(parts: list[str]) -> Column:
        def here(i: Column) -> Column:
            return reduce(and_, [F.get(words, i + k) == p for k, p in enumerate(parts)])

        return F.filter(F.sequence(F.lit(0), F.size(words)), here)

    found = [(label, starts(phrase.split())) for label, phrase in PHRASES]
    return F.struct(
        F.array_compact(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for label, at in found])).alias("labels"),
        F.concat(*[at for _, at in found]).alias("starts"),
    )


def scan_blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], shortest: int) -> DataFrame:
    """One pass over the texts: word counts, base findings and the template words of every block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    maybe = F.regexp_like("_t", F.lit(f"(?i)license|cc{_RAW_GAP}by"))
    d = docs.select(F.col(id_col), text.alias("_t"))
    vocab = F.array(*map(F.lit, vocabulary))
    blocks = F.transform(F.split(F.col("_t"), "\n"), lambda b: F.array_intersect(F.split(lower_ascii(b), _GAP), vocab))
    d = d.select(
        id_col,
        F.xxhash64("_t").alias("_th"),
        F.regexp_count("_t", F.lit(_RAW_WORD)).cast("bigint").alias("n_words"),
        F.when(maybe, _words(F.col("_t"))).otherwise(F.array().cast("array<string>")).alias("_w"),
        blocks.alias("_b"),
    )
    return d.select(
        id_col, "_th", "n_words", _base(F.col("_w")).alias("_base"), F.flatten("_b").alias("_tokens"), F.filter("_b", lambda b: F.size(b) >= shortest).alias("_blocks")
    )


def matches(scanned: DataFrame, id_col: str, needs: list[tuple[str, list[str], int]]) -> DataFrame:
    """(id, _th, block, label, containment) of every block and template at the threshold."""
    spark = scanned.sparkSession
    counted = scanned.select(F.explode("_tokens").alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in counted.collect()}  # at most one row per template word
    order = sorted({w for _, words, _ in needs for w in words}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for i, (label, words, need) in enumerate(needs):
        ranks = sorted(rank[w] for w in words)
        rows += [(token, i, label, at, need, ranks) for at, token in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(rows, "token int, template int, label string, t_at int, need int, t_ranks array<int>")

    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    shortest = min(need for _, _, need in needs)
    b = scanned.select(id_col, "_th", F.posexplode("_blocks").alias("block", "words"))
    b = b.withColumn("ranks", F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w))))
    b = b.select(id_col, "_th", "block", "ranks", F.posexplode(F.slice("ranks", 1, F.size("ranks") - shortest + 1)).alias("b_at", "token"))
    left = F.least(F.size("ranks") - F.col("b_at"), F.size("t_ranks") - F.col("t_at"))
    # The table of templates is a constant of the program: some dozens of rows.
    pairs = b.join(F.broadcast(prefixes), "token").filter((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    pairs = pairs.filter(shared >= F.col("need")).withColumn("containment", shared / F.size("t_ranks"))
    return pairs.select(id_col, "_th", "block", "template", "label", "containment")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    needs = _needs(templates, threshold)
    scratch = Scratch(docs.sparkSession, "license")
    vocabulary = sorted({w for _, words, _ in needs for w in words})
    scanned = scratch.save(scan_blocks(docs, id_col, text_col, vocabulary, min(n for _, _, n in needs)), "scanned")
    found = matches(scanned, id_col, needs).groupBy(F.col(id_col).alias("_id"), F.col("_th").alias("_mth"))
    found = found.agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_score"))
    out = scanned.drop("_tokens", "_blocks").join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_mth")), "left")
    none = F.array().cast("array<string>")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.col("_base.starts")
    return out.select(
        id_col,
        "n_words",
        F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        joined(F.col("_base.labels")).alias("base_labels"),
        joined(F.concat("_base.labels", F.coalesce("_labels", none))).alias("labels"),
        F.greatest(F.when(F.size(starts) > 0, 1.0).otherwise(0.0), F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row for each row of documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    word = _GAP.replace("[", "[^", 1)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    starts, labels = [], []
    for label, phrase in PHRASES:
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(), 1))
        starts.append(f"list_filter(range(len(w)), lambda i: {test})")
        labels.append(f"CASE WHEN len({starts[-1]}) > 0 THEN '{label}' END")
    templates = ", ".join(f"('{label}', [{', '.join(f"'{w}'" for w in words)}], {need})" for label, words, need in _needs(TEMPLATES, THRESHOLD))
    joined = "coalesce(array_to_string(list_sort(list_distinct({})), ','), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{word}') AS w, {low} AS t FROM documents),
b AS (SELECT r, doc_id, w, list_concat({", ".join(starts)}) AS starts, list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS base FROM d),
m AS (SELECT r, label, len(list_intersect(list_distinct(regexp_extract_all(line, '{word}')), words)) AS n, len(words) AS size, need
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d), (VALUES {templates}) v(label, words, need)),
g AS (SELECT r, list(label) AS found, max(n / size) AS score FROM m WHERE n >= need GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word,
       CAST(list_max(starts) AS BIGINT) AS last_word, {joined.format("base")} AS base_labels,
       {joined.format("list_concat(base, coalesce(found, []))")} AS labels,
       greatest(CASE WHEN len(starts) > 0 THEN 1.0 ELSE 0.0 END, coalesce(score, 0))::DOUBLE AS score
FROM b LEFT JOIN g USING (r)"""
