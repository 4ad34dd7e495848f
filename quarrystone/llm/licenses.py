"""Licence scans by a positional rare-token index, in DataFrame functions only.

The index holds, for each template's words with the highest inverse document frequency (counted over all documents), the
templates and places where they stand. These words of a file, all of them, are looked up; a posting at place p of a
template and a word at place w of the file point to a copy that begins at w - p. A template whose rare words agree about one
beginning is a candidate, and it counts if all of its mandatory key phrases stand in the file.

Texts are taken apart once: a written table holds every file's number of words and which licence words it has, and the
words in a line of the files that have a hint word, without which no key phrase and no phrase of the base can stand.

Base labels come from three fixed phrases and stay whatever the index says.

Defined cases: a null or empty text has no words and no labels, first_word and last_word null, score 0; texts are read
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read, written

#: The phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, template, mandatory key phrases; lower case, words between single spaces.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "associated documentation files"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license", "version 2 0", "in compliance with the license"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2 of the license"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "prior written permission"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "authors be held liable"]),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("cc0-1.0", "dedicated the work to the public domain by waiving all of his or her rights to the work", ["dedicated the work to the public domain"]),
]
#: Every template has one of these words in its key phrases, and every phrase of the base has.
HINTS = ("license", "permission", "redistribution", "cc", "creative", "unencumbered", "warranty", "dedicated")
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rarest words of a template that are looked up, and the share of those that stand in the file that must agree.
RARE, AGREE = 12, 0.5


def _line(text: Column) -> Column:
    """The words of a text, A-Z as a-z, between single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAP, " "))


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in a row: numbers of the first word, from 0."""
    parts = phrase.split()
    k = len(parts)
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for j in range(1, k):
            same = same & (F.get(words, i + j) == parts[j])
        return same

    return F.filter(starts, stands)


def taken_apart(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, h (a hash of the text), n_words, own (its licence words), line (its words, where one of them
    is a hint)."""
    names = sorted({w for _, t, phrases in TEMPLATES for w in " ".join([t, *phrases, *BASE]).split()})
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), _line(F.col("text")).alias("line"))
    rows = rows.withColumn("words", F.split("line", " "))
    rows = rows.select("doc_id", "h", "line", F.when(F.col("line") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"), F.array_intersect("words", F.array(*map(F.lit, names))).alias("own"))
    hinted = F.arrays_overlap("own", F.array(*map(F.lit, HINTS)))
    return written(rows.select("doc_id", "h", "n_words", "own", F.when(hinted, F.col("line")).alias("line")))


def document_frequencies(table: DataFrame) -> tuple[dict[str, int], int]:
    """How many documents hold each licence word, over all of them; as many numbers as there are licence words."""
    rows = table.select(F.explode(F.concat("own", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: int(r["n"]) for r in rows}
    total = counts.pop("", 0)
    return counts, total


def postings(counts: dict[str, int], total: int) -> list[tuple[str, int, int, list[str]]]:
    """The index: (word, template, place, the template's rare words), a fixed table of a few hundred rows."""
    rarity = lambda w: (-math.log((1 + total) / (1 + counts.get(w, 0))), w)
    rows = []
    for n, (_, template, _) in enumerate(TEMPLATES):
        rare = sorted(set(template.split()), key=rarity)[:RARE]
        rows += [(w, n, place, rare) for place, w in enumerate(template.split()) if w in rare]
    return rows


def licensed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score (0 to 1)."""
    table = taken_apart(docs)
    index = postings(*document_frequencies(table))
    padded = F.concat(F.lit(" "), F.col("line"), F.lit(" "))
    files = table.where("line is not null").select("doc_id", "h", F.split("line", " ").alias("w"), padded.alias("line")).dropDuplicates(["doc_id", "h"])
    holds = lambda p: F.contains(F.col("line"), F.lit(f" {p} "))
    empty = F.array().cast("array<int>")
    places = [F.when(holds(phrase), _places(F.col("w"), phrase)).otherwise(empty).alias(f"p{k}") for k, phrase in enumerate(BASE)]
    verified = F.filter(F.array(*[F.when(_all([holds(p) for p in phrases]), F.lit(n)) for n, (_, _, phrases) in enumerate(TEMPLATES)]), lambda x: x.isNotNull())
    words = sorted({w for w, *_ in index})
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(words))
    # small rows: of a file only places, hits and the numbers of the templates whose phrases stand in it
    files = written(files.select("doc_id", "h", *places, verified.alias("verified"), hits.alias("hits")))

    met = files.select("doc_id", "h", F.explode("hits").alias("hit")).select("doc_id", "h", "hit.word", "hit.at")
    met = met.join(F.broadcast(docs.sparkSession.createDataFrame(index, "word string, template int, place int, rare array<string>")), "word")
    begun = met.groupBy("doc_id", "h", "template", (F.col("at") - F.col("place")).alias("begin")).agg(F.collect_set("word").alias("agreeing"), F.first("rare").alias("rare"))
    best = begun.groupBy("doc_id", "h", "template").agg(F.max(F.size("agreeing")).alias("most"), F.size(F.array_distinct(F.flatten(F.collect_set("agreeing")))).alias("present"))
    candidates = best.where(F.col("most") / F.col("present") >= AGREE).groupBy(F.col("doc_id").alias("doc"), F.col("h").alias("hash")).agg(F.collect_list(F.struct("template", (F.col("most") / F.col("present")).alias("share"))).alias("candidates"))

    every = F.concat(*[f"p{k}" for k in range(len(BASE))])
    names = F.create_map(*[x for n, (label, _, _) in enumerate(TEMPLATES) for x in (F.lit(n), F.lit(label))])
    base_labels = F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(BASE.values())]), lambda x: x.isNotNull())
    found = files.join(candidates, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("hash")), "left")
    found = found.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), every.alias("every"), base_labels.alias("base"), F.filter("candidates", lambda c: F.array_contains("verified", c["template"])).alias("counted"))
    none = F.array().cast("array<string>")
    found = found.select(
        "id_", "h_", "every", "base", F.coalesce(F.transform("counted", lambda c: names[c["template"]]), none).alias("more"), F.coalesce(F.array_max(F.transform("counted", lambda c: c["share"])), F.lit(0.0)).alias("share")
    )
    both = table.select("doc_id", "h", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce("base", none), F.coalesce("more", none))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.round("share", 6), F.lit(0.0)))
    return both.select(
        "doc_id", "n_words", F.coalesce(F.size("every"), F.lit(0)).cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_sort(F.coalesce("base", none)).alias("base_labels"), labels.alias("labels"), score.alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licensed(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
