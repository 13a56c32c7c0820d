"""License scan by a positional index of rare words.

The index posts every word of the licence templates with its position. One pass over the texts finds which licence words
a file holds, and their places where the words of some template's mandatory phrase are all there; no other file can
match. IDF is counted over all files. For each file its own licence words with the highest IDF are looked up, and the
rarest word of each phrase that may be complete, so that no match can be lost; postings that agree on the relative
position of file and template are intersected to candidates. A candidate counts where the mandatory phrase stands at
that very place and enough of the template's words are in theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, text_or_empty, tidy

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that make a label wherever they stand.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed values: (label, mandatory phrase, words of the notice), from the public texts of the licences.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    (
        "apache",
        "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
    ),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    (
        "lgpl",
        "gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
    ),
    (
        "agpl",
        "gnu affero general public license",
        "it under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    (
        "cc-by",
        "creative commons attribution 4 0 international license",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    (
        "cc0",
        "cc0 1 0 universal",
        "to the extent possible under law the author has waived all copyright under cc0 1 0 universal public domain "
        "dedication",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license 2 0"),
    (
        "zlib",
        "altered source versions must be plainly marked as such",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software",
    ),
    (
        "unlicense",
        "released into the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
)

#: Licence words of a file with the highest IDF that are looked up for it.
LOOKED_UP = 8
#: Share of a template's words that must stand in place.
COVERAGE = 0.6


def _places(hits: str, phrase: str) -> Column:
    """Positions at which the words of ``phrase`` stand consecutively, from the licence words of a file in order."""
    words = phrase.split()

    def at(i: Column) -> Column:
        here = F.col(hits)
        ok = here[i]["word"] == words[0]
        for k, word in enumerate(words[1:], 1):
            ok = ok & (here[i + k]["word"] == word) & (here[i + k]["pos"] == here[i]["pos"] + k)
        return ok

    last = F.size(hits) - len(words)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.when(F.lit(0) <= last, at(i)).otherwise(False))
    return F.transform(starts, lambda i: F.col(hits)[i]["pos"])


@tidy
def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, looked_up: int = LOOKED_UP, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    Reads doc_id and text, ignores further columns. Null and empty texts have no words and no labels; repeated rows
    keep a row each; an empty table gives no row. ``score`` is the best share of a template's words in place, 1 where
    a base phrase stands; ``found`` lists the templates with place, label and share.
    """
    spark = docs.sparkSession
    phrases = [p for _, p, _ in templates] + [p for p, _ in base]
    lexicon = sorted({w for _, _, text in templates for w in text.split()} | {w for p in phrases for w in p.split()})
    # Lower-casing all letters keeps these words apart as lower-casing A-Z does, but for the Kelvin sign.
    text = F.lower(F.replace(text_or_empty(), F.lit("\u212a"), F.lit("\u0138")))
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words")
    )
    held = words.withColumn("held", F.array_intersect("words", F.array(*map(F.lit, lexicon))))
    complete = F.lit(False)
    for phrase in sorted({tuple(sorted(set(p.split()))) for p in phrases}):
        complete |= F.forall(F.array(*map(F.lit, phrase)), lambda w: F.array_contains("held", w))
    places = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(lexicon), F.struct(i.cast("int").alias("pos"), w.alias("word")))),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<struct<pos:int,word:string>>")
    slim = held.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "held", F.when(complete, places).otherwise(none).alias("hits"))
    slim = materialise(slim, "license-words")

    # A row per word of the lexicon at most.
    files = slim.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    (total,) = slim.agg(F.count("*")).first()
    idf = materialise(files.select("word", F.log((total + 1) / (F.col("files") + 1)).alias("idf")).coalesce(1), "license-idf")
    rarity = {x["word"]: x["idf"] for x in idf.collect()}
    postings, notices, needed = [], [], set()
    for number, (label, phrase, notice) in enumerate(templates):
        listed, must = notice.split(), phrase.split()
        start = next(i for i in range(len(listed)) if listed[i : i + len(must)] == must)
        key = min(range(len(must)), key=lambda k: (-rarity.get(must[k], math.inf), must[k], k))
        needed.add(must[key])
        notices.append((number, label, len(listed), len(must)))
        postings += [(word, number, at, start <= at < start + len(must), at == start + key) for at, word in enumerate(listed)]
    index = spark.createDataFrame(postings, "word string, template int, at int, must boolean, key boolean")
    notices = spark.createDataFrame(notices, "template int, label string, of int, musts int")

    candidates = slim.filter(F.size("hits") > 0)
    by_rarity = Window.partitionBy("row").orderBy(F.desc("idf"), "word")  # words of the lexicon
    chosen = (
        candidates.select("row", F.explode("held").alias("word"))
        .join(idf, "word")
        .withColumn("nth", F.row_number().over(by_rarity))
        .filter((F.col("nth") <= looked_up) | F.col("word").isin(sorted(needed)))
        .select("row", "word")
    )
    occurrences = candidates.select("row", F.explode("hits").alias("hit")).select("row", F.col("hit.pos").alias("pos"), F.col("hit.word").alias("word"))
    aligned = (
        occurrences.join(chosen, ["row", "word"])
        .join(index, "word")
        .groupBy("row", "template", (F.col("pos") - F.col("at")).alias("offset"))
        .agg(F.max("key").alias("key"))
        .filter("key")
    )
    # Every word of the template where it has to stand.
    expected = aligned.join(index.drop("key"), "template").select("row", "template", "offset", "must", "word", (F.col("offset") + F.col("at")).alias("pos"))
    verified = (
        expected.join(occurrences, ["row", "pos", "word"])
        .groupBy("row", "template", "offset")
        .agg(F.count("*").alias("n"), F.count_if("must").alias("n_must"))
        .join(notices, "template")
        .filter((F.col("n_must") == F.col("musts")) & (F.col("n") >= coverage * F.col("of")))
    )
    found = verified.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("offset", "label", (F.col("n") / F.col("of")).alias("share")))).alias("found"))

    def labelled(places: Column, label: str) -> Column:
        return F.transform(places, lambda x: F.struct(x.alias("pos"), F.lit(label).alias("label")))

    base_rows = slim.select("row", "doc_id", "n_words", F.concat(*(labelled(_places("hits", phrase), label) for phrase, label in base)).alias("base"))
    own, more = F.col("base.label"), F.coalesce(F.col("found.label"), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return base_rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.pos").cast("long").alias("first_word"),
        F.array_max("base.pos").cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, more)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
        "found",
    )
