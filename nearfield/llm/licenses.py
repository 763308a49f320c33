"""Licence notices, with DataFrame operations only.

All rolling word k-grams of a text are looked up among the k-grams of the templates. A hit of template place p
at word w lies on diagonal w - p: an unedited notice is one diagonal, an insertion or omission moves to a
neighbouring one. Hits are summed by diagonal, neighbouring diagonals are merged, and a merged run counts if it
covers enough of the template's words and no run of another label over the same words covers more of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import find_words, stable, word_array

K = 4
#: Diagonals at most this far apart belong to one place.
NEIGHBOUR = 6
#: Share of a template's words that a place must cover; one of fewer words than SHORT must be covered whole, as a word or two tell it from others.
COVERED, SHORT = 0.6, 10

#: The phrases of the contract and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Openings, conditions, disclaimers and reference lines of public licences, by label.
TEMPLATES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "licensed under the GNU General Public License, version 3"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-text", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("apache-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-text", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work"),
    ("gpl-text", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd-text", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-text", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-text", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("epl-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0"),
    ("cc-by-notice", "Licensed under CC BY 4.0"),
    ("cc-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def template_grams(spark: SparkSession, templates=None, k: int = K) -> DataFrame:
    """(template, label, n, place, gram, h): fixed by the list of templates, so its size is bounded."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        words = find_words(text)
        rows += [(t, label, len(words), p, words[p : p + k]) for p in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, n int, place int, gram array<string>")
    return grams.withColumn("h", F.expr(f"xxhash64({', '.join(f'xxhash64(gram[{i}])' for i in range(k))})"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, k: int = K) -> DataFrame:
    """One row per document: id, n_words, starts (sorted word places of the phrases), base_labels and labels
    (sorted arrays), spans (array of label, first and last word, covered share) and score.

    score is the largest covered share of a template; a text with a phrase but no template scores 0.5 at least.
    Null and empty texts have no words, no labels and score 0. Rows with equal ids stay apart.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    hashes = ", ".join(str(r[0]) for r in grams.select("h").distinct().collect()) or "null"  # fixed by the templates
    words = docs.select(F.col(id_col).alias("id"), word_array(F.col(text_col)).alias("w")).withColumn("hs", F.expr("transform(w, x -> xxhash64(x))"))
    none = "cast(array() as array<int>)"
    starts = []
    for label, phrase in PHRASES.items():
        parts = phrase.split()
        here = " and ".join(f"get(w, i + {j}) <=> '{p}'" for j, p in enumerate(parts))
        starts.append(f"if(array_contains(w, '{parts[-1]}') and size(w) >= {len(parts)}, filter(sequence(0, size(w) - {len(parts)}), i -> {here}), {none}) as at_{label}")
    window = f"xxhash64({', '.join(f'get(hs, i + {j})' for j in range(k))})"
    rows = words.selectExpr(
        "id", "cast(size(w) as long) as n_words", *starts,
        f"transform(filter(if(size(w) >= {k}, sequence(0, size(w) - {k}), {none}), i -> {window} in ({hashes})), i -> struct(i as at, slice(w, i + 1, {k}) as gram)) as hits",
    )
    rows = stable(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.at", "hit.gram")
    on = hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    by_diagonal = on.groupBy("row", "template", "label", "n", "diagonal").agg(
        F.min("at").alias("first"), (F.max("at") + F.lit(k - 1)).alias("last"), F.collect_set("place").alias("places")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True))
    runs = by_diagonal.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("row", "template", "label", "n", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    covered = F.size(F.expr(f"array_distinct(flatten(transform(places, p -> sequence(p, p + {k - 1}))))")) / F.col("n")
    kept = merged.withColumn("share", covered).where(F.col("share") >= F.when(F.col("n") < SHORT, 1.0).otherwise(COVERED))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "first", "last", "share", "n"))).alias("found"))
    # Of runs over the same words the one that covers most of its template wins, the longer template among equals.
    better = "exists(found, t -> t.label <> s.label and t.first <= s.last and s.first <= t.last and (t.share > s.share or t.share = s.share and t.n > s.n))"
    spans = spans.select("row", F.expr(f"transform(filter(found, s -> not {better}), s -> struct(s.label as label, s.first as first, s.last as last, s.share as share))").alias("spans"))
    spans = spans.withColumn("share", F.expr("array_max(transform(spans, s -> s.share))"))
    base = F.concat(*[F.when(F.size(f"at_{label}") > 0, F.array(F.lit(label))).otherwise(F.expr("cast(array() as array<string>)")) for label in PHRASES])
    out = rows.drop("hits").join(spans, "row", "left").withColumn("base_labels", F.array_sort(base))
    found = F.coalesce(F.expr("transform(spans, s -> s.label)"), F.expr("cast(array() as array<string>)"))
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.array_sort(F.concat(*[f"at_{label}" for label in PHRASES])).alias("starts"),
        "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", found))).alias("labels"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<label: string, first: int, last: int, share: double>>)")).alias("spans"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base_labels") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
