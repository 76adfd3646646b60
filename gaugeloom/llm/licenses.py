"""Licence scans by sentence rules.

Native: DataFrame functions only.  A text is cut into passages at blank lines, also where a line has but comment marks, at `.`, `!`, `?`, `;` or `:` before white
space, and at a line's end before a line that begins as a known sentence does.  A passage is a sentence as a whole, over its
lines, if it is known; else each of its lines is one.  So sentences are found in texts that are wrapped or
commented, and in lines without a sign at their end.  A sentence is normalised: lower case, runs of other characters than letters and digits as one space.  Known sentences have identifiers;
the sentences of a text that are known, in order, are its identifier sequence.  Rules, tried in their order, are
sequences of identifiers; a rule matches where its identifiers follow one another in what earlier rules have
left, so a full licence text isn't also taken for its parts.  Sentences in between that aren't known don't matter.

SENTENCES and RULES are constants of this module and their number is the broadcast's bound; callers may give their own lists, in
which no sentence may have a cut within.

Null and empty texts, and texts without a known sentence, have no licence.  Repeated rows give one row each.
Only the named columns are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: identifiers of sentences that licences are made of, and the sentences
SENTENCES = [
    ("mit-short", "Released under the MIT License"),
    ("mit-short", "Licensed under the MIT License"),
    ("mit-short", "This project is licensed under the MIT License"),
    ("spdx", "SPDX-License-Identifier"),
    ("spdx-mit", "MIT"),
    ("spdx-apache", "Apache-2.0"),
    ("spdx-gpl3", "GPL-3.0-only"),
    ("spdx-gpl3-later", "GPL-3.0-or-later"),
    ("spdx-gpl2", "GPL-2.0-only"),
    ("spdx-bsd3", "BSD-3-Clause"),
    ("spdx-mpl2", "MPL-2.0"),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-short", "Licensed under the Apache License, Version 2.0"),
    ("apache-grant", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software"),
    ("gpl3-grant", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl2-version", "either version 2 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("lgpl-free", "This library is free software"),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl21-version", "either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl3-grant", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-grant", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("spdx-lgpl21", "LGPL-2.1-only"),
    ("spdx-agpl3", "AGPL-3.0-only"),
    ("spdx-epl2", "EPL-2.0"),
    ("spdx-isc", "ISC"),
    ("spdx-bsd2", "BSD-2-Clause"),
    ("bsd-use", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4", "Licensed under CC BY 4.0"),
    ("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]

# fixed values: rules in the order in which they are tried, a licence and the identifiers that make it
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-basis")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-grant", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-version", "gpl-hope")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-grant")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-grant")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl21-version")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-grant")),
    ("EPL-2.0", ("epl2-terms",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-grant")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-version")),
    ("Apache-2.0", ("apache-grant", "apache-comply")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-title",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MIT", ("spdx", "spdx-mit")),
    ("Apache-2.0", ("spdx", "spdx-apache")),
    ("GPL-3.0-only", ("spdx", "spdx-gpl3")),
    ("GPL-3.0-or-later", ("spdx", "spdx-gpl3-later")),
    ("GPL-2.0-only", ("spdx", "spdx-gpl2")),
    ("BSD-3-Clause", ("spdx", "spdx-bsd3")),
    ("MPL-2.0", ("spdx", "spdx-mpl2")),
    ("LGPL-2.1-only", ("spdx", "spdx-lgpl21")),
    ("AGPL-3.0-only", ("spdx", "spdx-agpl3")),
    ("EPL-2.0", ("spdx", "spdx-epl2")),
    ("ISC", ("spdx", "spdx-isc")),
    ("BSD-2-Clause", ("spdx", "spdx-bsd2")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("proprietary", ("reserved",)),
]

_CUT = r"[.!?;:]+(?=\s)|[.!?;:]+$"
_FIRST = "<text>"
#: Words of a known sentence by which a line that may begin one is told.
_BEGIN = 2


def _plain(text: Column) -> Column:
    """Lower case, line breaks kept, passages' ends as form feeds, other signs as spaces."""
    lowered = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\f\r", "  ")
    marked = F.regexp_replace(lowered, _CUT, "\f")
    lines = F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{N}\n\f]+", " "), r" ?([\n\f]) ?", "$1")
    return F.regexp_replace(lines, r"\n\n+", "\f")


def sentences_of(text: Column) -> Column:
    """Normalised sentences of a text in which each line's end is one, without empty ones."""
    return F.array_remove(F.split(F.trim(F.translate(_plain(text), "\f", "\n")), "\n"), "")


def passages_of(text: Column, begins: list[str]) -> Column:
    """Normalised passages, lines apart, without empty ones."""
    known = "|".join(begins)
    cut = F.regexp_replace(_plain(text), rf"\n(?=(?:{known})(?:[ \n\f]|$))", "\f") if begins else _plain(text)
    parts = F.transform(F.split(cut, "\f"), lambda p: F.btrim(p, F.lit(" \n")))
    return F.array_remove(parts, "")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """One row per document: key, n_sentences (each line's end ends one), identifiers (in order), rules (numbers from 1, in the order tried), licenses (sorted)."""
    spark = docs.sparkSession
    listed = spark.createDataFrame(sentences, "id string, sentence string")
    known = listed.select("id", F.explode(sentences_of(F.col("sentence"))).alias("normal"))
    begins = sorted({" ".join(r.normal.split(" ")[:_BEGIN]) for r in known.select("normal").collect()})  # of the given sentences
    whole = known.groupBy("normal").agg(F.min("id").alias("id")).unionByName(spark.range(1).select(F.lit(_FIRST).alias("normal"), F.lit("").alias("id")))

    cut = docs.select(key, F.xxhash64(F.col(text).cast("string")).alias("mark"), passages_of(F.col(text), begins).alias("passages"))
    lines = F.size(F.filter(F.split(F.array_join("passages", "\n"), "\n"), lambda x: x != "")).cast("bigint")
    # counted before the passages become rows, which else would each carry all of them
    counted = cut.withColumns({"n_sentences": lines, "passages": F.concat(F.array(F.lit(_FIRST)), "passages")})
    each = counted.select(key, "mark", "n_sentences", F.posexplode_outer("passages").alias("at", "passage"))  # never empty; outer, as Spark would else work passages out once more to see that
    of_lines = F.filter(F.transform(F.split("passage", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("normal"))), lambda x: x["normal"] != "")
    over_lines = F.array(F.struct(F.lit(0).alias("line"), F.translate("passage", "\n", " ").alias("normal")))
    tried = each.withColumn("tried", F.when(F.contains("passage", F.lit("\n")), F.concat(over_lines, of_lines)).otherwise(over_lines)).select(key, "mark", "n_sentences", "at", F.inline_outer("tried"))
    hit = tried.join(F.broadcast(whole), "normal")  # SENTENCES has a fixed number of rows
    per_doc = hit.groupBy(key, "mark", "n_sentences").agg(F.count_if(F.col("id") == "").alias("copies"), F.array_sort(F.collect_set(F.when(F.col("id") != "", F.struct("at", "line", "id")))).alias("found"))
    wholly = F.transform(F.filter("found", lambda x: x["line"] == 0), lambda x: x["at"])
    per_doc = per_doc.withColumn("found", F.filter("found", lambda x: (x["line"] == 0) | ~F.array_contains(wholly, x["at"])))
    named = per_doc.withColumn("identifiers", F.transform("found", lambda x: x["id"])).withColumn("left", F.concat(F.lit("|"), F.array_join(F.transform("identifiers", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")))
    for n, (_, ids) in enumerate(rules, 1):
        sequence = "".join(f"|{x}|" for x in ids)
        named = named.withColumn("left", F.replace("left", F.lit(sequence), F.lit(f"<{n}>")))
    numbers = F.transform(F.regexp_extract_all("left", F.lit(r"<(\d+)>"), 1), lambda x: x.cast("int"))
    names = F.array(*[F.lit(name) for name, _ in rules])
    out = named.withColumn("rules", F.array_sort(F.array_distinct(numbers))).withColumn("licenses", F.array_sort(F.array_distinct(F.transform("rules", lambda n: F.get(names, n - 1)))))
    return out.select(key, "n_sentences", "identifiers", "rules", "licenses", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"))


QUERIES = {"op5_licenses": op5_licenses}
