"""Licence scan by sentence rules, with DataFrame functions only.

A text is cut into sentences (after ``. ! ? ; :`` and white space, and at empty lines); a
sentence that runs over several lines is looked up whole, in segments and line by line.
Segments end after lines of marks only (`` *``, ``#``), after lines that close a comment, and
after copyright lines, which often have no full stop before the text that follows. Sentences are
normalised: lower case, only ASCII letters and digits, one space between words. A copyright
notice with any holder and years is one sentence, and so is the clause on a holder's name. Known sentences have identifiers, and a
document's identifiers in order are its sequence; direct repetitions count once. A rule is a
list of identifiers; a licence is found where a rule's identifiers follow each other in the
sequence. Rules that are part of a longer rule found in the same document are dropped.

Only rows with a known sentence are shuffled. The tables of sentences and rules are fixed
values or the caller's, at most ``MOST_RULES`` each, which bounds their broadcast.

Null and empty texts have no sentences. Repeated rows of one id are scanned as one document.
A null id is one document. Documents without a known sentence give no rows, as does an empty
table. Very long texts are cut whole; extra columns, clashing names included, are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 50_000

# Sentences of common licence texts and notices, normalised by `normalised`.
SENTENCES = {
    1: "copyright notice",
    2: "all rights reserved",
    3: "licensed under the apache license version 2 0",
    4: "licensed under the apache license version 2 0 the license",
    5: "you may not use this file except in compliance with the license",
    6: "you may obtain a copy of the license at",
    7: "released under the mit license",
    8: "licensed under the mit license",
    9: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    10: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this program is free software",
    13: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    14: "either version 3 of the license or at your option any later version",
    15: "either version 2 of the license or at your option any later version",
    16: "licensed under cc by nc 4 0",
    17: "licensed under cc by 4 0",
    18: "licensed under cc by sa 4 0",
    19: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    20: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    21: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    22: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    23: "this work is licensed under a creative commons attribution 4 0 international license",
    24: "this source code form is subject to the terms of the mozilla public license v 2 0",
    25: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    26: "spdx license identifier mit",
    27: "spdx license identifier apache 2 0",
    28: "this is free and unencumbered software released into the public domain",
    29: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    30: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    31: "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    32: "this library is free software",
    33: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    34: "either version 2 1 of the license or at your option any later version",
    35: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    36: "spdx license identifier",
}

# Licence identifiers as they follow "SPDX-License-Identifier:".
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause",
    "BSD-3-Clause", "MPL-2.0", "ISC", "EPL-1.0", "EPL-2.0", "CC0-1.0", "Unlicense",
)
FIRST_SPDX = 100
SENTENCES |= {FIRST_SPDX + i: re.sub("[^a-z0-9]+", " ", name.lower()) for i, name in enumerate(SPDX)}

# Rule, licence, ordered identifiers.
RULES = (
    ("apache-notice", "Apache-2.0", (3,)),
    ("apache-header", "Apache-2.0", (4, 5, 6)),
    ("apache-spdx", "Apache-2.0", (27,)),
    ("mit-notice", "MIT", (7,)),
    ("mit-notice-2", "MIT", (8,)),
    ("mit-text", "MIT", (9, 10)),
    ("mit-spdx", "MIT", (26,)),
    ("gpl-3-notice", "GPL-3.0", (11,)),
    ("gpl-3-header", "GPL-3.0-or-later", (12, 13, 14)),
    ("gpl-3-header-2", "GPL-3.0-or-later", (12, 29)),
    ("gpl-2-header", "GPL-2.0-or-later", (12, 13, 15)),
    ("gpl-2-header-2", "GPL-2.0-or-later", (12, 30)),
    ("cc-by-nc", "CC-BY-NC-4.0", (16,)),
    ("cc-by", "CC-BY-4.0", (17,)),
    ("cc-by-text", "CC-BY-4.0", (23,)),
    ("cc-by-sa", "CC-BY-SA-4.0", (18,)),
    ("bsd-2", "BSD-2-Clause", (19, 20, 21)),
    ("bsd-3", "BSD-3-Clause", (19, 20, 21, 22)),
    ("bsd-3-full-stop", "BSD-3-Clause", (19, 20, 21, 31)),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", (32, 33, 34)),
    ("agpl-3-header", "AGPL-3.0-or-later", (12, 35)),
    ("mpl-2", "MPL-2.0", (24,)),
    ("isc", "ISC", (25,)),
    ("unlicense", "Unlicense", (28,)),
    ("reserved", "Proprietary", (2,)),
    ("reserved-notice", "Proprietary", (1, 2)),
)
RULES += tuple((f"spdx-{name.lower()}", name, (36, FIRST_SPDX + i)) for i, name in enumerate(SPDX))

#: ``copyright``, an optional ``c`` and years, then the holder.
COPYRIGHT = r"^copyright (c )?([0-9]{4} )+.*$"
#: The clause on names with any holder; one whose name has a full stop cuts it, its rest is sentence 31.
HOLDER = r"^neither the names? of .* nor the names of (its|the) contributors may "
ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors may "

_MARKS = r"[^\p{L}\p{N}\n]"
#: Lines that end a segment: marks only, copyright with sign or year, rights reserved, end of a comment.
BREAK = (
    rf"(?imd)^(?:{_MARKS}+|{_MARKS}*(?:c\) ?)?copyright(?:{_MARKS}*(?:c\b|[0-9]{{4}})|[ \t]*©)[^\n]*"
    rf"|[^\n]*all rights reserved{_MARKS}*|[^\n]*(?:\*/|-->)[ \t\r]*)$"
)


def normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(plain, COPYRIGHT, "copyright notice"), HOLDER, ANY_HOLDER)


def sentences(text: Column) -> Column:
    """Array of sentences, line breaks inside kept; ``\\u0002`` stands where a segment ends."""
    marked = F.regexp_replace(text, BREAK, "$0\u0002")
    return F.split(F.regexp_replace(marked, "([.!?;:])\u0002?\\s[\\s\u0002]*", "$1\u0001"), "\u0001|\n[\\s\u0002]*\n")


def pieces(sentence: Column) -> Column:
    """A sentence over several lines whole and in its segments; any other alone."""
    several = F.contains(sentence, F.lit("\n"))
    return F.when(several, F.concat(F.array(sentence), F.split(sentence, "\u0002"))).otherwise(F.array(sentence))


def sequences(spark: SparkSession, documents: DataFrame, known: dict[int, str] = SENTENCES, key: str = "doc_id") -> DataFrame:
    """``doc_id, found``: places and identifiers of known sentences, in order."""
    if len(known) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} sentences")
    table = spark.createDataFrame(list(known.items()), "id int, sentence string").coalesce(1)
    cut = documents.select(F.col(key).alias("doc_id"), F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    cut = cut.select("doc_id", "i", F.posexplode(pieces(F.col("s"))).alias("j", "s"))
    lines = F.when((F.col("j") > 0) & F.contains("s", F.lit("\n")), F.concat(F.array("s"), F.split("s", "\n"))).otherwise(F.array("s"))
    cut = cut.select("doc_id", "i", "j", F.posexplode(lines).alias("k", "s")).select("doc_id", "i", "j", "k", normalised(F.col("s")).alias("sentence"))
    hits = cut.join(F.broadcast(table), "sentence").distinct()
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "k", "id"))).alias("found"))


def licences(spark: SparkSession, documents: DataFrame, known: dict[int, str] = SENTENCES, rules: tuple = RULES, key: str = "doc_id") -> DataFrame:
    """``doc_id, rule, licence, n_sentences, first_sentence`` of every rule found in a document."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    table = [(name, licence, f",{','.join(map(str, ids))},", len(ids), ids[0]) for name, licence, ids in rules]
    table = spark.createDataFrame(table, "rule string, licence string, pattern string, n_sentences int, head int").coalesce(1)
    rows = sequences(spark, documents, known, key)
    once = F.filter("found", lambda x, i: (i == 0) | (x["id"] != F.get("found", i - 1)["id"]))
    rows = rows.select("doc_id", "found", F.concat(F.lit(","), F.array_join(F.transform(once, lambda x: x["id"].cast("string")), ","), F.lit(",")).alias("sequence"))
    rows = rows.select("doc_id", "found", "sequence", F.explode(F.array_distinct("found.id")).alias("head"))
    hits = rows.join(F.broadcast(table), "head").filter(F.contains("sequence", F.col("pattern")))
    first = F.array_min(F.transform(F.filter("found", lambda x: x["id"] == F.col("head")), lambda x: x["i"]))
    all_of = hits.groupBy("doc_id").agg(
        F.collect_list(F.struct("rule", "licence", "pattern", "n_sentences", first.alias("first_sentence"))).alias("all")
    )
    longest = F.filter(
        "all", lambda r: ~F.exists("all", lambda o: (o["n_sentences"] > r["n_sentences"]) & F.contains(o["pattern"], r["pattern"]))
    )
    return all_of.select("doc_id", F.inline(longest)).drop("pattern")
