from reliefsignals.llm import licences, secrets


def test_rules_follow_the_order(spark):
    bsd = [licences.SENTENCES[i].capitalize() for i in (19, 20, 21, 22)]
    rows = [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0."),
        (2, "Copyright (c) 2019 A. Holder\nAll rights reserved."),
        (3, ". ".join(bsd) + "."),
        (4, ". ".join(bsd[:3]) + "."),
        (5, ". ".join(reversed(bsd)) + "."),
        (6, "a | table |\nReleased under the\n MIT License.\nReleased under the MIT License."),
        (7, None),
        (8, ""),
        (9, "All rights reserved. " * 500),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sentence string")
    found = {(r.doc_id, r.rule) for r in licences.licences(spark, docs).collect()}
    assert found == {(1, "apache-notice"), (2, "reserved-notice"), (3, "bsd-3"), (4, "bsd-2"), (6, "mit-notice"), (9, "reserved"), (None, "cc-by-nc")}
    assert licences.licences(spark, docs.limit(0)).count() == 0


MIT = """Copyright (c) 2019-2021 A. Holder, Inc
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Copyright (c) 2019, The Holder
All rights reserved

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """frob.c - a thing
Copyright (C) 2019  The Holder

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_published_headers_in_comments(spark):
    rows, want = [], set()
    for text, rule in ((MIT, "mit-text"), (BSD, "bsd-3"), (GPL, "gpl-3-header-2")):
        lines = text.split("\n")
        block = "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "*/\nint x;"
        for form in (text, block, block.replace("\n", "\r\n"), "\n".join(f"# {x}".rstrip() for x in lines), "\n".join(f"// {x}" for x in lines)):
            want.add((len(rows), rule))
            rows.append((len(rows), form))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.rule) for r in licences.licences(spark, docs).collect() if not r.rule.startswith("reserved")}
    assert found == want


def secret_rows():
    rows = []
    for i in range(300):
        hexes = f"{(i * 2654435761) % 2**32:08x}" * 5
        kind = (f'token = "{hexes}"', f"password={hexes[:18]}", f"write to user.{i}@mail{i % 9}.example.com", f"order {4000000000000000 + i * 7919} came", f"see chapter{i % 10}")[i % 5]
        rows.append((i, f"the river runs {kind} and the stone stays", "src/a" if i % 2 else None))
    return rows + [(900, None, "p"), (901, "", "p"), (None, "x password=aaaa1111bbbb22223c y", "p")]


def test_named_holders_and_other_families(spark):
    """A licence with a named holder is never taken for one with fewer clauses."""
    clause = "Neither the name of the copyright holder nor the names of its"
    assert clause in " ".join(BSD.split())
    plain = " ".join(BSD.split("\n\n", 1)[1].split()) if "\n\n" in BSD else " ".join(BSD.split())
    lgpl = (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
        "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    )
    agpl = (
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    )
    texts = [plain.replace(clause, f"Neither the name of {h} nor the names of its") for h in ("Google Inc.", "the University of X", "Foo, Ltd. Co.")]
    texts += [lgpl, agpl, "// SPDX-License-Identifier: GPL-2.0-only\npackage x", "# SPDX-License-Identifier: MIT", "MIT. Apache-2.0."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licences.licences(spark, docs).collect():
        found.setdefault(r.doc_id, set()).add(r.licence)
    found = {i: x - {"Proprietary"} for i, x in found.items()}
    assert found == {0: {"BSD-3-Clause"}, 1: {"BSD-3-Clause"}, 2: {"BSD-3-Clause"}, 3: {"LGPL-2.1-or-later"},
                     4: {"AGPL-3.0-or-later"}, 5: {"GPL-2.0-only"}, 6: {"MIT"}}


def test_forest_tells_secrets_from_false_positives(spark):
    docs = spark.createDataFrame([(*r, "k") for r in secret_rows()], "doc_id long, text string, source string, entry string")
    found = secrets.scan(docs).collect()
    by = {r.doc_id: r for r in found}
    assert set(by) == {None, *range(300)}
    assert all(by[i].is_secret == (i % 5 < 2) for i in range(300) if i % 5 < 4)
    assert by[None].is_secret


def test_without_labels_every_candidate_is_kept(spark):
    docs = spark.createDataFrame([(1, "password=abc12345", "p")], "doc_id long, text string, source string")
    assert [(r.is_secret, r.score) for r in secrets.scan(docs).collect()] == [(True, None)]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_announced_values_are_candidates_and_never_labelled_false(spark):
    rows = [
        "x password: CorrectHorseBattery y", "x token = abcdefghijklmnop y", "x secret =ab y", "x api_key := q y", "x {\"password\": \"abc\"} y",
        "x password=hunter42 y", "x password=12345678 y", "x password: 12345678 y", "x token = me@mail.example.com y",
    ]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    found = secrets.candidates(docs)
    values = {(r.doc_id, r.value) for r in found.collect() if r.announced}
    assert values == {
        (0, "CorrectHorseBattery"), (1, "abcdefghijklmnop"), (2, "ab"), (3, "q"), (4, "abc\"}"),
        (5, "hunter42"), (6, "12345678"), (7, "12345678"), (8, "me@mail.example.com"),
    }
    assert secrets.reviewed(found).count() == 0
    assert secrets.scan(docs).count() == len(rows)


def test_weak_announced_passwords_are_kept(spark):
    rows = secret_rows() + [(1000 + i, f"the river runs {t} and the stone stays", "src/a") for i, t in enumerate(("password=hunter42", "password=12345678"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.is_secret for r in secrets.scan(docs).collect()}
    assert found[1000] and found[1001]
