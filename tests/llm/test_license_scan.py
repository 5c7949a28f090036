import re

from pickflow.llm import license_scan
from pickflow.llm.queries import op3_license_scan


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_license_scan(spark, sf).collect()
    found = {(r.doc_id, r.license) for r in got if r.confirmed}
    want = {(i, name) for i, t in docs.items() for name, text in license_scan.TEMPLATES if text in t.split("\n")}
    assert want and want <= found
    assert {i for i, _ in found} <= {i for i, t in docs.items() if re.search(license_scan.CUE, t or "")}
    for r in got:
        block = docs[r.doc_id][r.begin : r.begin + r.length]
        assert re.search(license_scan.CUE, block) and block == block.strip()
        assert (r.license, r.bytes_alone, r.bytes_saved, r.differences, r.confirmed) == license_scan.Scanner().best(block)


def confirmed(spark, make_docs, *texts):
    return {(r.doc_id, r.license) for r in license_scan.scan(make_docs(*texts)).collect() if r.confirmed}


def test_each_template_and_small_changes(spark, make_docs):
    texts = [f"Some words before it.\n{t}\nand after" for _, t in license_scan.TEMPLATES] + [f"Here it says so. {t.upper()} And more" for _, t in license_scan.TEMPLATES]
    names = [n for n, _ in license_scan.TEMPLATES]
    assert confirmed(spark, make_docs, *texts) >= {(i, n) for i, n in enumerate(names)}
    assert confirmed(spark, make_docs, "Copyright (c) 2019-2021. All rights reserved.") == {(0, "proprietary")}
    other = "Licensed under terms that nobody here has ever seen written anywhere.", "The driver's licence of my aunt was lost", "copyright"
    assert confirmed(spark, make_docs, *other) == set()
    assert confirmed(spark, make_docs, "This work is licensed under the GNU General Public License, version 3.") == {(0, "GPL-3.0")}


def test_edge_texts(spark, make_docs):
    docs = make_docs(None, "", "x", "license " * 5000, "A. " * 3000 + "Released under the MIT License.", (9, "Licensed under CC BY 4.0."), (9, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY 4.0.")).withColumnRenamed("lang", "license")
    got = license_scan.scan(docs).collect()
    assert sorted(str(r.doc_id) for r in got if r.confirmed) == ["4", "9", "9", "None"]
    assert sum(r.length for r in got if r.doc_id == 3) > 39_000
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_differences():
    assert license_scan.differences("released under the mit license", "Released under the MIT License.") == 0
    assert license_scan.differences("Released under an MIT License", "Released under the MIT License.") == 1


def test_notices_beside_others_over_lines_and_in_long_lines(spark, make_docs):
    wrapped = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with\n# the License.\nimport os'
    flat = "and so it goes on " * 200 + "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met" + " and on it goes" * 200
    pair = "Copyright (c) 2020 Acme Corp. Released under the MIT License."
    two = "Released under the MIT License. Licensed under CC BY 4.0. This licence is nobody's."
    not_so = "These works are not licensed under CC BY 4.0."
    texts = pair, wrapped, flat, f"{pair}\n{pair}", two, not_so
    assert confirmed(spark, make_docs, *texts) == {(0, "MIT"), (1, "Apache-2.0"), (2, "BSD-3-Clause"), (3, "MIT"), (4, "MIT"), (4, "CC-BY-4.0")}
    rows = license_scan.scan(make_docs(*texts)).collect()
    for r in rows:
        block = texts[r.doc_id][r.begin : r.begin + r.length]
        assert license_scan.Scanner().best(block)[-1] == r.confirmed
    assert sum(r.confirmed for r in rows if r.doc_id == 3) == 2
    assert {texts[2][r.begin :][:14] for r in rows if r.doc_id == 2 and r.confirmed} == {"redistribution"}


def test_notices_by_an_independent_pattern(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pattern = r"(?im)^[^\n]*(?:all rights reserved|licensed under|released under)[^\n]*$"
    want = {r.doc_id for r in docs.collect() if re.search(pattern, r.text or "")}
    assert len(want) > 300
    assert {r.doc_id for r in license_scan.scan(docs).collect() if r.confirmed} == want


def test_holders_tags_and_whole_texts(spark, make_docs):
    whole = {name: text for name, text in license_scan.TEMPLATES if text.count("\n") > 10}
    assert set(whole) == {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"}
    texts = [
        ("proprietary", "All rights reserved."),
        ("proprietary", "Copyright (c) 2020 Acme Corp. All rights reserved."),
        ("proprietary", "Copyright 2019-2021 Zoë and Sons Ltd\n# All rights reserved\n"),
        ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nimport os"),
        ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
        ("MIT", f"MIT License\n\nCopyright (c) 2020 Acme\n\n{whole['MIT']}\nnothing else"),
        ("MIT", "Copyright (c) 2020 Acme " + " ".join(whole["MIT"].split())),
        ("BSD-2-Clause", whole["BSD-2-Clause"]),
        ("BSD-3-Clause", whole["BSD-3-Clause"].replace("the copyright holder nor", "Acme Corp nor")),
        ("Apache-2.0", f"Some words.\n\n{whole['Apache-2.0']}\n\nand more"),
        ("Apache-2.0", "x = 1 " + " ".join(whole["Apache-2.0"].lower().split()) + " y = 2"),
    ]
    assert confirmed(spark, make_docs, *(t for _, t in texts)) == {(i, n) for i, (n, _) in enumerate(texts)}
    assert confirmed(spark, make_docs, "SPDX-License-Identifier: unheard-of", "Copyright 2020 Acme Corp.") == set()


def test_words_that_decide(spark, make_docs):
    """Notices of other licenses, and denials, are confirmed as nothing; what is left unsaid here stays a candidate."""
    program = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or any later version."
    others = [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 1.",
        program.format("Lesser ", "2"),
        program.format("Lesser ", "3"),
        program.format("", "1"),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under the Apache License, Version 1.1.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
        "This work is not licensed under the GNU General Public License, version 3.",
        "This work is not dedicated to the public domain under CC0 1.0.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY 3.0.",
        "Copyright. No rights reserved.",
        "word " * 100 + "which was never licensed under CC BY 4.0 " + "word " * 100,
    ]
    rows = license_scan.scan(make_docs(*others)).collect()
    assert {(r.doc_id, r.license) for r in rows if r.confirmed} == set()
    assert {r.doc_id for r in rows} == set(range(len(others)))
    same = [("GPL-3.0", program.format("", "3")), ("CC-BY-4.0", "word " * 100 + "which was licensed under CC BY 4.0 " + "word " * 100), ("MIT", "It is released under the MIT License.")]
    assert confirmed(spark, make_docs, *(t for _, t in same)) >= {(i, n) for i, (n, _) in enumerate(same[:2])}


def edit_distance_by_table(a, b):
    """Words that must be left out, put in or replaced, by dynamic programming over all prefixes."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_confirmed_notices_against_all_spans_of_small_texts(spark, make_docs):
    """Every confirmed block is near its template by an edit distance of its own, and no sentence that equals a template is missed."""
    import random

    rng = random.Random(6)
    short = [(n, t) for n, t in license_scan.TEMPLATES if len(t.split()) <= 20 and t.endswith(".")]
    texts = []
    for _ in range(60):
        _, notice = rng.choice(short)
        kept = [w for w in notice.split() if rng.random() > 0.08]
        texts.append(f"{rng.choice(['Here', 'There'])} it begins. {notice if rng.random() < 0.5 else ' '.join(kept)} {rng.choice(['And on it goes.', 'The end.'])}")
    word = lambda t: [w for w in (x.strip(".,;:()\"").lower() for x in t.split()) if w]
    rows = [r for r in license_scan.scan(make_docs(*texts)).collect() if r.confirmed]
    for r in rows:
        block = texts[r.doc_id][r.begin : r.begin + r.length]
        assert min(edit_distance_by_table(word(block), word(t)) / len(word(t)) for n, t in license_scan.TEMPLATES if n == r.license) <= 0.3
    found = {(r.doc_id, r.license) for r in rows}
    for i, text in enumerate(texts):
        whole = {n for n, t in short if f". {t} " in text}
        assert not whole or any((i, n) in found for n in whole), text
