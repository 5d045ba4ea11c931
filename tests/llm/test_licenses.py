from __future__ import annotations

import math
import random
import re
from collections import Counter

from staffloom.llm import licenses


def terms(text: str) -> list[str]:
    return re.findall(licenses.TOKEN, text.lower())


def brute(texts: list[str | None]) -> dict[str, tuple[float, str] | None]:
    """The best score and licence of each text, over whole texts, blocks and lines."""
    every = licenses.templates()
    vocab = {t for _, own in every for t in own}
    known = [t for t in dict.fromkeys(texts) if t and re.search(licenses.CUE, t)]
    lines = {t: [x for x in re.split(r"\n|(?<=[.!?]) +", t) if re.search(licenses.CUE, x)] for t in known}
    sets = [set(terms(x)) & vocab for t in known for x in lines[t]]
    idf = {t: math.log((1 + len(sets)) / (1 + sum(t in s for s in sets))) + 1 for t in vocab}
    rare = math.log((1 + len(sets)) / 2) + 1
    found = {}
    for text in known:
        blocks = [*re.split(r"\n[ \t\r]*\n", text), *(m[0] for m in re.finditer(licenses.COMMENT, text))]
        best = []
        for unit in [text, *lines[text], *(x for x in blocks if re.search(licenses.CUE, x))]:
            own = Counter(terms(unit))
            vec = {t: k * idf.get(t, rare) for t, k in own.items()}
            for name, template in every:
                other = {t: k * idf[t] for t, k in template.items()}
                dot = sum(vec.get(t, 0) * w for t, w in other.items())
                best.append((-round(dot / math.sqrt(sum(w * w for w in vec.values())) / math.sqrt(sum(w * w for w in other.values())), 6), name))
        found[text] = min(best) if min(best)[0] <= -0.6 else None
    return found


ROWS = [
    ("a/LICENSE", "Released under the MIT License.", None),
    ("a/b/c/x.py", "code here", None),
    ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", None),
    ("a/b/c/y.py", "more prose about things, and a good deal of it, so that this is plainly no licence file at all.\nThis work is licensed under the GNU General Public License, version 3.\nand so on", None),
    ("a/z.py", "a driving licence is needed to drive, says the very long and winding sentence about cars", None),
    ("q/z.py", None, None),
    (None, "", None),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string, _dir string")


def test_own_and_inherited_licenses(spark):
    out = {r.doc_id: r for r in licenses.scan(table(spark)).collect()}
    assert [out[i].license for i in range(7)] == ["MIT", None, "Apache-2.0", "GPL-3.0-only", None, None, None]
    assert (out[1].effective_license, out[1].inherited_from) == ("Apache-2.0", "a/b")
    assert (out[4].effective_license, out[4].inherited_from) == ("MIT", "a")
    assert out[3].effective_license == "GPL-3.0-only" and out[3].inherited_from is None and not out[3].is_license_file
    assert out[5].effective_license is None and out[6].effective_license is None


MIT_FILE = "Copyright (c) 2021 Some Body\n\n" + licenses.FULL_TEXTS["MIT"].removeprefix("MIT License ").replace(". ", ".\n")
BSD_FILE = "Copyright 2019, The Authors.\nAll rights reserved.\n\n" + licenses.FULL_TEXTS["BSD-3-Clause"].removeprefix("BSD 3-Clause License\n")
ISC_FILE = "Copyright 2020 A. N. Author\n" + licenses.FULL_TEXTS["ISC"].removeprefix("ISC License ")
GPL_HEADER = """/*
 * frobnicate - turns things around
 * Copyright (C) 2007 Some Body
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main(void) { return frobnicate(1, 2, 3); }
""" + "void other_names_that_no_template_has(char *buffer, unsigned length, int more);\n" * 40
APACHE_HEADER = "#!/bin/sh\n# Copyright 2015 The Authors\n#\n" + "".join(f"# {line}\n" for line in licenses.HEADERS["Apache-2.0"].split("\n")) + "set -e\necho building everything in this tree\n" * 40
FILES = [
    ("m/LICENSE", MIT_FILE, "MIT"), ("m/src/deep/a.c", "int a;", "MIT"), ("b/notes.txt", BSD_FILE, "BSD-3-Clause"), ("b/x.c", "int x;", "BSD-3-Clause"), ("i/COPYING", ISC_FILE, "ISC"), ("i/g.c", GPL_HEADER, "GPL-3.0-or-later"),
    ("i/run.sh", APACHE_HEADER, "Apache-2.0"), ("i/y.c", "int y;", "ISC"), ("u/z.c", "int z;", None), ("u/prose.txt", "The licence of a pub is a matter of the town. " + "Nobody knows why the hall is closed on some days. " * 30, None),
]


def test_license_files_and_headers_of_full_texts(spark):
    out = {r.path: r for r in licenses.scan(table(spark, [(p, t, None) for p, t, _ in FILES])).collect()}
    assert {p: out[p].effective_license for p, *_ in FILES} == {p: w for p, _, w in FILES}
    assert out["b/notes.txt"].is_license_file and not out["i/g.c"].is_license_file and not out["i/run.sh"].is_license_file


def test_scores_match_brute_force(spark):
    rows = [*ROWS, *[(p, t, None) for p, t, _ in FILES]]
    own = brute([t for _, t, _ in rows])
    for r in licenses.scan(table(spark, rows)).collect():
        best = own.get(r.text)
        assert (r.license, r.license_score) == ((None, None) if best is None else (best[1], -best[0])), r.path


def test_inheritance_matches_brute_force(spark):
    rng = random.Random(2)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0."]
    rows = [("/".join(rng.choice("abc") for _ in range(rng.randrange(5))) + f"/f{i}", rng.choice(notices) if i % 7 == 0 else f"file {i}", None) for i in range(150)]
    out = licenses.scan(table(spark, rows)).collect()
    stated: dict[str, tuple] = {}
    for r in out:
        if r.is_license_file:
            at = r.path.rpartition("/")[0]
            stated[at] = min(stated.get(at, (9, "")), (-r.license_score, r.license))
    for r in out:
        if r.license is None:
            parts = r.path.split("/")[:-1]
            up = next((d for d in ("/".join(parts[:n]) for n in range(len(parts), -1, -1)) if d in stated), None)
            assert (r.effective_license, r.inherited_from) == (stated[up][1] if up is not None else None, up)


def test_clashing_columns_and_long_texts(spark):
    docs = spark.createDataFrame([("a/x", "word " * 300_000 + "\nReleased under the MIT License.", 7, 8, 9)], "path string, text string, _at int, digest int, license int")
    r = licenses.scan(docs).first()
    assert (r._at, r.digest, r.license) == (7, 8, "MIT") and not r.is_license_file


def test_repeated_rows_ties_and_empty(spark):
    rows = [("d/LICENSE", "Released under the MIT License.", None), ("d/COPYING", "Licensed under the Apache License, Version 2.0.", None), ("d/f", "none", None), ("d/f", "none", None)]
    out = licenses.scan(table(spark, rows)).where("path = 'd/f'").collect()
    assert len(out) == 2 and {r.effective_license for r in out} == {"Apache-2.0"}  # equal scores: the smaller id
    assert licenses.scan(table(spark).limit(0)).count() == 0
