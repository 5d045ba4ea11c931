"""License scans by sparse TF-IDF cosine and nearest-ancestor inheritance, by DataFrame functions only.

Texts with a licence cue are cut into units: the whole text, its header blocks (paragraphs, and runs of comment lines) and its lines and
sentences, of the last two those with a cue. Units and templates are sparse TF-IDF vectors: a join of the units' terms with the templates'
gives the dot products. Templates are notices, the headers that licences ask for, and full licence texts. A word outside their
vocabulary counts as the rarest kind, so prose around a notice lowers the cosine. Document frequencies are counted over the cue lines
of all texts. The template nearest to a unit, at ``threshold`` or above, is the unit's licence; the best unit's is that of the file.

A file that is mostly notice (``file_share`` of its words), or that is named as licence files are, states the licence of
its directory. A file without a licence of its own inherits that of its nearest ancestor directory by joining the
file's ancestor paths with the directories' licences; of several licence files in a directory the best scored one counts, ties
going to the smaller licence id.

Equal texts are scanned once; texts without a cue are split no further and meet no join but that with the directories.

Defined results: a null or empty text has no licence of its own but may inherit; a null path has no ancestors; repeated rows
get a row each; an empty table gives no rows; other columns pass by, but for those named as a column that is added.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffloom.llm.shared import broadcast_within, let, words, written

# Notices by SPDX id, in the words that headers use.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal, public domain dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0-only": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
# The headers that licences ask files to bear.
HEADERS = {
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
License for more details. You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at https://mozilla.org/MPL/2.0/.""",
}
# Full licence texts.
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
FULL_TEXTS = {
    "BSD-2-Clause": f"BSD 2-Clause License\n{TWO_CLAUSES}\n{DISCLAIMER}",
    "BSD-3-Clause": f"""BSD 3-Clause License\n{TWO_CLAUSES}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.\n{DISCLAIMER}""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices
in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE
BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """zlib License This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
CUE = r"(?i)licen[cs]e|spdx-|public domain|\bCC (?:BY|0)|permission (?:is|to use)|redistribution and use"
COMMENT = r"(?m)(?:^[ \t]*(?://|#|/?\*|--|;|%|<!--)[^\n]*(?:\n|$))+"
BREAKS = r"\n|(?<=[.!?])\x20+"
TOKEN = r"[a-z]+|[0-9]+(?:[.][0-9]+)*"
#: Texts with a licence, or directories, up to which the join is by broadcast; beyond, it shuffles.
BROADCAST_TEXTS = 100_000
LICENSE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*$"


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0))


def templates() -> list[tuple[str, Counter]]:
    """(licence, numbers of its terms) of all templates."""
    every = [(name, text) for name, texts in NOTICES.items() for text in texts] + [*HEADERS.items(), *FULL_TEXTS.items()]
    return [(name, Counter(re.findall(TOKEN, text.lower()))) for name, text in sorted(every)]


def cue_lines(text: Column) -> Column:
    """All lines and sentences with a cue."""
    return F.filter(F.split(text, BREAKS), lambda line: line.rlike(CUE))


def units(text: Column) -> Column:
    """What is compared: structs of a kind (whole, block, line) and a text."""
    blocks = F.filter(F.array_distinct(F.concat(F.split(text, r"\n[ \t\r]*\n"), F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)))), lambda b: b.rlike(CUE) & (b != text))
    of = lambda kind, some: F.transform(some, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))
    return F.concat(of("whole", F.array(text)), of("block", blocks), of("line", cue_lines(text)))


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows from the driver, without Python workers."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def weights(lines: int, counts: dict[str, int]) -> tuple[dict[str, float], float]:
    """The inverse document frequency of each term of the templates, and that of any other term."""
    terms = sorted({t for _, own in templates() for t in own})
    return {t: log((1 + lines) / (1 + counts.get(t, 0))) + 1 for t in terms}, log((1 + lines) / 2) + 1


def postings(spark: SparkSession, idf: dict[str, float]) -> DataFrame:
    """(term, idf, in): a row per term of the templates, with the weights that it has in them, scaled to length 1."""
    of: dict[str, list[dict]] = {t: [] for t in idf}
    for n, (_, own) in enumerate(templates()):
        length = sqrt(sum((k * idf[t]) ** 2 for t, k in own.items()))
        for t, k in own.items():
            of[t].append({"n": n, "w": k * idf[t] / length})
    return small_table(spark, [{"term": t, "idf": idf[t], "of": p} for t, p in of.items()], "term string, idf double, of array<struct<n: int, w: double>>")


def own_licenses(docs: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """(digest, license, license_score, n_license_lines, n_license_blocks, share) of the distinct texts that have a licence.

    n_license_lines: lines and sentences that are one; n_license_blocks: header blocks, or the whole text. share: of the text's words
    that stand in them.
    """
    spark = docs.sparkSession
    cued = written(docs.where(F.col(text).rlike(CUE)).select(F.md5(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text")).groupBy("digest").agg(F.first("text").alias("text")), "license-texts")
    vocabulary = F.lit(sorted({t for _, own in templates() for t in own}))
    found = cued.select(F.explode(cue_lines(F.col("text"))).alias("line")).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(tokens(F.col("line")), vocabulary))).alias("t"))
    counts = {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}  # at most one row per term of the templates
    idf, rare = weights(counts.pop("", 0), counts)
    parts = cued.select("digest", F.posexplode(units(F.col("text"))).alias("u", "x")).select("digest", "u", "x.kind", F.size(words(F.col("x.unit"))).alias("n_words"), tokens(F.col("x.unit")).alias("terms"))
    terms = parts.select("digest", "u", "kind", "n_words", F.explode("terms").alias("term")).groupBy("digest", "u", "kind", "n_words", "term").agg(F.count(F.lit(1)).alias("k"))
    own = F.col("k") * F.coalesce("idf", F.lit(rare))
    square = F.array(F.struct(F.lit(-1).alias("n"), (own * own).alias("w")))
    joined = terms.join(F.broadcast(postings(spark, idf)), "term", "left")
    sums = joined.select("digest", "u", "kind", "n_words", F.explode(F.concat(square, F.coalesce(F.transform("of", lambda p: F.struct(p["n"].alias("n"), (p["w"] * own).alias("w"))), F.array().cast("array<struct<n:int,w:double>>")))).alias("p"))
    sums = sums.groupBy("digest", "u", "kind", "n_words", "p.n").agg(F.sum("p.w").alias("w"))
    best = sums.groupBy("digest", "u", "kind", "n_words").agg(F.max(F.when(F.col("n") < 0, F.col("w"))).alias("square"), F.max(F.when(F.col("n") >= 0, F.struct(F.round("w", 9).alias("w"), (-F.col("n")).alias("n")))).alias("best"))
    names = F.lit([name for name, _ in templates()])
    scored = best.select("digest", "kind", "n_words", F.round(F.col("best.w") / F.sqrt("square"), 6).alias("score"), F.get(names, -F.col("best.n")).alias("license")).where(F.col("score") >= threshold)
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n_words")).otherwise(0))
    each = scored.groupBy("digest").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("best"), F.count_if(F.col("kind") == "line").alias("n_license_lines"), F.count_if(F.col("kind") != "line").alias("n_license_blocks"),
        F.greatest(of("line"), of("block"), of("whole")).alias("n_in"),
    )
    sized = each.join(cued.select("digest", F.size(words(F.col("text"))).alias("n_words")), "digest")
    return written(sized.select("digest", F.col("best.l").alias("license"), (-F.col("best.s")).alias("license_score"), "n_license_lines", "n_license_blocks", (F.col("n_in") / F.col("n_words")).alias("share")), "license-own")


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first; the root is the empty path."""
    parts = F.split(path, "/")
    return let(parts, lambda p: F.transform(F.sequence(F.size(p) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/")))


ADDED = ["license", "license_score", "n_license_lines", "n_license_blocks", "is_license_file", "effective_license", "inherited_from"]


def scan(docs: DataFrame, path: str = "path", text: str = "text", threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """Adds license, license_score, n_license_lines, n_license_blocks, is_license_file, effective_license and inherited_from (null: its own or none)."""
    own = broadcast_within(own_licenses(docs, text, threshold), BROADCAST_TEXTS)
    digest = F.when(F.col(text).rlike(CUE), F.md5(F.col(text).cast("binary")))
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ADDED]).alias("_row"), F.col(path).alias("_path"), digest.alias("digest")).join(own, "digest", "left")
    stated = F.col("license").isNotNull() & ((F.col("share") >= file_share) | F.coalesce(F.col("_path").rlike(LICENSE_NAME), F.lit(False)))
    found = rows.select("_row", F.get(ancestors(F.col("_path")), F.lit(0)).alias("_at"), "license", "license_score", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_license_lines", "n_license_blocks")], stated.alias("is_license_file"))
    place = F.struct((-F.col("license_score")).alias("s"), F.col("license").alias("l"))
    directories = written(found.where(F.col("is_license_file") & F.col("_at").isNotNull()).groupBy(F.col("_at").alias("_dir")).agg(F.min(place)["l"].alias("_license")), "license-directories")
    wanting = docs.select(F.get(ancestors(F.col(path)), F.lit(0)).alias("_own")).where(F.col("_own").isNotNull()).distinct()
    above = wanting.select("_own", F.posexplode(F.concat(F.array("_own"), F.when(F.col("_own") == "", F.array().cast("array<string>")).otherwise(ancestors(F.col("_own"))))).alias("_up", "_dir"))
    nearest = above.join(directories, "_dir").groupBy("_own").agg(F.min(F.struct("_up", "_dir", "_license")).alias("_n")).select("_own", "_n._dir", "_n._license")
    out = found.join(broadcast_within(nearest, BROADCAST_TEXTS), F.col("license").isNull() & (F.col("_at") == F.col("_own")), "left")
    return out.select("_row.*", *ADDED[:5], F.coalesce("license", "_license").alias("effective_license"), F.when(F.col("license").isNull(), F.col("_dir")).alias("inherited_from"))
