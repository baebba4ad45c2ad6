"""Licence recognition by sentences and rules (operator 10), in SQL functions.

Every text is cut at sentence ends, colons before white space and blank lines; a
piece that is no known sentence as a whole is cut again at its line ends, so wrapped
licence texts and notices on lines of their own are both found, in their order.
Normalised sentences that are known become identifiers, by a map, and the sequence
of identifiers is matched against ordered rules. A rule takes the identifiers it
matches, so a whole licence text is not also its notice.

Defined results: null, empty and unlicensed texts give no row; a licence stated
twice is one row with n_matches 2; repeated rows of a document, and rows with a null
doc_id, are reported each; known sentences that no rule takes are reported as
licence "unknown"; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_LIBRARY = "this library is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_MORE = "see the gnu {} for more details"
_HOPE = "this {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_CC = "this work is licensed under a creative commons {} 4 0 international license"
# Sentences of public licences and their notices, as normalised.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "released under the mit license",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "licensed under the mit license",
    6: "licensed under cc by 4 0",
    7: "licensed under cc by sa 4 0",
    8: _CC.format("attribution"),
    9: "all rights reserved copyright license required",
    10: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    11: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    12: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    13: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    14: "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    15: "you may obtain a copy of the license at",
    16: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    17: "see the license for the specific language governing permissions and limitations under the license",
    18: _GNU.format("general public license", "3"),
    19: _GNU.format("general public license", "2"),
    20: _GNU.format("affero general public license", "3"),
    21: _GNU.format("lesser general public license", "3"),
    22: _LIBRARY.format("lesser general public license", "2 1"),
    23: _LIBRARY.format("lesser general public license", "3"),
    24: _HOPE.format("program"),
    25: _HOPE.format("library"),
    26: _MORE.format("general public license"),
    27: _MORE.format("affero general public license"),
    28: _MORE.format("lesser general public license"),
    29: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    30: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    31: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    32: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    33: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    34: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    35: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    36: "this source code form is subject to the terms of the mozilla public license v",
    37: "this is free and unencumbered software released into the public domain",
    38: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    39: _CC.format("attribution sharealike"),
    40: _CC.format("attribution noncommercial"),
    41: _CC.format("attribution noderivatives"),
    42: _CC.format("attribution noncommercial sharealike"),
    43: _CC.format("attribution noncommercial noderivatives"),
    44: "licensed under cc by nd 4 0",
    45: "licensed under cc by nc sa 4 0",
    46: "licensed under cc by nc nd 4 0",
    47: "this work is dedicated to the public domain under cc0 1 0",
    48: "all rights reserved",
    49: "licensed under the bsd 3 clause license",
    50: "licensed under the bsd 2 clause license",
    51: "licensed under the isc license",
    52: "licensed under the mozilla public license 2 0",
    53: "licensed under the gnu general public license version 3",
    54: "licensed under the gnu general public license version 2",
}
# Rules in order of precedence: name, licence, identifiers in a row.
RULES = (
    ("mit-text", "MIT", (10, 11, 12, 13)),
    ("mit-grant", "MIT", (10, 11)),
    ("mit-start", "MIT", (10,)),
    ("bsd-3-text", "BSD-3-Clause", (29, 30, 31, 32, 33)),
    ("bsd-2-text", "BSD-2-Clause", (29, 30, 31, 33)),
    ("bsd-3-conditions", "BSD-3-Clause", (29, 30, 31, 32)),
    ("bsd-2-conditions", "BSD-2-Clause", (29, 30, 31)),
    ("bsd-start", "BSD", (29,)),
    ("isc-text", "ISC", (34, 35)),
    ("isc-grant", "ISC", (34,)),
    ("unlicense-text", "Unlicense", (37, 38)),
    ("public-domain", "Unlicense", (37,)),
    ("apache-2.0-header", "Apache-2.0", (14, 15, 16, 17)),
    ("apache-2.0-start", "Apache-2.0", (14,)),
    ("gpl-3.0-header", "GPL-3.0-or-later", (18, 24, 26)),
    ("gpl-2.0-header", "GPL-2.0-or-later", (19, 24, 26)),
    ("agpl-3.0-header", "AGPL-3.0-or-later", (20, 24, 27)),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", (21, 24, 28)),
    ("lgpl-2.1-library", "LGPL-2.1-or-later", (22, 25, 28)),
    ("lgpl-3.0-library", "LGPL-3.0-or-later", (23, 25, 28)),
    ("gpl-3.0-grant", "GPL-3.0-or-later", (18,)),
    ("gpl-2.0-grant", "GPL-2.0-or-later", (19,)),
    ("agpl-3.0-grant", "AGPL-3.0-or-later", (20,)),
    ("lgpl-3.0-grant", "LGPL-3.0-or-later", (21,)),
    ("lgpl-2.1-grant", "LGPL-2.1-or-later", (22,)),
    ("lgpl-3.0-library-grant", "LGPL-3.0-or-later", (23,)),
    ("mpl-2.0-notice", "MPL-2.0", (36,)),
    ("mpl-2.0-notice-2", "MPL-2.0", (52,)),
    ("apache-2.0-notice", "Apache-2.0", (1,)),
    ("mit-notice", "MIT", (2,)),
    ("mit-notice-2", "MIT", (5,)),
    ("gpl-3.0-notice", "GPL-3.0-only", (3,)),
    ("gpl-3.0-notice-2", "GPL-3.0-only", (53,)),
    ("gpl-2.0-notice", "GPL-2.0-only", (54,)),
    ("bsd-3-notice", "BSD-3-Clause", (49,)),
    ("bsd-2-notice", "BSD-2-Clause", (50,)),
    ("isc-notice", "ISC", (51,)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", (4,)),
    ("cc-by-4.0-notice", "CC-BY-4.0", (6,)),
    ("cc-by-4.0-notice-2", "CC-BY-4.0", (8,)),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", (7,)),
    ("cc-by-sa-4.0-notice-2", "CC-BY-SA-4.0", (39,)),
    ("cc-by-nc-4.0-notice-2", "CC-BY-NC-4.0", (40,)),
    ("cc-by-nd-4.0-notice", "CC-BY-ND-4.0", (41,)),
    ("cc-by-nd-4.0-notice-2", "CC-BY-ND-4.0", (44,)),
    ("cc-by-nc-sa-4.0-notice", "CC-BY-NC-SA-4.0", (42,)),
    ("cc-by-nc-sa-4.0-notice-2", "CC-BY-NC-SA-4.0", (45,)),
    ("cc-by-nc-nd-4.0-notice", "CC-BY-NC-ND-4.0", (43,)),
    ("cc-by-nc-nd-4.0-notice-2", "CC-BY-NC-ND-4.0", (46,)),
    ("cc0-1.0-notice", "CC0-1.0", (47,)),
    ("proprietary", "LicenseRef-proprietary", (9,)),
    ("all-rights-reserved", "LicenseRef-all-rights-reserved", (48,)),
)
#: A word of each known sentence: a text without any of them has none of the sentences.
_ANCHOR = "licen[cs]e|permission|software|permitted|program|redistribution|warranty|rights reserved|under cc|this work"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"
_END = rf"[.!?:]+{_SPACE}+|[.!?:]+$|\x0A[\x20\x09\x0B-\x0D]*\x0A"
_LINES = r"[\x0A]+"
_DROP = r"^ ?(?:(?:[a-z]|[0-9]+) )?"


#: All known sentences have one of these.
_WORDS = r"licen|permi|copy|softw|rights|redistrib|warrant|this work|under cc"


def _sql() -> str:
    """The same scan in DuckDB's dialect."""
    cases = " ".join(f"WHEN '{s}' THEN '<{i}>'" for i, s in SENTENCES.items())
    known = lambda x: f"(CASE trim(regexp_replace(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'), '{_DROP}', '')) {cases} ELSE '' END)"
    whole, lines = known("x"), f"array_to_string(list_transform(regexp_split_to_array(x, '{_LINES}'), lambda y: {known('y')}), '')"
    steps = [f"t AS (SELECT doc_id, translate(CAST(text AS VARCHAR), '{_UPPER}', '{_LOWER}') AS t FROM documents)"]
    steps.append(f"p AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(t, '{_END}') AS a FROM t WHERE regexp_matches(t, '{_ANCHOR}'))")
    steps.append("u AS (SELECT r, doc_id, unnest(a) AS x, unnest(range(len(a))) AS k FROM p)")
    steps.append(f"w AS (SELECT r, doc_id, k, CASE WHEN {whole} <> '' THEN {whole} ELSE {lines} END AS s FROM u WHERE regexp_matches(x, '{_WORDS}'))")
    steps.append("r0 AS (SELECT doc_id, s0 FROM (SELECT r, doc_id, string_agg(s, '' ORDER BY k) AS s0 FROM w GROUP BY r, doc_id) q WHERE s0 <> '')")
    rows = []
    for k, (name, licence, seq) in enumerate(RULES, 1):
        pattern = "".join(f"<{i}>" for i in seq)
        steps.append(f"r{k} AS MATERIALIZED (SELECT *, replace(s{k - 1}, '{pattern}', '|') AS s{k} FROM r{k - 1})")
        rows.append(f"SELECT doc_id, '{licence}' AS license, '{name}' AS rule, CAST((length(s{k - 1}) - length(s{k})) // {len(pattern) - 1} AS BIGINT) AS n_matches FROM r{len(RULES)}")
    last = f"s{len(RULES)}"
    rows.append(f"SELECT doc_id, 'unknown' AS license, 'none' AS rule, CAST(length({last}) - length(replace({last}, '<', '')) AS BIGINT) AS n_matches FROM r{len(RULES)}")
    return f"WITH {', '.join(steps)} SELECT * FROM ({' UNION ALL '.join(rows)}) q WHERE n_matches > 0"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, rule, n_matches: a row for each rule that a text matches."""
    match = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), match.alias("t")).where(F.col("t").rlike(_ANCHOR))
    lines = lambda x: F.array_join(F.transform(F.split(x, _LINES), _identify), "")
    ids = F.transform(F.split("t", _END), lambda x: F.when(x.rlike(_WORDS), F.coalesce(F.nullif(_identify(x), F.lit("")), lines(x))).otherwise(""))
    d = d.select("doc_id", F.array_join(ids, "").alias("s")).where("s <> ''")
    found = []
    # The sequence after each rule is a column of its own, so that no rule repeats the work of those before.
    d = d.withColumn("s0", F.col("s"))
    for k, (name, licence, seq) in enumerate(RULES, 1):
        pattern = "".join(f"<{i}>" for i in seq)
        d = d.withColumn(f"s{k}", F.replace(F.col(f"s{k - 1}"), F.lit(pattern), F.lit("|")))
        n = ((F.length(f"s{k - 1}") - F.length(f"s{k}")) / (len(pattern) - 1)).cast("long")
        found.append(F.struct(F.lit(licence).alias("license"), F.lit(name).alias("rule"), n.alias("n_matches")))
    last = F.col(f"s{len(RULES)}")
    found.append(F.struct(F.lit("unknown").alias("license"), F.lit("none").alias("rule"), (F.length(last) - F.length(F.replace(last, F.lit("<"), F.lit("")))).cast("long").alias("n_matches")))
    return d.select("doc_id", F.inline(F.array(*found))).where("n_matches > 0")


def _identify(x):
    """The identifier of a sentence, '' if it is not known; a list number before it does not count."""
    sentence = F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", " "), _DROP, ""))
    known = F.create_map(*[F.lit(v) for i, s in SENTENCES.items() for v in (s, f"<{i}>")])
    return F.coalesce(F.try_element_at(known, sentence), F.lit(""))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_license_sentences": op10}
ORACLE = {"op10_license_sentences": _sql()}
