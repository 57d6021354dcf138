"""Licence recognition by sentence rules (operator 2).

A text is cut into sentences, each is normalised (lower case, letters and digits with single spaces) and looked up among the known
licence sentences. The identifiers found, in order, are matched against licence rules, the most specific first; what a rule has
matched is taken out before the next rule looks, so a full grant is not also counted as the short mention it starts with. Sentences
are read twice, by line and with wrapped lines joined, since licence texts are often wrapped. A sentence that is not known as it stands
is looked up again with the lead-in of a mention ('this data set is released under the terms of') or the name of an organisation in the
BSD non-endorsement clause replaced by the usual one. JVM functions only, no shuffle.

Defined cases: a null or empty text has no sentences and no licences; repeated rows are read each on its own; further columns
are ignored; a null doc_id is passed through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.text import bind, whole

# Sentences of public licences and of the usual notices, by identifier, normalised.
SENTENCES: dict[str, str] = {
    "mit-mention": "released under the mit license",
    "mit-notice": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                 "files the software to deal in the software without restriction including without limitation the rights to use copy "
                 "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
                 "software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                     "the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
             "warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-mention": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
                    "an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-mention": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                  "software foundation either version 3 of the license or at your option any later version",
    "gpl2-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                  "software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                 "following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                  "disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                  "disclaimer in the documentation and or other materials provided with the distribution",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "all-rights": "all rights reserved",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",
    "bsd-endorse-tail": "nor the names of its contributors may be used to endorse or promote products derived from this software without "
                        "specific prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "gpl2-only-grant": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by "
                       "the free software foundation",
    "gpl3-only-grant": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by "
                       "the free software foundation",
    "lgpl-free": "this library is free software",
    "lgpl21-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
                    "free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
                   "free software foundation either version 3 of the license or at your option any later version",
    "agpl3-grant": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
                   "free software foundation either version 3 of the license or at your option any later version",
    # the usual notices part the version by a semicolon, which ends a sentence
    **{f"{kind}-terms": f"you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation"
       for kind, name in (("gpl", "general public license"), ("lgpl", "lesser general public license"), ("agpl", "affero general public license"))},
    **{f"{i}-later": f"either version {version} of the license or at your option any later version" for i, version in (("v2", "2"), ("v2-1", "2 1"), ("v3", "3"))},
    **{f"{i}-only": f"version {version} of the license" for i, version in (("v2", "2"), ("v2-1", "2 1"), ("v3", "3"))},
    # the notice writes 'v. 2.0', which ends a sentence
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                 "provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
                  "and redistribute it freely subject to the following restrictions",
    "epl1-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which "
                   "accompanies this distribution",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which "
                   "accompanies this distribution",
}
#: Names that mentions use, normalised, without 'the'.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "GPL-3.0-only": ("gnu general public license v3 0", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2", "gnu gpl version 2",
                     "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl v3", "lgplv3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl v2 1", "lgplv2 1"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense", "unlicense license"),
    "EPL-1.0": ("eclipse public license 1 0", "eclipse public license version 1 0", "eclipse public license v1 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0"),
    "CC-BY-4.0": ("cc by 4 0", "cc by 4 0 license", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "cc by nd 4 0 license", "creative commons attribution noderivatives 4 0 international license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 license", "cc0 1 0 universal license"),
}
_MENTIONS = {f"{licence.lower().replace('.', '-')}-name-{i}": (licence, f"licensed under the {name}")
             for licence, names in NAMES.items() for i, name in enumerate(names)}
SENTENCES |= {i: sentence for i, (_, sentence) in _MENTIONS.items() if sentence not in SENTENCES.values()}
#: Licence and the identifiers it needs, one after the other; matched in this order.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache-notice", "apache-compliance", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-notice", "apache-compliance")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-grant", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-grant", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-only", ("gpl-free", "gpl3-only-grant", "gpl-hope")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only-grant", "gpl-hope")),
    ("GPL-3.0-only", ("gpl3-only-grant",)),
    ("GPL-2.0-only", ("gpl2-only-grant",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    *[(f"{kind.upper()}-{version}-{'or-later' if end == 'later' else end}", (f"{kind}-terms", f"{i}-{end}"))
      for kind, i, version in (("gpl", "v2", "2.0"), ("gpl", "v3", "3.0"), ("lgpl", "v2-1", "2.1"), ("lgpl", "v3", "3.0"), ("agpl", "v3", "3.0"))
      for end in ("later", "only")],
    ("MPL-2.0", ("mpl-notice",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse-tail")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-tail")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-mention",)),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-mention",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-only", ("gpl3-mention",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    *[(licence, (i,)) for i, (licence, _) in _MENTIONS.items() if i in SENTENCES],
]
LEAD_IN = (r"^(?:(?:(?:this|these|the|our|all) (?:[a-z0-9]+ ){0,4})?(?:is|are) |it is )?(?:licensed|released|distributed|published|provided|shared|"
           r"available|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?")
ENDORSER = r"^neither the name of (?:[a-z0-9]+ ){1,20}nor the names of its contributors "
LINE_END = r"(?:\n|(?<=[.!?;:])[\x20\x09]+)"
JOINED_END = r"(?:\n[\x20\x09]*\n\s*|(?<=[.!?;:])\s+)"


def _known(text: Column, end: str) -> Column:
    """Identifiers of the known sentences of a text, in order, as ',a,,b,'."""
    clean = F.transform(F.split(text, end), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    sentences = list(SENTENCES.values())
    usual = lambda s: (
        F.when(s.isin(sentences), s)
        .when(s.contains("under "), F.regexp_replace(F.regexp_replace(s, LEAD_IN, "licensed under the "), "licence", "license"))
        .when(s.startswith("neither the name of "), F.regexp_replace(s, ENDORSER, "neither the name of the copyright holder nor the names of its contributors "))
        .otherwise(s))
    known = F.filter(F.transform(clean, usual), lambda s: s.isin(sentences))
    names = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    return F.concat_ws("", F.transform(known, lambda s: F.concat(F.lit(","), F.element_at(names, s), F.lit(","))))


def _matched(known: Column) -> Column:
    """Licences of an identifier sequence, each once, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f",{i}," for i in ids)).alias("ids")) for name, ids in RULES])
    begin = F.struct(known.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        # a bar stands for what was taken out, so that its neighbours do not become a sequence
        hit = F.contains(state["left"], rule["ids"])
        return F.when(hit, F.struct(F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
                                    F.array_append(state["found"], rule["licence"]).alias("found"))).otherwise(state)

    return F.when(known == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.aggregate(rules, begin, step, lambda s: s["found"])))


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences): known sentences by line, and licences by either reading, sorted, of every document."""
    text = whole()
    read = docs.select("doc_id", _known(text, LINE_END).alias("by_line"), _known(text, JOINED_END).alias("joined"))
    both = F.array_sort(F.array_distinct(F.concat(bind(F.col("by_line"), _matched), bind(F.col("joined"), _matched))))
    return read.select("doc_id", "by_line", "joined", both.alias("licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.col("by_line").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    names = "MAP {" + ", ".join(f"'{sentence}': '{name}'" for name, sentence in SENTENCES.items()) + "}"
    # the end of a sentence is marked by a character that no text has, as this engine's patterns cannot look behind
    by_line = r"regexp_replace(t, '([.!?;:])[\x20\x09]+', '\1' || chr(10), 'g')"
    joined = r"regexp_replace(regexp_replace(t, '\n[\x20\x09]*\n\s*', chr(1), 'g'), '([.!?;:])\s+', '\1' || chr(1), 'g')"
    usual = (f"CASE WHEN map_contains({names}, s) THEN s WHEN contains(s, 'under ') THEN "
             f"replace(regexp_replace(s, '{LEAD_IN}', 'licensed under the '), 'licence', 'license') "
             f"WHEN starts_with(s, 'neither the name of ') THEN regexp_replace(s, '{ENDORSER}', "
             f"'neither the name of the copyright holder nor the names of its contributors ') ELSE s END")
    known = lambda text, end: (
        f"array_to_string(list_transform(list_filter(list_transform(list_transform(string_split({text}, chr({end})), lambda s: "
        f"trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: {usual}), lambda s: map_contains({names}, s)), "
        f"lambda s: ',' || {names}[s] || ','), '')")
    steps, last = [], {"by_line": "by_line", "joined": "joined"}
    for i, (name, ids) in enumerate(RULES):
        pattern = "".join(f",{x}," for x in ids)
        columns = ", ".join(f"replace({last[c]}, '{pattern}', '|') AS {c}_{i}, contains({last[c]}, '{pattern}') AS {c}_hit_{i}" for c in last)
        steps.append(f"s{i} AS (SELECT *, {columns} FROM {'k' if i == 0 else f's{i - 1}'})")
        last = {c: f"{c}_{i}" for c in last}
    hits = ", ".join(f"CASE WHEN by_line_hit_{i} OR joined_hit_{i} THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, {known(by_line, 10)} AS by_line, {known(joined, 1)} AS joined FROM d),
{", ".join(steps)}
SELECT doc_id, by_line AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ',') AS licences FROM s{len(RULES) - 1}"""


SQL = _sql()
