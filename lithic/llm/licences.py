"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

Known licence sentences have identifiers. A text is cut into sentences, those that hold a licence word are normalised
(lower case; what is neither letter, digit nor one of . + - becomes one space) and looked up; what is found is the
text's sequence of identifiers. Rules are tried in order, a longer text before the notice that it begins with: a rule
holds if its identifiers occur in the sequence in its order, others between them allowed. The sequence is read twice,
with line ends as sentence ends and with lines joined: rules are tried on both readings and their licences united, and
the sentences listed are those of the reading that knows more.

No shuffle and no join: the sentence table is of fixed size and stands in the plan, as a set for the first look and a
map for the few sentences that are in it.

Cases: null and empty texts have no sentences and no licences; repeated sentences stay in the sequence; sentences that
no rule uses are listed all the same; of two readings that know as many the one by line is listed. Repeated rows are each
read; texts of any length are read whole; an empty table gives an empty one; columns keep their names inside ``row``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import table

# Names of licences as notices write them, by identifier and kind.
NAMES = {
    "mit": ("MIT", "permissive", ["mit license", "mit licence", "mit"]),
    "apache-2.0": ("Apache-2.0", "permissive", ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0"]),
    "bsd-2-clause": ("BSD-2-Clause", "permissive", ["bsd 2-clause license", "simplified bsd license", "bsd-2-clause"]),
    "bsd-3-clause": ("BSD-3-Clause", "permissive", ["bsd 3-clause license", "new bsd license", "bsd-3-clause"]),
    "isc": ("ISC", "permissive", ["isc license", "isc"]),
    "mpl-2.0": ("MPL-2.0", "weak copyleft", ["mozilla public license version 2.0", "mozilla public license 2.0", "mpl-2.0"]),
    "lgpl-3.0": ("LGPL-3.0", "weak copyleft", ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "lgpl-3.0"]),
    "lgpl-2.1": ("LGPL-2.1", "weak copyleft", ["gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgpl-2.1"]),
    "gpl-3.0": ("GPL-3.0", "copyleft", ["gnu general public license version 3", "gnu general public license v3.0", "gpl-3.0"]),
    "gpl-2.0": ("GPL-2.0", "copyleft", ["gnu general public license version 2", "gnu general public license v2.0", "gpl-2.0"]),
    "agpl-3.0": ("AGPL-3.0", "copyleft", ["gnu affero general public license version 3", "gnu affero general public license v3.0", "agpl-3.0"]),
    "cc0-1.0": ("CC0-1.0", "public domain", ["cc0 1.0", "cc0-1.0", "creative commons zero v1.0 universal"]),
    "unlicense": ("Unlicense", "public domain", ["unlicense"]),
}
for _v in ("4.0", "3.0"):
    for _k, _long, _kind in (("by", "attribution", "permissive"), ("by-sa", "attribution-sharealike", "copyleft"), ("by-nc", "attribution-noncommercial", "noncommercial"), ("by-nd", "attribution-noderivatives", "no derivatives"), ("by-nc-sa", "attribution-noncommercial-sharealike", "noncommercial"), ("by-nc-nd", "attribution-noncommercial-noderivatives", "noncommercial")):
        NAMES[f"cc-{_k}-{_v}"] = (f"CC-{_k.upper()}-{_v}", _kind, [f"cc {_k} {_v}", f"cc-{_k}-{_v}", f"creative commons {_long} {_v} international license", f"creative commons {_long} {_v} license"])

# How notices begin.
PHRASES = ["", "licensed under", "licensed under the", "released under", "released under the", "distributed under", "distributed under the", "published under", "published under the", "available under", "available under the", "this work is licensed under", "this work is licensed under the", "this work is licensed under a", "this project is licensed under the", "this software is licensed under the", "this content is licensed under", "spdx-license-identifier", "license", "content is licensed under"]

# Sentences of licence texts.
SENTENCES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache.comply": "you may not use this file except in compliance with the License.",
    "apache.notice": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache.basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache.see": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl.free3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.free2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}

#: (licence, kind, identifiers in order), the longer rules of a licence first.
RULES = [
    ("MIT", "permissive", ["mit.grant", "mit.notice"]),
    ("ISC", "permissive", ["isc.grant"]),
    ("Apache-2.0", "permissive", ["apache.notice", "apache.comply"]),
    ("Apache-2.0", "permissive", ["apache.notice"]),
    ("BSD-3-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("BSD-2-Clause", "permissive", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl.free3"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl.free2"]),
    ("MPL-2.0", "weak copyleft", ["mpl.notice"]),
    ("Unlicense", "public domain", ["unlicense.free"]),
    *((name, kind, [f"{key}.name"]) for key, (name, kind, _) in NAMES.items()),
    ("All-rights-reserved", "reserved", ["reserved"]),
]

_HINT = "licen|permi|redistribut|reserved|warrant|free software|unencumbered|the hope|spdx|mozilla|neither the name|cc"


#: What the scan looks for: each known sentence holds one.
_WORDS = _HINT + "|under|free"


def normalised(sentence: str) -> str:
    return re.sub(r" +", " ", re.sub(r"[^a-z0-9.+-]", " ", sentence.lower())).strip(" .")


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {normalised(s): k for k, s in SENTENCES.items()}
    for key, (_, _, names) in NAMES.items():
        for name in names:
            for phrase in PHRASES:
                if phrase or " " in name and "licen" in name:  # a bare short name is no sentence
                    out.setdefault(normalised(f"{phrase} {name}"), f"{key}.name")
    return out


def known_parts() -> tuple[dict[str, str], dict[str, list[str]]]:
    """sentence_table() with each text cut as the scan cuts texts, and the identifiers of the parts of those that break.
    The last part has the text's own identifier; parts that texts share have the first one's."""
    out, parts = {s: i for s, i in sentence_table().items() if i not in SENTENCES}, {}
    for key, text in SENTENCES.items():
        cut = [normalised(x) for x in re.sub(r"([.!?;:])[ \t]+", "\\1\n", re.sub(r"\b([Vv])\.[ \t]+(?=\d)", r"\1 ", text)).split("\n")]
        parts[key] = [out.setdefault(x, key if n == len(cut) else f"{key}.{n}") for n, x in enumerate(cut, 1)]
    return out, parts


def _sentences(text: Column) -> Column:
    """Normalised sentences that hold a licence word."""
    named = F.regexp_replace(text, r"([Ii]dentifier):[ \t]+", "$1 ")  # a colon ends a sentence, but not this one
    named = F.regexp_replace(named, r"\b([Vv])\.[ \t]+(?=\d)", "$1 ")  # nor does this full stop
    cut = F.split(F.regexp_replace(named, r"([.!?;:])[ \t]+", "$1\n"), "\n")
    plain = F.transform(F.filter(cut, lambda s: F.lower(s).rlike(_WORDS)), lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9.+-]", " "), " +", " "))
    return F.transform(plain, lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", ""))


def _rules() -> list[tuple[str, str, list[str]]]:
    """The rules over identifiers of sentences as texts are cut."""
    _, parts = known_parts()
    return [(n, k, [x for i in r for x in parts.get(i, [i])]) for n, k, r in RULES]


def _holds(ids: Column, rule: list[str]) -> Column:
    """Whether ids hold a rule's identifiers in order, whatever stands between: one pass that counts those met so far."""
    if len(rule) == 1:
        return F.array_contains(ids, rule[0])
    wanted = F.array(*map(F.lit, rule))
    return F.aggregate(ids, F.lit(0), lambda n, x: F.when(x == F.get(wanted, n), n + 1).otherwise(n)) == len(rule)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as ``row``, and ``m``: ids (the known sentences in order), licences, kinds (in the rules' order)."""
    known, _ = known_parts()
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hint = F.lower(body).rlike(_WORDS)

    def ids(t: Column) -> Column:
        return F.transform(F.filter(_sentences(t), lambda s: s.isin(list(known))), lambda s: F.element_at(lookup, s))

    none = F.array().cast("array<string>")
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(hint, ids(body)).otherwise(none).alias("by_line"), F.when(hint, ids(F.regexp_replace(body, r"[ \t]*\r?\n[ \t]*", " "))).otherwise(none).alias("joined"))
    found = read.select("*", F.when(F.size("joined") > F.size("by_line"), F.col("joined")).otherwise(F.col("by_line")).alias("ids"))
    hits = [F.when(_holds(F.col("by_line"), r) | _holds(F.col("joined"), r), F.struct(F.lit(n).alias("licence"), F.lit(k).alias("kind"))) for n, k, r in _rules()]
    rules = F.filter(F.array(*hits), lambda x: x.isNotNull())
    hit = F.when(F.size("ids") > 0, rules).otherwise(F.array().cast("array<struct<licence:string,kind:string>>"))
    return found.withColumn("hit", hit).select("row", F.struct("ids", F.array_distinct("hit.licence").alias("licences"), F.array_distinct("hit.kind").alias("kinds")).alias("m"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("row.doc_id", F.size("m.ids").cast("long").alias("n_sentences"), F.array_join("m.ids", ",").alias("sentence_ids"), F.array_join("m.licences", ",").alias("licences"), F.array_join("m.kinds", ",").alias("kinds"))


def _oracle() -> str:
    """The same tables and both readings; rules as patterns over the identifiers."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ",".join(f"({quote(s)},{quote(i)})" for s, i in known_parts()[0].items())
    named = r"regexp_replace(regexp_replace({t}, '([Ii]dentifier):[ \t]+', '\1 ', 'g'), '\b([Vv])\.[ \t]+([0-9])', '\1 \2', 'g')"
    cut = f"string_split(regexp_replace({named}, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
    plain = "regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+-]', ' ', 'g'), ' +', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    ids = f"list_filter(list_transform(list_filter({cut}, lambda s: regexp_matches(lower(s), {quote(_WORDS)})), lambda s: (k.m)[{plain}]), lambda x: x is not null)"
    pattern = lambda r: quote(",(?:[^,]*,)*?".join(["," + re.escape(r[0]), *map(re.escape, r[1:])]) + ",")
    fields = lambda at: ", ".join(f"case when regexp_matches(line, {pattern(r[2])}) or regexp_matches(line_, {pattern(r[2])}) then {quote(r[at])} end" for r in _rules())
    once = lambda i: f"array_to_string(list_filter(list_transform(range(1, len({i}) + 1), lambda j: case when list_position({i}, {i}[j]) = j then {i}[j] end), lambda x: x is not null), ',')"
    return f"""
with k as (select map_from_entries(list((s, i))) as m from (values {known}) v(s, i)),
a as (select doc_id, {ids.format(t="coalesce(text, '')")} as l, {ids.format(t="regexp_replace(coalesce(text, ''), '[ \\t]*\\r?\\n[ \\t]*', ' ', 'g')")} as j from documents, k),
b as (select doc_id, case when len(j) > len(l) then j else l end as ids, ',' || array_to_string(l, ',') || ',' as line, ',' || array_to_string(j, ',') || ',' as line_ from a),
d as (select doc_id, ids, list_filter([{fields(0)}], lambda x: x is not null) as n, list_filter([{fields(1)}], lambda x: x is not null) as q from b)
select doc_id, len(ids)::bigint as n_sentences, array_to_string(ids, ',') as sentence_ids, {once('n')} as licences, {once('q')} as kinds from d
"""


ORACLE = _oracle()
