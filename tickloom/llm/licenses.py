"""Licence recognition by sentences, with DataFrame functions only.

A text's sentences are normalised and looked up among known licence sentences; the sequence of the identifiers found,
in the order of the text, is then matched against rules that are themselves sequences of identifiers, longest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents

#: Known licence sentences of one line, normalised: lower case, runs of other characters than letters and digits as one
#: blank. Fixed values.
SENTENCES = {
    "apache2-grant": "licensed under the apache license version 2 0",
    "apache2-grant-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-release": "released under the mit license",
    "mit-license": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright to this work",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted",
    "reserved": "all rights reserved",
}
#: The full sentences of the standard notices and their usual variants, normalised: ``*`` stands for one to twelve words,
#: ``|`` for a blank line that may be there. Fixed values.
_FSF = "{} is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation {}"
_THINGS = ("this program", "this library", "this file", "this software", "*")
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
)
_MIT_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_MIT_NOTICE_2 = _MIT_NOTICE.replace("permission notice", "permission notice including the next paragraph")
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"


def _fsf(licence: str, version: str, later: bool = True) -> tuple[str, ...]:
    tail = f"either version {version} of the license or at your option any later version" if later else f"version {version} of the license"
    kinds = [_FSF.format(thing, licence, tail) for thing in _THINGS]
    if not later:
        kinds += [k.replace(f" {tail}", "").replace(f"gnu {licence}", f"gnu {licence} version {version}") for k in kinds]
    return tuple(kinds)


STANDARD = {
    "apache2-grant-comply": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",),
    "apache2-obtain": tuple(
        f"you may obtain a copy of the license {at}|{scheme} www apache org licenses license 2 0{end}"
        for at in ("at", "from") for scheme in ("http", "https") for end in ("", " html", " txt")
    ),
    "mit-grant": (_MIT_GRANT, f"{_MIT_GRANT} {_MIT_NOTICE}", f"{_MIT_GRANT} {_MIT_NOTICE_2}"),
    "gpl2-later": _fsf("general public license", "2"),
    "gpl3-later": _fsf("general public license", "3"),
    "gpl2-only": _fsf("general public license", "2", later=False),
    "gpl3-only": _fsf("general public license", "3", later=False),
    "lgpl21-later": _fsf("lesser general public license", "2 1"),
    "lgpl3-later": _fsf("lesser general public license", "3"),
    "agpl3-later": _fsf("affero general public license", "3"),
    "gpl-warranty": tuple(
        f"{thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
        for thing in _THINGS
    ),
    "cc0": (
        "to the extent possible under law * has waived all copyright and related or neighboring rights to *",
        "to the extent possible under law * have waived all copyright and related or neighboring rights to *",
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to * to the public domain worldwide",
    ),
    "bsd-redistribute": (_BSD, f"{_BSD} 1", f"{_BSD} {_BSD_SOURCE}"),
}
#: Sentence to identifier.
KNOWN = {s: name for name, s in SENTENCES.items()} | {s: name for name, all_ in STANDARD.items() for s in all_}
#: Rules: a licence and the identifiers that make it, in order. Fixed values.
RULES = (
    ("Apache-2.0", ("apache2-grant-the", "apache2-comply", "apache2-obtain")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    ("Apache-2.0", ("apache2-grant-the",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-license",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL", ("gpl-redistribute",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD", ("bsd-redistribute",)),
    ("proprietary", ("reserved",)),
)
STANDARD_RULES = (
    ("Apache-2.0", ("apache2-grant-comply", "apache2-obtain")),
    ("Apache-2.0", ("apache2-grant-comply",)),
    ("BSD", ("reserved", "bsd-redistribute")),
    ("MIT", ("reserved", "mit-grant")),
    *[
        (licence, ids)
        for name, licence in (
            ("gpl2-later", "GPL-2.0-or-later"), ("gpl3-later", "GPL-3.0-or-later"), ("gpl2-only", "GPL-2.0-only"), ("gpl3-only", "GPL-3.0-only"),
            ("lgpl21-later", "LGPL-2.1-or-later"), ("lgpl3-later", "LGPL-3.0-or-later"), ("agpl3-later", "AGPL-3.0-or-later"),
        )
        for ids in ((name, "gpl-warranty"), (name,))
    ],
)


def marked(text: Column) -> Column:
    """The text normalised, but each line's end as a line feed and each sentence's end as two or more."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?<![.!?])[.!?]++(?=[ \t\n]|$)", "\n\n")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(t, r" ?\n ?", "\n")


def _pattern(sentence: str) -> str:
    """Regular expression of a known sentence in a marked text: its words may be wrapped, by single line feeds."""
    some = r"[^ \n]++(?:[ \n][^ \n]++){0,11}?"
    return sentence.replace(" ", r"[ \n]").replace("|", r"(?: |\n+)").replace("*", some)


def identifiers(text: Column, known: dict[str, str] = KNOWN) -> Column:
    """Array of the identifiers of the text's known sentences, in order.

    A sentence starts at a line's start or after a sentence's end, and ends likewise; it may run over several lines,
    with comment marks before them. Where several known sentences fit, the longest counts. ``known`` maps sentences
    to identifiers.
    """
    order = sorted(known, key=lambda s: (-len(s), s))
    one = rf"(?:^ ?|\n)({'|'.join(_pattern(s) for s in order)})(?=\n| ?\z)"
    found = F.transform(F.regexp_extract_all(marked(text), F.lit(one), F.lit(1)), lambda s: F.regexp_replace(s, r"[ \n]+", " "))
    plain = {s.replace("|", " "): name for s, name in known.items() if "*" not in s}
    table = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])

    def name(s: Column) -> Column:
        return F.coalesce(table[s], *[F.when(s.rlike(f"^{_pattern(k)}$"), F.lit(known[k])) for k in order if "*" in k])

    return F.transform(found, name)


def match_rules(ids: Column, rules=RULES + STANDARD_RULES) -> Column:
    """Array of (rule, licence) structs of the rules that the identifier sequence holds, longest rules first.

    An identifier serves one rule only: what a rule has matched no longer counts for those after it.
    """
    ordered = sorted(enumerate(rules), key=lambda r: (-len(r[1][1]), r[0]))
    state = F.struct(F.concat(F.lit("  "), F.array_join(ids, "  "), F.lit("  ")).alias("rest"), F.array().cast("array<struct<rule:int,licence:string>>").alias("hits"))
    table = F.array(
        *[F.struct(F.lit(k).alias("rule"), F.lit(licence).alias("licence"), F.lit(" " + "  ".join(names) + " ").alias("pattern")) for k, (licence, names) in ordered]
    )

    def step(acc: Column, r: Column) -> Column:
        has = F.contains(acc["rest"], r["pattern"])
        hit = F.struct(r["rule"].cast("int").alias("rule"), r["licence"].alias("licence"))
        return F.struct(
            F.when(has, F.replace(acc["rest"], r["pattern"], F.lit(" | "))).otherwise(acc["rest"]).alias("rest"),
            F.when(has, F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(table, state, step, lambda acc: acc["hits"])


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, rules=RULES + STANDARD_RULES) -> DataFrame:
    """(doc_id, sentence_ids, hits) for each row; null and empty texts have no sentences. Repeated rows stay apart.

    Texts of any length are read whole, in time linear in them. Of known sentences that begin at the same place the longest
    counts; among rules of equal length the first. Other columns of docs are ignored. An empty table gives an empty result.
    """
    d = docs.select("doc_id", identifiers(F.col("text"), known).alias("sentence_ids"))
    none = F.array().cast("array<struct<rule:int,licence:string>>")
    return d.withColumn("hits", F.when(F.size("sentence_ids") > 0, match_rules(F.col("sentence_ids"), rules)).otherwise(none))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    licences = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"])))
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(licences, ",").alias("licences"),
        F.size("hits").cast("long").alias("n_rules"),
    )


def _sql() -> str:
    """The same rule for DuckDB, whose regular expressions can't look ahead: there, line feeds are doubled, so that the end of
    one sentence and the start of the next each have their own."""

    def pattern(sentence: str) -> str:
        line = r"(?: |\n\n)"
        signs = {" ": line, "|": r"(?: |(?:\n\n)+)", "*": rf"[^ \n]+(?:{line}[^ \n]+){{0,11}}?"}
        return "".join(signs.get(c, c) for c in sentence)

    order = sorted(KNOWN, key=lambda k: (-len(k), k))
    plain = {k.replace("|", " "): v for k, v in KNOWN.items() if "*" not in k}
    names = ", ".join(f"('{k}', '{v}')" for k, v in plain.items())
    open_ended = " ".join(f"WHEN regexp_full_match(x, '{_pattern(k).replace('++', '+')}') THEN '{KNOWN[k]}'" for k in order if "*" in k)
    rules = RULES + STANDARD_RULES
    ordered = sorted(enumerate(rules), key=lambda r: (-len(r[1][1]), r[0]))
    steps, last = [], "q0"
    for n, (_, (_, ids)) in enumerate(ordered):
        found = f"' {'  '.join(ids)} '"
        steps.append(f"q{n + 1} AS (SELECT * REPLACE (replace(rest, {found}, ' | ') AS rest), contains(rest, {found}) AS h{n} FROM {last})")
        last = f"q{n + 1}"
    hits = ", ".join(f"CASE WHEN h{n} THEN '{licence}' END" for n, (_, (licence, _)) in enumerate(ordered))
    return rf"""
WITH known(sentence, id) AS (VALUES {names}),
m1 AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g') AS t FROM documents),
m2 AS (SELECT doc_id, r, regexp_replace(t, '[.!?]+([ \t\n]|$)', chr(10) || chr(10) || '\1', 'g') AS t FROM m1),
m3 AS (SELECT doc_id, r, replace(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), chr(10), chr(10) || chr(10)) AS t FROM m2),
f AS (SELECT doc_id, r, regexp_extract_all(t, '(?:^ ?|\n)({"|".join(map(pattern, order))})(?:\n| ?$)', 1) AS found FROM m3),
e AS (SELECT r, unnest(range(1, len(found) + 1)) AS pos, regexp_replace(unnest(found), '[ \n]+', ' ', 'g') AS x FROM f),
i AS (SELECT r, pos, coalesce(known.id, CASE {open_ended} END) AS id FROM e LEFT JOIN known ON x = known.sentence),
q0 AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, '  ' || string_agg(id, '  ' ORDER BY pos) || '  ' AS rest FROM i GROUP BY r),
{", ".join(steps)},
h AS (SELECT r, n, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM {last})
SELECT f.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(hits)), ','), '') AS licences, CAST(coalesce(len(hits), 0) AS BIGINT) AS n_rules
FROM f LEFT JOIN h USING (r)
"""


SQL = _sql()
