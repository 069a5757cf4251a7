import textwrap

import duckdb
import pandas as pd
import pytest

from tickloom.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
CC0 = "To the extent possible under law, Jane Q. has waived all copyright and related or neighboring rights to Some Work.".replace("Q.", "Q")


def wrapped(text, width, mark=""):
    return "\n".join(textwrap.indent(textwrap.fill(p, width), mark, lambda _: True) + f"\n{mark.rstrip()}" for p in text.split("\n\n"))


NOTICES = [
    (MIT, ["MIT"]),
    ("Copyright (c) 2012, Someone\nAll rights reserved.\n\n" + BSD, ["BSD"]),
    (BSD, ["BSD"]),
    (APACHE, ["Apache-2.0"]),
    (GPL.format(";", ";", 2), ["GPL-2.0-or-later"]),
    (GPL.format(":", ",", 3), ["GPL-3.0-or-later"]),
    (CC0, ["CC0-1.0"]),
]


@pytest.mark.parametrize("layout", ["wide", "wrapped", "comment", "one line", "windows"])
def test_standard_notices_are_found_however_wrapped(spark, layout):
    shape = {
        "wide": lambda t: t,
        "wrapped": lambda t: wrapped(t, 72),
        "comment": lambda t: "/*\n" + wrapped(t, 66, " * ") + "/",
        "one line": lambda t: " ".join(t.split()),
        "windows": lambda t: wrapped(t, 60).replace("\n", "\r\n"),
    }[layout]
    todo = [n for n in NOTICES if not (layout == "one line" and n[0].startswith("Copyright"))]  # the holder's line has no stop
    if layout in ("wrapped", "comment", "windows"):
        todo = [n for n in todo if not n[0].startswith("Copyright")]  # filling would join the holder's line to the next
    rows = [(k, "Some prose before.\n\n" + shape(t) + "\n\nProse after it.") for k, (t, _) in enumerate(todo)]
    got = {r.doc_id: [h.licence for h in r.hits] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(todo)}


def test_parts_of_other_sentences_are_no_notice(spark):
    rows = [(1, "He said all rights reserved is a phrase."), (2, "It was never released under the MIT License."), (3, "Released under the MIT\n\nLicense.")]
    assert not any(r.hits for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sql_agrees_on_wrapped_notices(spark):
    shapes = [lambda t: t, lambda t: wrapped(t, 72), lambda t: "/*\n" + wrapped(t, 66, " * ") + "/", lambda t: " ".join(t.split()), lambda t: wrapped(t, 60).replace("\n", "\r\n")]
    tail = "\n\nProse after it. All rights reserved.\nReleased under the MIT License..."
    rows = [(10 * k + j, "Some prose before.\n\n" + shape(t) + tail) for j, shape in enumerate(shapes) for k, (t, _) in enumerate(NOTICES)]
    rows += [(900, None), (901, ""), (902, "All rights reserved"), (903, "All rights reserved\n"), (904, "Wait... all rights reserved?! Yes")]
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
        want = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, sentence_ids, n_rules FROM ({licenses.SQL})").fetchall()}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (",".join(r.sentence_ids), len(r.hits)) for r in got} == want
    assert sum(n > 0 for _, n in want.values()) >= len(rows) - 3
