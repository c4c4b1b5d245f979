"""Licence notices inside lines of any length, titles and SPDX identifiers."""

import random

import tables

from sleepsignal.llm import license


def test_notices_in_lines_of_any_length_and_short_forms(spark, docs):
    rng = random.Random(12)
    notices = [(f, t) for f, ts in license.TEMPLATES.items() for t in ts]
    data, want = [], {}

    def put(text, families, least=1):
        data.append((1000 + len(data), text, "en", "s", 1, "x", 1, None, 0.5, 7))
        if families is not None:
            want[1000 + len(data) - 1] = families

    for n in (10, 60, 150, 400, 1500, 20_000):
        for family, text in notices if n < 20_000 else notices[::4]:
            w = tables.words(rng, "en", n)
            at = rng.randint(0, n)
            put(" ".join([*w[:at], text, *w[at:]]), [family])
    w = " ".join(tables.words(rng, "de", 300))
    put(f"{w} Released under the MIT License. Licensed under the Apache License, Version 2.0. {w}", ["Apache", "MIT"])
    for text, family in [
        ("MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("License: MIT", "MIT"), ("Apache License", "Apache"), ("BSD 3-Clause License", "BSD"), ("ISC License", "ISC"),
        ("# SPDX-License-Identifier: MIT", "MIT"), (f"{w} SPDX-License-Identifier: GPL-3.0-or-later {w}", "GPL"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC"), ("GNU General Public License", "GPL"),
    ]:
        put(text, [family])
    put("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", ["Apache", "BSD", "MIT"])
    for text in ["SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: CC-BY-ND-4.0", "MIT", "Apache", "license", "the public library", f"{w} to the extent possible under law {w}", f"{w} the MIT License was named in the report and so was the Apache {w}"]:
        put(text, [])
    got = {r["doc_id"]: r["_c"] for r in license.scan_licences(spark.createDataFrame(data, tables.DOCS).unionByName(docs.filter("doc_id < 60")), "_c").collect()}
    assert [(got[k]["families"], want[k], data[k - 1000][1][:200]) for k in want if got[k]["families"] != want[k]] == []
    assert all(got[k]["n_paragraphs"] == (1 if v else 0) for k, v in want.items())
