"""Operator 2: licence scans by the Dice coefficient of word bigrams, in DataFrame functions only.

A text is cut into passages: the whole text, every sentence or line of it, and runs of sentences and lines across line breaks, as
notices are often wrapped. A passage is normalised to lower-case words, and compared with each template by 2 |A and B| / (|A| + |B|) over the sets of their word bigrams. A passage can reach the
threshold only if its number of bigrams lies within t/(2-t) and (2-t)/t times the template's; and it must then share one of
the template's first bigrams (as many as can be missing, and one), which finds the few passages to compare.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and texts of licences, as their licensors publish them: short statements, the notices that go into source files, and the telling paragraphs of
#: licences that are texts of several.
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AFL-3.0": ["Licensed under the Academic Free License version 3.0"],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "Artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-4-Clause": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."],
    "ECL-2.0": ["Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "JSON": ["The Software shall be used for Good, not Evil."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "MS-PL": ["This source is subject to the Microsoft Public License (MS-PL)."],
    "NCSA": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "ODbL-1.0": ["This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "OSL-3.0": ["Licensed under the Open Software License version 3.0"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": ["This program is free software. It comes without any warranty, to the extent permitted by applicable law."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
#: Paragraphs (licence, place in its list) that other licences hold word for word too: a match says nothing where one of those is found as well.
SHARED = {("Apache-2.0", 2): ["ECL-2.0"], ("BSD-2-Clause", 1): ["BSD-3-Clause", "BSD-4-Clause"], ("BSD-3-Clause", 1): ["BSD-4-Clause"], ("MIT", 2): ["JSON"], ("MIT", 3): ["JSON"]}
THRESHOLD = 0.75


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _template_rows(threshold: float) -> list[dict]:
    """Each template's words and bigrams, the bounds on a passage's bigrams, and the bigrams of which it must have one."""
    rows = []
    for name, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            words = _template_words(text)
            bigrams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
            n = len(bigrams)
            low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
            shared = max(1, math.ceil(threshold * (n + low) / 2 - 1e-9))
            rows.append({"licence": name, "number": number, "yields": SHARED.get((name, number), []), "bigrams": bigrams, "low": low, "high": high, "longest": math.ceil(len(words) * (2 - threshold) / threshold), "probes": sorted(bigrams, key=len, reverse=True)[: n - shared + 1]})
    return rows


def _any_of(phrases: list[str], apart: str) -> str:
    """A regular expression for any of these lower-case phrases, as a tree by their beginnings, so that a text is not held against each of them. ``apart`` stands for a space."""
    if not phrases or phrases == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        heads.setdefault(p[:1], []).append(p[1:])
    ends = "" in heads
    branches = [(apart if c == " " else re.escape(c)) + _any_of(sorted(set(rest)), apart) for c, rest in heads.items() if c]
    return (branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})") + ("?" if ends else "") if not ends or len(branches) != 1 else f"(?:{branches[0]})?"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: a one-element array gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def wrapped(text: Column, threshold: float) -> Column:
    """The runs of a text's lines and sentences across line breaks that match a template; null for null.

    A run holds a probe bigram of the template, and not more words than its longest match. Of runs that overlap, the one with the highest
    coefficient is taken, then the shortest, then the first; and it is given only if it goes over a line break, so a line or sentence
    that matches as well stands for itself, and the whole text too.
    """
    rows = _template_rows(threshold)
    strings = lambda x: F.array(*map(F.lit, x))
    table = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("low", "high", "longest")), *(strings(r[c]).alias(c) for c in ("bigrams", "probes"))) for r in rows))
    probes = strings(sorted({p for r in rows for p in r["probes"]}))
    parts = F.flatten(F.transform(F.split(text, r"\n"), lambda line, n: F.transform(F.filter(F.transform(F.split(line, r"(?<=[.!?])\s+"), words_of), lambda w: F.size(w) > 0), lambda w: F.struct(n.alias("line"), w.alias("words")))))

    def runs(parts: Column) -> Column:
        slice_of = lambda i, j: F.slice(parts, i + 1, j - i + 1)
        words = lambda i, j: F.flatten(F.transform(slice_of(i, j), lambda p: p["words"]))
        count = lambda i, j: F.aggregate(slice_of(i, j), F.lit(0), lambda n, p: n + F.size(p["words"]))

        def scored(i: Column, j: Column, t: Column) -> Column:
            dice = lambda g: F.when((t["low"] <= F.size(g)) & (F.size(g) <= t["high"]), 2 * F.size(F.array_intersect(t["bigrams"], g)) / (F.size(t["bigrams"]) + F.size(g))).otherwise(0.0)
            return F.struct((-_let(bigrams_of(words(i, j)), dice)).alias("less"), (j - i).alias("more"), i.alias("first"))

        def around(k: Column, t: Column) -> Column:
            starts = F.filter(F.sequence(F.greatest(k - t["longest"] + 1, F.lit(0)), k), lambda i: count(i, k) <= t["longest"])
            ends = F.filter(F.sequence(k, F.least(k + t["longest"], F.size(parts)) - 1), lambda j: count(k, j) <= t["longest"])
            return _let(ends, lambda e: F.flatten(F.transform(starts, lambda i: F.filter(F.transform(F.filter(e, lambda j: count(i, j) <= t["longest"]), lambda j: scored(i, j, t)), lambda s: s["less"] <= -threshold))))

        def at(part: Column, k: Column) -> Column:
            following = F.coalesce(F.slice(F.get(parts, k + 1)["words"], 1, 1), F.array().cast("array<string>"))
            hits = lambda g: F.filter(table, lambda t: F.arrays_overlap(probes, g) & F.arrays_overlap(t["probes"], g))
            return F.flatten(F.transform(_let(bigrams_of(F.concat(part["words"], following)), hits), lambda t: around(k, t)))

        def best(good: Column) -> Column:
            apart = lambda x, y: (x["first"] + x["more"] < y["first"]) | (y["first"] + y["more"] < x["first"])
            return F.aggregate(good, F.filter(good, lambda s: F.lit(False)), lambda taken, s: F.when(F.forall(taken, lambda x: apart(x, s)), F.concat(taken, F.array(s))).otherwise(taken))

        taken = _let(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, at)))), best)
        line = lambda i: F.get(parts, i)["line"]
        across = F.filter(taken, lambda s: (line(s["first"]) < line(s["first"] + s["more"])) & (s["more"] + 1 < F.size(parts)))
        return F.transform(across, lambda s: F.array_join(words(s["first"], s["first"] + s["more"]), " "))

    return _let(parts, runs)


def scan_licences(df: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's licence finding: ``doc_id``, ``licence`` (of the best-matching template; null if none reaches ``threshold``), ``dice`` and ``n_matches`` (passages that reach it; of overlapping runs across line breaks the best).

    Of each passage the best match has the highest coefficient, and so has the finding; ties go to the licence name that sorts first. A paragraph that several licences share (``SHARED``)
    only counts where none of the others is a passage's best match. Null and empty texts have no
    match; null and repeated ids keep a row each; other columns are not read. No shuffle: a row is scanned where it is
    read, and only rows with a probe bigram are cut into passages.
    """
    rows = _template_rows(threshold)
    probes = sorted({p for r in rows for p in r["probes"]})
    apart = r"[^\p{L}\p{N}]+"
    anchor = r"(?<![\p{L}\p{N}])" + _any_of(probes, apart) + r"(?![\p{L}\p{N}])"
    table = F.array(
        *(F.struct(F.lit(r["licence"]).alias("licence"), F.array(*map(F.lit, r["yields"])).cast("array<string>").alias("yields"), F.lit(r["low"]).alias("low"), F.lit(r["high"]).alias("high"), F.array(*map(F.lit, r["bigrams"])).alias("bigrams")) for r in rows)
    )

    def against(passage: Column) -> Column:
        fits = F.filter(table, lambda t: (t["low"] <= F.size(passage)) & (F.size(passage) <= t["high"]))
        scored = F.transform(fits, lambda t: F.struct((2 * F.size(F.array_intersect(t["bigrams"], passage)) / (F.size(t["bigrams"]) + F.size(passage))).alias("dice"), t["licence"].alias("licence"), t["yields"].alias("yields")))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    source = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    lowered = F.lower(F.coalesce("text", F.lit("")))
    parts = F.filter(F.split("text", r"\n|(?<=[.!?])\s+"), lambda p: F.lower(p).rlike(anchor))
    passages = F.when(lowered.rlike(anchor), F.array_union(F.array_union(F.array("text"), parts), wrapped(F.col("text"), threshold))).otherwise(F.array().cast("array<string>"))
    # a one-element array gives an expression a name, so that it is computed once
    words = F.transform(passages, lambda p: F.get(F.transform(F.array(words_of(p)), bigrams_of), F.lit(0)))
    found = F.transform(words, against)
    best = F.transform(F.filter(found, lambda m: F.size(m) > 0), lambda m: F.array_max(F.transform(m, lambda s: F.struct(s["dice"].alias("dice"), F.translate(s["licence"], _ORDER, _REVERSED).alias("key"), s["licence"].alias("licence"), s["yields"].alias("yields")))))
    matched = source.select("doc_id", best.alias("matches"))
    seen = F.transform("matches", lambda m: m["licence"])
    top = F.array_max(_let(seen, lambda names: F.filter("matches", lambda m: ~F.arrays_overlap(m["yields"], names))))
    return matched.select("doc_id", top["licence"].alias("licence"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"))


#: Characters of licence names, and the same backwards: so that the greatest key is the name that sorts first.
_ORDER = "-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_REVERSED = _ORDER[::-1]
