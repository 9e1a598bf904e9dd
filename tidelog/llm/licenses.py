"""Licence scans: normalised passages against licence templates by the Dice coefficient of word bigrams.

Passages are the lines of a text, the whole text, and runs of its words across
line ends.  They are lower-cased, all but letters and digits becomes a space,
and their distinct word bigrams are compared with each template's:
2 |A and B| / (|A| + |B|).  As the smaller set bounds the intersection, a
template of size s can reach the threshold t only for passages of
s * t / (2 - t) to s * (2 - t) / t bigrams; others are skipped before any
comparison.

Runs are looked at for a template that no line and not the whole text matches,
and for each full licence text.  A text with fewer than s * t / (2 - t) of the
template's bigrams has no run that matches.  In the others every run is
compared that begins where a stretch of the template's bigrams begins, ends
where one ends, and is up to (2 - t) / t times as long as the template; a longer
or shorter end only adds bigrams the template lacks or drops some it has.  All
runs with one beginning are one pass of running counts, and only beginnings that
enough of the template's bigrams follow are looked at.  The best run counts: one
match for each template.

Null or empty texts and passages of one word match nothing; they give a row
with no licence.  Very long texts are scanned whole.  Every row of the input gives
one row, repeated ones too; an empty table gives none.  Extra columns are left
out, whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The customary wording of licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Complete licence texts, one file each.
TEXTS = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def _row_of(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bigrams_of(text: str) -> list[str]:
    return sorted(set(_row_of(text)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The passage sizes at which a template of `size` bigrams can reach the threshold."""
    slack = 1e-9
    return -int(-(size * threshold / (2 - threshold) - slack) // 1), int(size * (2 - threshold) / threshold + slack)


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _pairs(words):
    """Distinct bigrams of an array of words."""
    return F.when(
        F.size(words) > 1,
        F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))),
    ).otherwise(F.array().cast("array<string>"))


def _row(words):
    """All bigrams of an array of words, in order."""
    n = F.size(words) - 1
    return F.when(n > 0, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _let(value, f):
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _among(pairs) -> str:
    """SQL for "g is one of the bigrams": a hash lookup, whatever their number."""
    return f"g IN ({', '.join(repr(p) for p in sorted(pairs))})"


def _matches(name: str, pairs: list[str], threshold: float):
    """Structs (minus the coefficient, licence) of the passages that match one template."""
    (low, high), known, n = bounds(len(pairs), threshold), F.array(*[F.lit(p) for p in pairs]), len(pairs)
    fit = F.filter("__pairs", lambda p: (F.size(p) >= low) & (F.size(p) <= high))
    dice = F.transform(fit, lambda p: F.lit(2.0) * F.size(F.array_intersect(p, known)) / (F.size(p) + n))
    return F.transform(F.filter(dice, lambda d: d >= threshold), lambda d: F.struct((-d).alias("minus"), F.lit(name).alias("license")))


def _before(row):
    """For each place of a row of bigrams the place before it with the same bigram, -1 if there is none: two sorts."""
    of = lambda s: F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), F.when((k > 0) & (F.get(s, k - 1)["g"] == x["g"]), F.get(s, k - 1)["i"]).otherwise(-1).alias("b")))
    paired = _let(F.array_sort(F.transform(row, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), of)
    return F.transform(F.array_sort(paired), lambda x: x["b"])


def _best_run(pairs: list[str], length: int, threshold: float):
    """The best coefficient of the runs of __row that begin and end with a stretch of a template of `length` bigrams; null without one.

    A run is looked at only where enough of the template's bigrams follow its
    beginning.  Its end moves through the row once: a bigram is new to the run
    if its place before (__before) lies before the beginning, so the numbers of
    distinct bigrams, the template's and others, are running counts.
    """
    n, low, most = len(pairs), max(bounds(len(pairs), threshold)[0], 1), int(length * (2 - threshold) / threshold + 1e-9)
    marks = F.expr(f"transform(__row, (g, i) -> struct({_among(pairs)} AS hit, __before[i] AS before))")
    ended = lambda m: F.transform(m, lambda z, i: F.struct(z["hit"].alias("hit"), z["before"].alias("before"), (z["hit"] & ~F.coalesce(F.get(m, i + 1)["hit"], F.lit(False))).alias("stop")))

    def of(row, places):
        hits = F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        begins = F.filter(hits, lambda h: ((h["i"] == 0) | (F.get(places, h["i"] - 1) != h["p"] - 1)) & (F.get(places, h["i"] + low - 1) - h["p"] < most))

        def best(begin):
            def step(s, z):
                new = z["before"] < begin["p"]
                own, other = s["own"] + (new & z["hit"]).cast("int"), s["other"] + (new & ~z["hit"]).cast("int")
                dice = F.when(z["stop"], F.greatest(s["dice"], F.lit(2.0) * own / (own + other + n))).otherwise(s["dice"])
                return F.struct(own.alias("own"), other.alias("other"), dice.alias("dice"))

            start = F.struct(F.lit(0).alias("own"), F.lit(0).alias("other"), F.lit(0.0).alias("dice"))
            return F.aggregate(F.slice(row, begin["p"] + 1, most), start, step, lambda s: s["dice"])

        return F.array_max(F.transform(begins, best))

    places = lambda row: F.filter(F.transform(row, lambda z, i: F.when(z["hit"], i).otherwise(-1)), lambda i: i >= 0)
    return _let(_let(marks, ended), lambda row: _let(places(row), lambda p: of(row, p)))


def _may(text: str, near: str, threshold: float, unless=None):
    """Whether a text has enough of a template's bigrams for a run of it to match, and nothing before matched the template."""
    pairs = bigrams_of(text)
    known, low = F.split(F.lit("\n".join(pairs)), "\n"), max(bounds(len(pairs), threshold)[0], 1)
    may = (F.size(near) >= low) & (F.size(F.array_intersect(F.col(near), known)) >= low)
    return may if unless is None else may & (F.size(unless) == 0)


def _inside(name: str, text: str, may: str, threshold: float):
    """At most one struct like those of _matches: the best run of a text that matches one template."""
    pairs, length = bigrams_of(text), len(_row_of(text))
    none = F.array().cast("array<struct<minus:double,license:string>>")
    found = _let(_best_run(pairs, length, threshold), lambda d: F.when(d >= threshold, F.array(F.struct((-d).alias("minus"), F.lit(name).alias("license")))).otherwise(none))
    return F.when(F.col(may), found).otherwise(none)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates=TEMPLATES, texts=TEXTS) -> DataFrame:
    """id, n_matches, licenses (distinct, sorted, joined by commas), best_license and best_dice (null without a match)."""
    sets = [(name, bigrams_of(text)) for name, text in templates]
    sets = [(name, pairs) for name, pairs in sets if pairs]
    largest = max((bounds(len(p), threshold)[1] for _, p in sets), default=0)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.split(text, "\n").alias("__lines"), text.alias("__text"))
    # The whole text counts only where it has several lines; its size is bounded like any passage's.
    words = F.transform("__lines", lambda x: F.split(_normal(x), " "))
    rows = rows.select(id_col, words.alias("__words"))
    together = F.flatten("__words")
    few = F.size(F.array_distinct(together)) <= 2 * largest + 2
    every = F.when((F.size("__words") > 1) & few, F.array(F.filter(together, lambda w: w != ""))).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.select(id_col, F.transform(F.concat("__words", every), _pairs).alias("__pairs"), _row(F.filter(together, lambda w: w != "")).alias("__row"))
    short, full = [(name, t) for name, t in templates if bigrams_of(t)], [(name, t) for name, t in texts if bigrams_of(t)]
    known, noticed = ({p for _, t in x for p in bigrams_of(t)} for x in (short + full, short))
    near = lambda column, pairs: F.expr(f"filter({column}, g -> {_among(pairs)})" if pairs else f"slice({column}, 1, 0)")
    rows = rows.select("*", F.array_distinct(near("__row", known)).alias("__near"))
    rows = rows.select("*", near("__near", noticed).alias("__noticed"), *[_matches(name, pairs, threshold).alias(f"__m{i}") for i, (name, pairs) in enumerate(sets)])
    templates_of_runs = [(name, t, "__noticed", f"__m{i}") for i, (name, t) in enumerate(short)] + [(name, t, "__near", None) for name, t in full]
    flags = [f"__may{i}" for i in range(len(templates_of_runs))]
    rows = rows.select("*", *[_may(t, column, threshold, unless).alias(flag) for flag, (_, t, column, unless) in zip(flags, templates_of_runs)])
    any_may = F.expr(" OR ".join(flags) or "false")
    rows = rows.withColumn("__before", F.when(any_may, _before(F.col("__row"))).otherwise(F.array().cast("array<int>")))  # sorted only where a run is looked for
    matches = [f"__m{i}" for i in range(len(sets))] + [_inside(name, t, flag, threshold) for flag, (name, t, _, _) in zip(flags, templates_of_runs)]
    found = F.flatten(F.array(*matches)) if matches else F.array().cast("array<struct<minus:double,license:string>>")
    rows = rows.select(id_col, found.alias("__found"))
    best = F.array_min("__found")
    return rows.select(
        id_col,
        F.size("__found").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda m: m["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        F.round(-best["minus"], 6).alias("best_dice"),
    )


def scanned_sql(threshold: float = 0.8, templates=TEMPLATES) -> str:
    """The same rows in DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, [{', '.join(map(quoted, bigrams_of(text)))}])" for i, (name, text) in enumerate(templates))
    normal = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
    WITH templates(tid, license, bigrams) AS (VALUES {values}),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    whole AS (SELECT doc_id, text AS line FROM documents WHERE contains(text, chr(10))),
    words AS (SELECT row_number() OVER () AS uid, doc_id, string_split({normal.format('line')}, ' ') AS w FROM (SELECT * FROM lines UNION ALL SELECT * FROM whole)),
    units AS (SELECT uid, doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM words WHERE len(w) > 1),
    short AS (SELECT * FROM units WHERE len(b) <= 400),
    dice AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS d FROM short, templates),
    found AS (SELECT * FROM dice WHERE d >= {threshold}),
    best AS (SELECT doc_id, count(*)::INTEGER AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
        first(license ORDER BY d DESC, license) AS best_license, round(max(d), 6) AS best_dice FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(n_matches, 0)::INTEGER AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
    FROM documents LEFT JOIN best USING (doc_id)
    """
