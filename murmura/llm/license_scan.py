"""License scan, in DataFrame functions only: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of letters and digits, lower-cased; shingles are three words (a notice of five words must have several).
A document's shingles are cut into windows of 8 that start every 4; a template likewise. Each of 16 bands is one min-hash
of a window, so windows of similarity s share a band with probability 1 - (1 - s) ** 16. A notice of 3 shingles lies in one
window whole, where its similarity is at least 3/8: 0.9995; one of 4, of which 3 are left, has 3/9 at least: 0.998; longer
ones do better, and a long template has many windows. Of a template that must be held whole (at 0.75, one of at most 3
shingles) the first shingle itself is looked for. Templates are a table, and so may be whole license texts: their
bands are joined with the documents' and a template met is verified on its shingles, the part of them that the whole document
holds having to reach the threshold. Windows and bands are rows, so that min-hashes are compiled code; only the few
(document, template) meetings are shuffled, and the texts they name are read again where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save
from .license_texts import TEXTS

SHINGLE, WINDOW, STRIDE, BANDS = 3, 8, 4, 16
#: Templates of at most so many shingles in all, and their keys, and meetings of at most so many documents may be broadcast.
BROADCAST_SHINGLES, BROADCAST_DOCS = 1_000_000, 500_000


def _gnu(kind: str, version: str, what: str = "program") -> list[str]:
    """The headers of a GNU license: the standard one, of one version, and the short one."""
    name = f"GNU {kind}General Public License"
    return [
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version",
        f"under the terms of the {name} version {version} as published by the Free Software Foundation",
        f"under the terms of the {name} as published by the Free Software Foundation, version {version}",
        f"licensed under the {name}, version {version}",
    ]


def _creative(code: str, name: str) -> list[str]:
    """Notices of a Creative Commons license and the first sentence of its body."""
    full = f"Creative Commons {name} 4.0 International"
    return [f"Licensed under CC {code} 4.0", f"licensed under a {full} License", f"licensed under the {full} License", f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {full} Public License"]


#: Fixed values by license: notices, headers, and passages of the bodies that other licenses' bodies don't have.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [*_gnu("Affero ", "3"), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"],
    "All-Rights-Reserved": ["All rights reserved"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document"],
    "Artistic-1.0": ["The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package"],
    "Artistic-2.0": ["under the terms of the Artistic License 2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Licensed under the 2-Clause BSD License", "Licensed under the 3-Clause BSD License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["Licensed under CC0 1.0", "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0", "licensed under the Eclipse Public License, version 2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "The purpose of this License is to make a manual, textbook, or other functional and useful document \"free\" in the sense of freedom"],
    "GPL-1.0": _gnu("", "1"),
    "GPL-2.0": [*_gnu("", "2"), "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"],
    "GPL-3.0": [*_gnu("", "3"), "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "Licensed under the ISC License"],
    "LGPL-2.0": _gnu("Library ", "2", "library"),
    "LGPL-2.1": [*_gnu("Lesser ", "2.1", "library"), "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it"],
    "LGPL-3.0": [*_gnu("Lesser ", "3", "library"), "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License, version 2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "Zlib": ["In no event will the authors be held liable for any damages arising from the use of this software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
}
#: Identifiers in file headers; the names above are SPDX's but for BSD's two and the notice that is no license.
for _name, _texts in TEMPLATES.items():
    if _name != "All-Rights-Reserved":
        _texts += [text for name, text in TEXTS if name == _name]
        _texts += [f"SPDX-License-Identifier: {x}" for x in (("BSD-2-Clause", "BSD-3-Clause") if _name == "BSD" else (_name,))]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str) -> Column:
    """64-bit hashes of each ``SHINGLE`` words in a row, in order."""
    n = F.size(words) - (SHINGLE - 1)
    rolled = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)]))
    return F.when(n >= 1, rolled).otherwise(F.array().cast("array<bigint>"))


def _windows() -> Column:
    """The windows of ``shingles`` as arrays; one, empty, without a shingle."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size("shingles"), F.lit(1)), F.lit(STRIDE)), lambda s: F.slice("shingles", s, WINDOW))


def _items() -> list[Column]:
    """The shingles of window ``w`` as columns x0..x7; a short window repeats its first, an empty one has nulls."""
    first = F.get("w", F.lit(0))
    return [F.coalesce(F.get("w", F.lit(j)), first).alias(f"x{j}") for j in range(WINDOW)]


def _keys(df: DataFrame, firsts: bool) -> DataFrame:
    """``df`` (with x0..x7) with a row for each ``key``: the min-hash of each band and, if wanted, the window's first
    ``STRIDE`` shingles, which over all windows are each shingle once."""
    extra = STRIDE if firsts else 0
    items, rest = [f"x{j}" for j in range(WINDOW)], [c for c in df.columns if c[0] != "x"]
    rows = df.select(*rest, *items, F.explode(F.array(*[F.lit(k) for k in range(BANDS + extra)])).alias("band"))
    key = F.when(F.col("band") < BANDS, F.least(*[F.when(F.col(x).isNotNull(), F.xxhash64(x, "band")) for x in items]))
    for j in range(extra):
        key = key.when(F.col("band") == BANDS + j, F.col(f"x{j}"))
    return rows.select(*rest, key.alias("key"))


def template_table(spark: SparkSession, templates: dict[str, list[str]] | DataFrame) -> DataFrame:
    """(template, license, whole): a number, the license and the distinct shingles in order of each of the templates, given
    as texts by license or as a table (license, text). A saved table."""
    if isinstance(templates, dict):
        templates = spark.createDataFrame([(name, text) for name, texts in sorted(templates.items()) for text in texts], "license string, text string")
    rows = templates.where("license IS NOT NULL").select("license", _words(F.col("text")).alias("words")).select("license", F.array_distinct(_shingles("words")).alias("whole"))
    return save(rows.where(F.size("whole") > 0).distinct().select(F.xxhash64("license", "whole").alias("template"), "license", "whole"), "templates")


def scan(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, containment: float = 0.75) -> DataFrame:
    """(doc_id, license, shingles, found, containment): a row for each license that a row of docs (doc_id, text) holds a
    template of, by its best template. A template all of whose found shingles are those of one found better (another
    version's notice, say) doesn't count.

    ``found`` of the template's ``shingles`` distinct shingles are in the whole text. Null and empty texts, and templates
    of fewer than three words, match nothing; doc_ids may repeat or be null, each row being judged by its own text; other
    columns are ignored. ``templates``: texts by license, or a table (license, text) of any size.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    total = table.agg(F.sum(F.size("whole"))).first()[0] or 0
    few = (lambda df: F.broadcast(df)) if total <= BROADCAST_SHINGLES else (lambda df: df)
    # at this threshold a template of few shingles must be held whole
    short = F.size("whole") - 1 < containment * F.size("whole")
    windows = table.where(~short).select("template", F.col("whole").alias("shingles")).select("template", F.explode(_windows()).alias("w")).select("template", *_items())
    of = _keys(windows, False).unionByName(table.where(short).select("template", F.get("whole", F.lit(0)).alias("key")))
    of = save(of.distinct(), "template-keys")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # shingles are a column of their own, as what a lambda refers to is computed in it
    shingled = lambda df, *more: df.select(*more, "doc_id", _words(F.col("text")).alias("words")).select(*more, "doc_id", _shingles("words").alias("shingles"))
    met = shingled(rows).select("doc_id", F.explode_outer(_windows()).alias("w")).select("doc_id", *_items())
    met = _keys(met, True).join(few(of), "key")
    met = save(met.groupBy("doc_id", "template").agg(F.lit(1).alias("once")).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("template").alias("templates")), "licenses-met")
    asked = F.broadcast(met) if met.count() <= BROADCAST_DOCS else met
    again = rows.withColumn("row", F.monotonically_increasing_id()).join(asked, F.col("doc_id").eqNullSafe(F.col("__doc")))
    each = shingled(again, "row", "templates").select("row", "doc_id", "shingles", F.explode("templates").alias("template"))
    held = each.join(few(table), "template").select("row", "doc_id", "license", F.size("whole").alias("of"), F.array_intersect("whole", "shingles").alias("held"))
    held = held.where(F.size("held") >= containment * F.col("of"))
    df = held.groupBy("row", "doc_id").agg(F.collect_list(F.struct("license", "of", "held")).alias("all"))
    part = lambda t: F.struct((F.size(t["held"]) / t["of"]).alias("containment"), t["of"].alias("shingles"))
    better = lambda u, t: part(u) > part(t)
    covers = lambda u, t: (u["license"] == t["license"]) | (F.size(F.array_except(t["held"], u["held"])) == 0)
    kept = F.filter("all", lambda t: ~F.exists("all", lambda u: better(u, t) & covers(u, t)))
    found = F.transform(kept, lambda t: F.struct(t["license"].alias("license"), t["of"].alias("shingles"), F.size(t["held"]).alias("found")))
    df = df.select("doc_id", F.explode(F.array_distinct(found)).alias("m"))
    return df.select("doc_id", "m.license", "m.shingles", "m.found", (F.col("m.found") / F.col("m.shingles")).alias("containment"))


def scan_sql(templates: dict[str, list[str]] | None = None, containment: float = 0.75, table: str = "documents") -> str:
    """DuckDB SQL for the same rows, by comparing every document with every template."""
    pairs = [(n, t) for n, all_texts in sorted((TEMPLATES if templates is None else templates).items()) for t in all_texts]
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in pairs)
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    rolled = f"list_transform(range(1, greatest(1, len(w) - {SHINGLE - 2})), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))"
    return f"""
WITH t AS (SELECT license, text, {words.format('text')} AS w FROM (VALUES {values}) AS v(license, text)),
ts AS (SELECT license, list_distinct({rolled}) AS s FROM t),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM {table}),
ds AS (SELECT doc_id, list_distinct({rolled}) AS s FROM d),
m AS (SELECT doc_id, license, len(ts.s)::INT AS shingles, list_intersect(ts.s, ds.s) AS held FROM ds, ts WHERE list_has_any(ts.s, ds.s)),
c AS (SELECT doc_id, license, shingles, held, len(held)::INT AS found, len(held)::DOUBLE / shingles AS containment FROM m WHERE len(held) >= {containment} * shingles)
SELECT DISTINCT doc_id, license, shingles, found, containment FROM c WHERE NOT EXISTS (SELECT 1 FROM c u WHERE u.doc_id = c.doc_id
  AND (u.containment > c.containment OR u.containment = c.containment AND u.shingles > c.shingles) AND (u.license = c.license OR list_has_all(u.held, c.held)))
"""
