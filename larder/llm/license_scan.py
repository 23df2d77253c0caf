"""License scans by MinHash bands, in DataFrame operations only.

Every document is cut into overlapping windows of ``WINDOW`` words, ``STRIDE`` apart; a window's set is its shingles of three
words. Templates are cut at every position. Each of ``bands`` bands is the least digest of the set under a hash of
its own; a document window that agrees with a template window in any band retrieves the template. The region around the
window, wide enough for the whole template, is then compared exactly: the share of the template's distinct shingles that
it holds must reach ``containment``, and no shingle of the template's ``required`` phrases (optional; the version and the
family) may be missing. A name may have several forms, each a template of its own.

Any passage of seven or more template words holds a whole document window (similarity 1, retrieved for certain). The least
case, a three-word notice among other words, has similarity 1/3 and is retrieved with probability 1 - (2/3)**bands: 0.998
with the 16 bands set here.

The templates are a parameter, a few hundred at most: their band keys are part of the plan and filter the windows inside
the generated stage that reads the texts. Windows that agree in some band, few in any corpus, are joined to the templates
and verified there; matches are combined map-side per document and template.

Defined cases: null or empty texts, and texts of fewer than three words, match nothing; repeated rows and null ids get
their own rows; extra columns are ignored; templates of fewer than three words are refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import content_key, keyed, stored
from .textwords import join_small, shingle_at, split_words

WINDOW, STRIDE, SHINGLE = 5, 3, 3

#: Short notices and first sentences of public licences, by SPDX-like name
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("All-rights-reserved", "All rights reserved"),
)


#: Public licences and standard notices at full length (the long ones by their notice)
WHOLE = (
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the 'Software'), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY"
     " KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
     "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
     " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
     " THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
     "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
     "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
     " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
     "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
     "holder nor the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
     "binary, for any purpose, commercial or non-commercial, and by any means."),
)


def _variants() -> list[tuple[str, str, list[str]]]:
    """(name, text, phrases of which no shingle may be missing): common forms of the notices. The phrases carry what tells
    neighbouring licences apart: the version and the family."""
    out = [("MIT", "under the MIT License", []), ("MIT", "The MIT License (MIT)", []), ("MIT", "licensed under MIT", []),
           ("Apache-2.0", "Apache License, Version 2.0", ["License Version 2.0"]), ("Apache-2.0", "Apache License 2.0", ["Apache License 2.0"]),
           ("Apache-2.0", "Apache 2.0 License", ["Apache 2.0 License"]),
           ("MPL-2.0", "Mozilla Public License, v. 2.0", ["License v 2.0"]), ("MPL-2.0", "Mozilla Public License, version 2.0", ["License version 2.0"]),
           ("MPL-2.0", "Mozilla Public License 2.0", ["License 2.0"])]
    for short, family, versions in (("GPL", "GNU", ("2", "3")), ("LGPL", "GNU Lesser", ("2.1", "3")), ("AGPL", "GNU Affero", ("3",)),
                                    ("LGPL", "GNU Library", ("2",))):
        for version in versions:
            name = f"{short}-{version if '.' in version else version + '.0'}"
            begin = f"{family} General Public License"
            forms = [(f"{begin}, version {version}", f"Public License version {version}"), (f"{begin} v{version}", f"Public License v{version}"),
                     (f"{begin} {version}", f"Public License {version}"), (f"version {version} of the {begin}", f"version {version} of the")]
            forms += [(f"{begin} as published by the Free Software Foundation{middle} version {version} of the License", f"version {version} of the License")
                      for middle in (", either", ",")]
            out += [(name, text, [f"{family} General Public", carries]) for text, carries in forms]
            if family != "GNU Library":  # "LGPL version 2" also begins "LGPL version 2.1"
                out += [(name, f"{short} version {version}", [f"{short} version {version}"])]
    for marks, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                         ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                         ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for version in ("3.0", "4.0"):
            out += [(f"CC-{marks}-{version}", f"CC {marks} {version}", [f"CC {marks} {version}"]),
                    (f"CC-{marks}-{version}", f"Creative Commons {words} {version}", [f"Creative Commons {words} {version}"])]
    return out + [("CC0-1.0", "CC0 1.0 Universal", ["CC0 1.0 Universal"])]


#: Phrases that the built-in notices may not miss
REQUIRED = {"GPL-3.0": ["License version 3"], "Apache-2.0": ["Version 2.0"], "MPL-2.0": ["v 2.0"], "CC-BY-NC-4.0": ["BY-NC 4.0"],
            "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0"], "BSD-3-Clause-text": ["Neither the name of"], "Apache-2.0-notice": ["Version 2.0"]}


def default_templates(spark: SparkSession) -> DataFrame:
    """``name, text, required`` of the built-in templates; a name has as many rows as its licence has forms."""
    rows = [(n, t, REQUIRED.get(n, [])) for n, t in (*TEMPLATES, *WHOLE)] + _variants()
    return spark.createDataFrame(rows, "name string, text string, required array<string>")


def _prints(words: str, at: Column) -> Column:
    """One-row array of the shingles' digests of the window of ``words`` at ``at``; past the end the first stands in."""
    first, *rest = [shingle_at(words, at + k, SHINGLE) for k in range(WINDOW - SHINGLE + 1)]
    return F.array(F.struct(first.alias("p0"), *(F.coalesce(p, first).alias(f"p{k}") for k, p in enumerate(rest, 1))))


def _key(band: int) -> Column:
    """A band's key: the least of the digests, hashed anew for each band."""
    return F.least(*(F.xxhash64(f"p{k}", F.lit(band)) for k in range(WINDOW - SHINGLE + 1)))


def _keys(bands: int) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(b).alias("band"), _key(b).alias("key")) for b in range(bands)))).alias("b")


def _shingles(words: str | Column) -> Column:
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda k: F.xxhash64(F.slice(words, k, SHINGLE))))


def matches(docs: DataFrame, templates: DataFrame, bands: int = 16, containment: float = 0.8,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, part, name, first_word, containment``: templates that a document's text holds."""
    rows = keyed(docs, id_col, text_col).select("id", content_key().alias("part"), split_words("text").alias("words"))
    clean = lambda text: F.filter(split_words(text), lambda x: x != "")
    phrases = F.col("required") if "required" in templates.columns else F.lit(None).cast("array<string>")
    own = templates.select("name", F.xxhash64("text", phrases).alias("form"), clean("text").alias("own"),
                           F.coalesce(phrases, F.array().cast("array<string>")).alias("phrases"))
    own = own.select("name", "form", "own", "phrases", F.raise_error(F.lit("a template needs three words")).alias("_")).filter(
        F.size("own") < SHINGLE).drop("_").unionByName(own.filter(F.size("own") >= SHINGLE))
    own = own.withColumn("shingles", _shingles("own")).withColumn(
        "must", F.array_distinct(F.flatten(F.transform("phrases", lambda p: _shingles(clean(p))))))
    kept = ["name", "form", "size", "shingles", "must"]
    cut = own.select("name", "form", F.size("own").alias("size"), "shingles", "must", "own",
                     F.explode(F.sequence(F.lit(0), F.greatest(F.size("own") - WINDOW, F.lit(0)))).alias("at"))
    cut = cut.select(*kept, F.inline(_prints("own", F.col("at")))).select(*kept, _keys(bands))
    index = stored(cut.select("b.band", "b.key", *kept).dropDuplicates(["band", "key", "name", "form"]), "template-bands")
    listed = index.groupBy("band").agg(F.collect_set("key").alias("keys")).limit(bands).collect()  # of the templates only

    # a generated row for each window; only those that agree with a template in some band go on with their words
    starts = rows.filter(F.size("words") >= SHINGLE).select("id", "part", "words", F.explode(
        F.sequence(F.lit(0), F.size("words") - SHINGLE, F.lit(STRIDE))).alias("at"))
    prints = starts.select("id", "part", "words", "at", F.inline(_prints("words", F.col("at"))))
    agrees = reduce(Column.__or__, (_key(r["band"]).isin(r["keys"]) for r in listed), F.lit(False))
    keys = prints.filter(agrees).select("id", "part", "words", "at", _keys(bands)).select(
        "id", "part", "words", "at", "b.band", "b.key")
    begin = F.greatest(F.col("at") - F.col("size"), F.lit(0))
    region = F.slice("words", begin + 1, F.col("at") + F.col("size") + WINDOW - begin)
    share = F.size(F.array_intersect("there", F.col("shingles"))) / F.size("shingles")
    lacks = F.size(F.array_except("must", F.col("there")))
    return (join_small(keys, index, ["band", "key"]).select("id", "part", "name", "at", "shingles", "must", _shingles(region).alias("there"))
            .select("id", "part", "name", "at", share.alias("share"), lacks.alias("lacks"))
            .filter((F.col("share") >= containment) & (F.col("lacks") == 0))
            .groupBy("id", "part", "name").agg(F.min("at").alias("first_word"), F.max("share").alias("containment")))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, bands: int = 16, containment: float = 0.8,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_licenses, licenses, containment`` per row: the names found, sorted and comma-joined, and the least of
    their containments (null where none is found)."""
    templates = default_templates(docs.sparkSession) if templates is None else templates
    found = (matches(docs, templates, bands, containment, id_col, text_col).groupBy("id", "part")
             .agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("licenses"),  # at most the templates
                  F.count(F.lit(1)).alias("n"), F.min("containment").alias("containment"))).alias("m")
    rows = keyed(docs, id_col, text_col).select("id", content_key().alias("part")).alias("b")
    return (rows.join(found, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.part") == F.col("m.part")), "left")
            .select(F.col("b.id").alias("doc_id"), F.coalesce("m.n", F.lit(0).cast("long")).alias("n_licenses"),
                    F.coalesce("m.licenses", F.lit("")).alias("licenses"), "m.containment"))
