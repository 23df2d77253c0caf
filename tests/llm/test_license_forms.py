"""Licence scan: common forms of a notice are found, neighbouring licences are told apart."""

from larder.llm import license_scan as LS

HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the {family} General Public License "
          "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
CASES = [
    ("This code is licensed under the MIT License by its authors", {"MIT"}),
    ("Released under the MIT License", {"MIT"}),
    ("you may use it, as distributed under the MIT license, anywhere", {"MIT"}),
    ("This work is licensed under the GNU General Public License, version 2", {"GPL-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3", {"GPL-3.0"}),
    ("Licensed under the GNU Lesser General Public License, version 3", {"LGPL-3.0"}),
    ("Licensed under the GNU Lesser General Public License v2.1 or later", {"LGPL-2.1"}),
    ("under the GNU Affero General Public License, version 3", {"AGPL-3.0"}),
    ("under version 2 of the GNU General Public License", {"GPL-2.0"}),
    (HEADER.format(family="GNU", version=3), {"GPL-header", "GPL-3.0"}),
    (HEADER.format(family="GNU", version=2), {"GPL-header", "GPL-2.0"}),
    ("Licensed under CC BY-NC 4.0", {"CC-BY-NC-4.0"}),
    ("Licensed under CC BY 4.0", {"CC-BY-4.0"}),
    ("Licensed under CC BY-NC-SA 4.0", {"CC-BY-NC-SA-4.0"}),
    ("Licensed under CC BY-NC 3.0", {"CC-BY-NC-3.0"}),
    ("under the Creative Commons Attribution 4.0 International licence", {"CC-BY-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License", {"CC-BY-SA-3.0"}),
    ("Use is governed by the Apache License, Version 2.0, of the foundation", {"Apache-2.0"}),
    ("Licensed under the Apache License, Version 1.1", set()),
    ("The public licence of the general, version 3, was read under the tree", set()),
]


def test_forms_and_neighbours(spark):
    whole = [(100 + k, "some words first " + text + " some words after", name) for k, (name, text) in enumerate(LS.WHOLE)]
    rows = [(k, f"one two three. {text}. four five six") for k, (text, _) in enumerate(CASES)] + [x[:2] for x in whole]
    found = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in
             LS.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {CASES[k][0]: found[k] for k in range(len(CASES))} == dict(CASES)
    assert all(name in found[k] for k, _, name in whole)
    assert "BSD-3-Clause-text" not in found[100 + [n for n, _ in LS.WHOLE].index("BSD-2-Clause-text")]


def test_a_required_phrase_of_own_templates_holds(spark):
    docs = spark.createDataFrame([(1, "see the house rules of our old club, edition 7"), (2, "see the house rules of our old club, edition 8")],
                                 "doc_id long, text string")
    own = spark.createDataFrame([("rules", "the house rules of our old club, edition 7", ["club edition 7"])],
                                "name string, text string, required array<string>")
    assert {r.doc_id: r.licenses for r in LS.license_scan(docs, own).collect()} == {1: "rules", 2: ""}
    assert {r.doc_id: r.licenses for r in LS.license_scan(docs, own.drop("required")).collect()} == {1: "rules", 2: "rules"}
