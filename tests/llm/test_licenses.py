import pytest

from headway.llm import licenses as L

PLAIN = ["The river runs under the old bridge while people walk home.", "A driver needs a license to drive.", "Terms of the plan, version 2.0 of the table", "", "of the the of"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "\n".join(PLAIN[j % 5] for j in range(i, i + 3)), "x") for i in range(60)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, family string"))


def test_families_unknown_and_none(spark, model):
    mit = L.TEMPLATES["mit"][2].split()
    texts = {
        "mit": ["Released under the MIT License.", " ".join(mit[:14]), " ".join(mit[20:34]) + "\n" + PLAIN[0]],
        "apache-2.0": ["  licensed under the APACHE license, version 2.0", PLAIN[0] + "\n" + L.TEMPLATES["apache-2.0"][1]],
        "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3."],
        "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
        "": ["Licensed under the Wombat License.", *PLAIN, None],
    }
    rows = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    got = {r["doc_id"]: r for r in L.scan(docs, model).collect()}
    assert [got[i]["families"] for i, _, _ in rows] == [f for _, _, f in rows]
    wombat = next(i for i, t, _ in rows if t and "Wombat" in t)
    assert got[wombat]["n_unknown"] == 1 and got[wombat]["n_confirmed"] == 0
    assert all(got[i]["n_paragraphs"] == (t or "").count("\n") + 1 for i, t, _ in rows)


def test_held_back_variants(spark, model):
    held = L.notices(spark).filter("held and label > 1").select("label", "paragraph")
    got = L.classify(held, model)
    n, right = held.count(), got.filter(f"family = element_at(array({','.join(repr(c) for c in L.CLASSES)}), cast(label as int) + 1)").count()
    assert n > 100 and right / n > 0.85


def test_rows_are_kept_as_they_come(spark, model):
    notice = "Released under the MIT License.\nmore\nLicensed under the Zebra License."
    docs = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "word " * 50_000), (2, notice), (2, notice), (2, "other"), (None, notice), (3, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_paragraphs"], r["n_licenses"], r["families"], r["n_unknown"]) for r in L.scan(docs, model).collect())
    assert got == [("1", 1, 0, "", 0), ("2", 1, 0, "", 0), ("2", 3, 2, "mit", 1), ("2", 3, 2, "mit", 1), ("3", 1, 0, "", 0), ("None", 1, 0, "", 0), ("None", 1, 0, "", 0), ("None", 3, 2, "mit", 1)]


#: Wordings that are no template, frame or name in a known frame, by hand; licences without a family are unknown.
WORDINGS = {
    "mit": ["This library is free software under the MIT license", "// MIT License", "You can do anything with it, it's MIT licensed!", "Code published here is offered to you under the terms of the MIT licence."],
    "apache-2.0": ["Everything in this repo is Apache 2.0", "Portions of this page are licensed under the Apache License, Version 2.0, and reproduced with thanks", "apache-2.0 licensed", "(c) the authors, provided to you under the Apache License v2.0"],
    "gpl-3.0": ["The plugin is GPLv3, so share your changes", "Free as in freedom: GNU GPL v3 or later", "Source is provided under GPL-3.0-only", "you may copy it if you respect the GNU General Public License version 3"],
    "gpl-2.0": ["Kernel modules are under GPLv2", "the driver is shipped under the GNU General Public License version 2 only", "SPDX-License-Identifier: GPL-2.0-or-later", "It is GPL v2, as always"],
    "lgpl": ["You can link to it, it is LGPL", "covered by the GNU Lesser General Public License 3", "parts: LGPL-2.1-or-later"],
    "agpl-3.0": ["Our server is AGPLv3", "Network use counts: GNU Affero General Public License", "The hosted version is under AGPL-3.0-or-later."],
    "bsd": ["a permissive 3-clause BSD notice applies", "Copyright (c) 2019, see the BSD license", "BSD-2-Clause, like its parent", "it's offered under a BSD style license"],
    "mpl-2.0": ["file-level copyleft under MPL 2.0", "Subject to the Mozilla Public License", "MPL-2.0 applies to all sources"],
    "cc-by": ["Text is available under CC BY 3.0.", "Photos by the author, CC-BY-4.0", "you are free to share this under a Creative Commons Attribution 4.0 license"],
    "cc-by-sa": ["… available under CC BY-SA 3.0.", "Images: CC-BY-SA-4.0", "This article uses material under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["No sales please: CC BY-NC 3.0", "the recordings are CC-BY-NC-4.0", "shared with a Creative Commons Attribution-NonCommercial licence"],
    "cc0": ["Data is dedicated to everyone with CC0", "no rights reserved, CC0 1.0", "metadata is CC0-1.0"],
    "isc": ["ISC licensed, have fun", "the ISC License governs these files", "SPDX-License-Identifier: ISC"],
    "unknown": ["Licensed under the Walrus Open License.", "This data set is distributed under the terms of the Pelican license.", "Released under the Bluebird Public License, version 3."],
    "": ["Wir gehen mit ihr in die Stadt und kommen mit dem Zug", "MIT and Harvard are both on the river", "An apache dance troupe performed version 2 of the piece", "Your driving licence is no longer valid", "Attribution of the painting is uncertain", "He was the general of a public army", "The commons were crowded", "Clause three of the contract is void", "They mit each other in a typo", "The public domain of the king was large", "permission to enter is granted to any person with a ticket", "Der Hund ging mit Lizenz an der Leine"],
}


def test_wordings_that_were_not_taught(spark, model):
    """Recall and precision on hand-written lines; the README has the figures."""
    rows = [(f, t) for f, texts in WORDINGS.items() for t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(docs, model).collect()}
    named = {i: r["families"] if r["n_confirmed"] else "unknown" if r["n_unknown"] else "" for i, r in got.items()}
    family = [i for i, (f, _) in enumerate(rows) if f not in ("unknown", "")]
    right = sum(named[i] == rows[i][0] for i in family)
    said = [i for i in named if named[i] not in ("unknown", "")]
    wrong = [(rows[i], named[i], round(got[i]["probability"], 2)) for i in named if named[i] != rows[i][0]]
    print(f"recall {right}/{len(family)}, precision {right}/{len(said)}, wrong {wrong}")
    assert right >= 0.9 * len(family) and right >= 0.95 * len(said), wrong


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(docs, L.fit(docs)).count() == 0


def test_no_python_in_the_plan(spark, model):
    plan = L.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
