"""Licence scan on planted notices and on documents."""

import random
import re
import textwrap

import pytest

from assay.llm import licences

SCHEMA = "doc_id long, text string, families int"


@pytest.fixture(scope="module")
def model():
    return licences.train()


def named(model, text):
    return model.verdict(model.features(licences._notice(text)[0])[1])[0]


def test_every_notice_is_named(model):
    assert [t for family, texts in licences.notices().items() for t in texts if named(model, t) != family] == []


SAID = {
    "Licensed under MIT License.": "mit", "Released under MIT License": "mit", "Distributed under the MIT License.": "mit", "This project is MIT licensed": "mit", "Licensed under Apache License, Version 2.0": "apache-2.0",
    "Licensed under Apache 2.0": "apache-2.0", "This work is licensed under the GNU GPL v3": "gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl-3.0", "Released to all under the MIT license, enjoy": "mit",
    "Licensed under the terms of our shop.": "unknown", "version 2.0 of the license plate": "unknown", "the apache helicopter": "unknown", "permission is granted": "unknown", "Licensed under the ISC License": "unknown",
    "Licensed under the Foobar License, version 3": "unknown", "Licensed under the GNU Lesser General Public License v3": "unknown", "all rights reserved": "unknown", "the mit campus": "unknown",
}


@pytest.mark.parametrize("text", SAID)
def test_wordings(model, text):
    assert named(model, text) == SAID[text]


def test_held_out_wordings(model):
    """Sentences and names that training has not seen, with words lost: precision and recall of the families."""
    rng = random.Random(1)
    patterns = ["Offered under the {}.", "All code here is under the {}, see below.", "Copyright 2020 Jane Doe. Licensed under the {}, no warranty.", "You may use it under the terms of the {} only."]
    others = ["Zlib License", "Boost Software License 1.0", "Unlicense", "Python Software Foundation License 2", "Common Public License 1.0", "Server Side Public License v1", "Microsoft Public License"]
    cases = [(f, p.format(n)) for f, names in licences.NAMES.items() for n in names if n != "MIT" for p in patterns] + [("unknown", p.format(n)) for n in others for p in patterns]
    for f, texts in licences.PARAGRAPHS.items():
        for t in texts:
            words = t.split()
            if len(words) > 15:
                cases += [(f, " ".join(w for w in words if rng.random() > 0.05)) for _ in range(5)]
    got = [(f, named(model, t)) for f, t in cases]
    right = sum(a == b != "unknown" for a, b in got)
    precision, recall = right / sum(b != "unknown" for _, b in got), right / sum(a != "unknown" for a, _ in got)
    print(f"precision {precision:.3f} recall {recall:.3f} of {len(cases)}")
    assert precision > 0.97 and recall > 0.9


def test_scan(spark):
    docs = [
        (1, "intro\nLicensed under the Apache License, Version 2.0. More prose here follows it.\nend"), (2, "Released under the\nMIT License."), (3, None), (4, ""), (None, "RELEASED UNDER THE MIT LICENSE!\nLicensed under CC BY-NC 4.0."),
        (5, "word " * 50_000 + "Licensed under CC BY-NC 4.0. " + "word " * 1000), (1, "..."),
    ]
    got = sorted(((r.doc_id, r.n_paragraphs, r.n_licensed, r.families) for r in licences.scan(spark.createDataFrame([(*d, 0) for d in docs], SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1, 1, "apache-2.0"), (2, 1, 1, "mit"), (3, 0, 0, ""), (4, 0, 0, ""), (None, 1, 1, "cc-by-nc-4.0,mit"), (5, 1, 1, "cc-by-nc-4.0"), (1, 0, 0, "")], key=str)
    assert licences.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents(spark):
    """The notices in the documents are these four sentences; the scan finds exactly them."""
    four = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(sorted(f for s, f in four.items() if re.search(re.escape(s), r.text))) for r in docs.collect()}
    got = {r.doc_id: r.families for r in licences.scan(docs).collect()}
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert any(want.values()) and len(wrong) <= 0.001 * len(want), wrong


def test_wrapped_notices(spark):
    """Notices wrapped at 70 columns, as comments too; neighbours in one paragraph are named each; a blank line ends a notice."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl, agpl = licences.PARAGRAPHS["gpl-3.0"][1], licences.PARAGRAPHS["agpl-3.0"][1]
    docs = [(k, "Copyright 2020 someone\n\n" + textwrap.fill(t, width) + "\n\nprose") for k, (t, width) in enumerate((t, width) for t in (mit, bsd, gpl, agpl) for width in (70, 40))]
    docs += [(8, "\n".join(f" * {x}" for x in textwrap.wrap(bsd, 70))), (9, "\n".join(f"# {x}" for x in textwrap.wrap(mit, 70)) + "\n#\n# end"), (10, "Released under the\nMIT License."), (11, "Released under the\n\nMIT License."), (12, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.n_paragraphs, r.n_licensed, r.families) for r in licences.scan(spark.createDataFrame([(*d, 0) for d in docs], SCHEMA)).collect()}
    want = {k: (3, 1, f) for k, f in enumerate(f for f in ("mit", "bsd-3-clause", "gpl-3.0", "agpl-3.0") for _ in range(2))}
    assert got == want | {8: (1, 1, "bsd-3-clause"), 9: (2, 1, "mit"), 10: (1, 1, "mit"), 11: (2, 0, ""), 12: (1, 1, "cc-by-nc-4.0,mit")}


def test_texts_without_any_notice_word(spark):
    got = licences.scan(spark.createDataFrame([(1, "zebra\n\nquokka", 0)], SCHEMA)).first()
    assert (got.n_paragraphs, got.n_licensed, got.families, got.score) == (2, 0, "", 0.0)
