"""Licence notices over several lines, and lines that name several."""

import random

import pytest

from vigil.llm import licences

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above"""
APACHE = """ * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0"""
AGPL = GPL.replace("General", "Affero General")
LGPL = GPL.replace("program", "library").replace("General", "Lesser General")
CASES = [
    (GPL, {"gpl"}), (BSD, {"bsd"}), (ISC, {"isc"}), (APACHE, {"apache"}), (LGPL, {"lgpl"}), ("words before\nthat say nothing\n" + BSD + "\nand after", {"bsd"}), (GPL + "\n\n" + BSD, {"gpl", "bsd"}),
    ("Released under the MIT license or the Apache License, Version 2.0.", {"mit"}),
    ("Licensed under the MIT license or licensed under the Apache License, Version 2.0.", {"mit", "apache"}),
    ("This work is licensed under the GNU Affero General Public License, version 3", {"agpl"}), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("Released under the MIT License.", {"mit"}),
]


@pytest.fixture(scope="module")
def model():
    return licences.LicenceModel()


def sure(model, text):
    return {x["family"] for x in licences.statements(model, text.lower()) if x["confirmed"]}


@pytest.mark.parametrize("text,families", CASES)
def test_families(model, text, families):
    got = sure(model, text)
    assert families <= got and got <= families | ({"apache"} if "Apache" in text else set()), got


def test_no_neighbour_family(model):
    assert "gpl" not in sure(model, AGPL) | sure(model, LGPL)
    for text in ("the terms of the\nparty were modified\nas published by the paper", "released under\nthe pressure of the crowd", "he lost his driving\nlicense last year"):
        assert not sure(model, text)


@pytest.mark.parametrize("family", sorted(licences.TEMPLATES))
def test_wrapped_templates(model, family):
    for t in licences.TEMPLATES[family]:
        for width in (2, 4, 7):
            w = t.split()
            wrapped = "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))
            assert sure(model, wrapped) == {family}, (wrapped, sure(model, wrapped))


def test_digest(spark):
    d = spark.createDataFrame([(1, GPL), (2, BSD + "\n\n" + ISC), (3, "nothing\nhere")], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_licences) for r in licences.digest(licences.scan(d)).collect()}
    assert got == {1: ("gpl", 1), 2: ("bsd,isc", 2), 3: ("", 0)}


def test_unscored_spans_could_not_be_reported(model):
    """The bound that the marks rest on, and random spans without a mark."""
    import math
    import random

    limit = math.log(licences.MIN_PROBABILITY / (1 - licences.MIN_PROBABILITY))
    assert all(odds < limit for odds, _, _ in model.unmarked_odds(model.marked_words))
    rng = random.Random(8)
    plain = sorted({w for g in model.index for w in g.split()} - model.marked_words)
    for _ in range(3000):
        line = " ".join(rng.choice(plain) for _ in range(rng.randint(1, 12)))
        assert model.marks.search(line) or model.classify(line) is None


def test_each_notice_once(model):
    for text, family in ((GPL, "gpl"), (BSD, "bsd"), (ISC, "isc"), (APACHE, "apache"), (LGPL, "lgpl")):
        for shown in (text, "prose before it\n" + text + "\nprose after it", "\n".join("// " + x for x in text.split("\n"))):
            assert [x["family"] for x in licences.statements(model, shown.lower()) if x["confirmed"]] == [family], shown


def test_the_classifier_decides():
    """No statement stands on a template alone; denials and other projects' identifiers are none; recall on varied templates."""
    rng = random.Random(1)
    model = licences.LicenceModel()
    plain = "the a meeting was held in spring and nobody knew why it began with such words as river stone paper".split()
    found = whole = wrong = total = 0
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            for k in range(10):
                words = t.split() if k < 3 else [w for w in t.split() if rng.random() > 0.1]
                text = " ".join([rng.choice(plain) for _ in range(rng.randrange(6))] + words + [rng.choice(plain) for _ in range(rng.randrange(6))])
                sure = [s for s in licences.statements(model, text) if s["confirmed"]]
                assert all(s["probability"] >= licences.MIN_PROBABILITY for s in sure)
                hit = any(s["family"] == family for s in sure)
                whole += hit and k < 3
                found, total, wrong = found + hit, total + 1, wrong + any(s["family"] != family for s in sure)
    assert found / total > 0.85 and whole / (0.3 * total) > 0.93 and wrong / total < 0.02, (found / total, whole / (0.3 * total), wrong / total)
    for text, want in {
        "SPDX-License-Identifier: GPL-3.0-or-later": ["gpl"], "SPDX-License-Identifier: BSD-3-Clause": ["bsd"], "// SPDX-License-Identifier: MPL-2.0": ["mpl"], "SPDX-License-Identifier: Zlib": ["zlib"],
        "SPDX-License-Identifier: Foo-1.0": [], "this project is not licensed under the MIT license": [], "It is no longer released under the GPL version 2.": [], "Licensed under the MIT License.": ["mit"],
        "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0": ["epl"],
    }.items():
        assert [s["family"] for s in licences.statements(model, text.lower()) if s["confirmed"]] == want, text
