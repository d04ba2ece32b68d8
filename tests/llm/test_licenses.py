import math
import re

import pytest

from tidelog.llm import licenses as L

SF = "/root/testdata/sf0.01"


def brute(text):
    model, out = L.default_model(), []
    for line in (text or "").split("\n") if re.search(L.NAMED, text or "") else ():
        if not re.search(L.NAMED, line):
            continue
        g = L.grams(L._words(line))
        z = [(b + sum(model.weights[x][i] for x in g if x in model.weights) / math.sqrt(max(1, len(g)))) / model.temperature for i, b in enumerate(model.bias)]
        p = 1 / sum(math.exp(x - max(z)) for x in z)
        best = L.FAMILIES[z.index(max(z))]
        share = max((len(t & set(g)) / len(t) for f, t in model.templates if f == best), default=0)
        family = best if p >= L.LEAST else L.UNKNOWN
        out.append((family, family != L.UNKNOWN and share >= L.CONFIRM))
    return (len(out), sum(c for _, c in out), sum(not c and f != L.UNKNOWN for f, c in out), sum(f == L.UNKNOWN for f, _ in out), ",".join(sorted({f for f, c in out if c})))


ODD = [
    None, "", "plain", "Released under the MIT License.\n\nLicensed under the Apache License, Version 2.0.", "RELEASED UNDER THE MIT LICENSE", "He lost his driving license.\nLicense", "word " * 40000 + "\nLicensed under CC BY-NC 4.0.\n", "© copyright ümlaut licence\n\n",
]


def test_matches_brute_force(spark, frame):
    docs = frame(list(enumerate(ODD)) + [(3, ODD[3]), (None, ODD[3])])
    rows = L.scan(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert tuple(r)[1:] == brute(ODD[3 if r.doc_id is None else r.doc_id])
    assert L.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("family", L.FAMILIES[:-1])
def test_notices_are_known(family):
    for notice in L.NOTICES[family]:
        n, sure, *_, families = brute(notice)
        assert (n, sure, families) == (1, 1, family) or n == 0


def test_a_style_that_neither_fit_nor_temperature_saw():
    accuracy, error = L.measure(L.default_model())
    assert accuracy > 0.93 and error < 0.03
    assert brute("The licence fee for that radio was high, they said.")[1] == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert sum(x[1] for x in got.values()) >= 30


WRAPPED = {
    "MIT": "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction, including without limitation the rights\n// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n// copies of the Software, and to permit persons to whom the Software is\n// furnished to do so, subject to the following conditions:\n//\n// Other text.",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Copies retain this list.",
    "GPL": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main() {}",
    "MPL-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.\nimport os",
    "Apache-2.0": "Some prose here.\nDistributed under Apache 2.0.",
    "AGPL": "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License as published\n * by the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public License.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.",
    "Proprietary": "Copyright.\nAll rights reserved.\nUnauthorized copying of this\nfile is strictly prohibited.",
}


def test_wrapped_notices_and_notices_without_a_licensing_word(spark, frame):
    cases = [*WRAPPED.items(), ("GPL", "It is available under GPLv3."), ("", "no such\nnotice here\n" * 3), ("MIT", "- Released under the MIT License\n- other words\n- more words")]
    rows = L.scan(frame([(i, t) for i, (_, t) in enumerate(cases)])).collect()
    assert {r.doc_id: (r.families, r.n_confirmed) for r in rows} == {i: (f, int(f != "")) for i, (f, _) in enumerate(cases)}


def test_gate_covers_every_template():
    for _, own in L._templates():
        assert sum(not re.search(L.GATE, g) for g in own) < L.CONFIRM * len(own)
