"""License scans on notices as files carry them, most of them unlike any training text."""

import random

import pytest

from quillmark.llm import licenses

MIT = """Copyright (c) 2019 Jo Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""

#: (text, licence)
NOTICES = [
    (MIT, "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), ("The MIT License (MIT)", "MIT"), ("MIT License\n\nCopyright (c) 2021", "MIT"), ("// SPDX-License-Identifier: MIT", "MIT"), ("This module is distributed under the MIT license.", "MIT"),
    (APACHE, "Apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("This project is licensed under Apache License 2.0", "Apache-2.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("licensed under the Apache License, Version 1.1", "Apache-1.1"),
    (GPL.format(3), "GPL-3.0"), (GPL.format(2), "GPL-2.0"), ("GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("Released under the GPL v3", "GPL-3.0"), ("License: GPL-3.0", "GPL-3.0"), ("distributed under the terms of the GNU General Public License v2.0", "GPL-2.0"), ("You should have received a copy of the GNU General Public License\nalong with this program.", "GPL"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License", "LGPL-2.1"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"), ("License: LGPLv3", "LGPL-3.0"), ("licensed under the GNU Affero General Public License version 3", "AGPL-3.0"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"),
    ("it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License", "AGPL-3.0"),
    (BSD, "BSD"), ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD"), ("This code is under the 3-Clause BSD license", "BSD-3-Clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"), ("Licensed under the Mozilla Public License, version 1.1", "MPL-1.1"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v2.0", "EPL-2.0"), ("Released under the Eclipse Public License, version 1.0.", "EPL-1.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above", "ISC"), ("SPDX-License-Identifier: ISC", "ISC"), ("Licensed under the ISC license", "ISC"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify", "Unlicense"), ("SPDX-License-Identifier: Unlicense", "Unlicense"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event\nwill the authors be held liable for any damages arising from the use of this software.", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"), ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license", "BSL"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"), ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"), ("licensed under CC BY-ND 2.0", "CC-BY-ND-2.0"),
    ("To the extent possible under law, the authors have waived all rights: this is dedicated to the public domain under CC0 1.0 Universal", "CC0-1.0"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("under the Artistic License 2.0", "Artistic-2.0"),
    ("All rights reserved.", "Proprietary"), ("Copyright (c) 2011 Example Inc. All Rights Reserved.", "Proprietary"), ("No part of this publication may be reproduced or transmitted in any form.", "Proprietary"), ("Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "Proprietary"),
    ("Licensed under the European Union Public Licence v1.2", "unknown"), ("SPDX-License-Identifier: CDDL-1.1", "unknown"), ("Licensed under the Educational Community License, Version 2.0", "unknown"), ("This software is released under a custom license of our own", "unknown"), ("Licensed under the SIL Open Font License", "unknown"),
    ("The licence of this document is that of the archive that holds it", "unknown"), ("Distributed under the license agreement of the seller", "unknown"), ("Licensed under the W3C Software License", "unknown"),
    ("They had reserved all the rights to change the plan.", "none"), ("All rights reserved to change the plan.", "none"), ("She bought a fishing permit and a map.", "none"), ("The plates of the car were lost.", "none"), ("Boost your morning with an apple, free of charge.", "none"), ("It was a general public meeting about roads.", "none"),
    ("The eclipse was seen from the public square, version of events aside.", "none"), ("Common people attributed the rain to luck.", "none"),
]

#: Short and bare notices, British spelling, other licences and near misses; none is worded in the code.
WORDED = [
    ("GNU GPLv3", "GPL-3.0"), ("MIT licensed", "MIT"), ("Licence: MIT", "MIT"), ("Licence: GPLv2+", "GPL-2.0"), ("The project carries the MIT licence.", "MIT"), ("Code: MIT, see LICENCE.txt", "MIT"), ("Licensed under MIT", "MIT"), ("This gem is MIT-licensed software by its authors", "MIT"),
    ("Apache-2.0", "Apache-2.0"), ("SPDX: Apache-2.0", "Apache-2.0"), ("Published under the Apache Licence 2.0, as is our habit", "Apache-2.0"), ("we chose the Apache License for the whole tree", "Apache"), ("Dual licensed, Apache 2.0 for most parts", "Apache-2.0"), ("ASL 2.0 applies to the connector", "Apache"),
    ("GPL-3.0-or-later", "GPL-3.0"), ("GPLv2 only, sorry", "GPL-2.0"), ("This driver is GPL.", "GPL"), ("you get it under the GNU GPL v2 as always", "GPL-2.0"), ("subject to version 3 of the GNU General Public Licence", "GPL"), ("(C) 1999 Someone, GPL", "GPL"), ("the plugin inherits the GNU General Public License", "GPL"),
    ("LGPL-2.1-only", "LGPL-2.1"), ("bindings are LGPLv3", "LGPL-3.0"), ("covered by the GNU LGPL", "LGPL"), ("AGPL-3.0-only", "AGPL-3.0"), ("the hosted version is AGPLv3 code", "AGPL-3.0"), ("offered under the GNU AGPL to everybody", "AGPL"),
    ("BSD-3-Clause", "BSD-3-Clause"), ("BSD 2-clause licence", "BSD-2-Clause"), ("kernel parts keep their BSD licence", "BSD"), ("New BSD License applies here", "BSD"), ("MPL-2.0", "MPL-2.0"), ("add-ons: Mozilla Public Licence 2.0", "MPL-2.0"), ("Under MPL 1.1, alas", "MPL-1.1"),
    ("EPL-2.0", "EPL-2.0"), ("plug-in shipped under the Eclipse Public License", "EPL"), ("ISC licensed, like the rest", "ISC"), ("License: ISC (see the top of the tree)", "ISC"), ("zlib/libpng license", "Zlib"), ("we put it under the zlib licence", "Zlib"), ("Boost Software Licence 1.0 text attached", "BSL-1.0"),
    ("BSL-1.0", "BSL-1.0"), ("WTFPL, have fun", "WTFPL"), ("placed under the Unlicense by its author", "Unlicense"), ("same terms as Perl, the Artistic License", "Artistic"), ("CC0-1.0", "CC0-1.0"), ("images: CC0", "CC0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("photos CC BY 2.0 by their makers", "CC-BY-2.0"),
    ("slides are CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("CC BY-NC-ND 3.0", "CC-BY-NC-ND-3.0"), ("reuse under Creative Commons Attribution-NonCommercial 2.5 is fine", "CC-BY-NC-2.5"), ("articles share Creative Commons Attribution-ShareAlike 3.0 terms", "CC-BY-SA-3.0"), ("Maps CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("Licensed under the EUPL", "unknown"), ("License: OSL-3.0", "unknown"), ("Licensed under the Jam Public License", "unknown"), ("SPDX-License-Identifier: PostgreSQL", "unknown"), ("released under the Hippocratic License", "unknown"), ("Licensed under the terms of the Lucent Public License", "unknown"),
    ("Licence: see our shop", "unknown"), ("distributed under the Tiny Games Licence", "unknown"),
    ("his driving licence was taken away", "none"), ("the general of the public order came", "none"), ("a boost for zero sum games", "none"), ("Mit der Bahn fahren wir nach Hause, mit Freunden", "none"), ("the common share of the creative class", "none"), ("they permitted use of the house without a fee", "none"),
    ("a copy of the letter came along with this parcel", "none"), ("the artist wrote about his artistic years", "none"), ("the tribe of the Apache lived there", "none"), ("Mozilla opened an office near the eclipse museum", "none"), ("I reserved all the rooms, rights and wrongs aside", "none"),
]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    prose = "the of and to in a is that it for was on with as by at from they this have are or his not be which you all one there public free use software any person".split()
    rows = [(i, "\n".join(" ".join(rng.choice(prose) for _ in range(30)) for _ in range(4))) for i in range(300)]
    return licenses.fit(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("notices", [NOTICES, WORDED], ids=["as files carry them", "short or worded otherwise"])
def test_notices_precision_and_recall(spark, model, notices):
    rows = [(i, t) for i, (t, _) in enumerate(notices)]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    wrong = [(t[:70], want, got[i]) for i, (t, want) in enumerate(notices) if got[i] != want]
    named = lambda x: x not in ("none", "unknown")
    hit = sum(named(w) and got[i] == w for i, (_, w) in enumerate(notices))
    precision, recall = hit / sum(named(g) for g in got.values()), hit / sum(named(w) for _, w in notices)
    other = sum(not named(w) and got[i] == w for i, (_, w) in enumerate(notices)) / sum(not named(w) for _, w in notices)
    print("MEASURED", precision, recall, other, wrong)
    assert len(notices) >= 70 and precision >= 0.9 and recall >= 0.9 and other >= 0.75, wrong


def test_the_threshold_rejects(spark, model):
    assert 0.05 < model.threshold < 1


def test_every_window_is_scored_whatever_the_corpus(spark, model):
    """A notice gets the same answer in any corpus: the fit's sample is the only thing that a corpus adds."""
    docs = spark.createDataFrame([(1, "prose " * 300 + "MIT licensed"), (2, "prose " * 300)], "doc_id long, text string")
    assert licenses.windows(docs).count() == 8
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs, model).collect()}[2] == "none"


def test_notices_inside_long_texts(spark, model):
    rng = random.Random(5)
    prose = lambda n: "\n".join(" ".join(rng.choice("river stone walked over green hills slowly toward evening".split()) for _ in range(12)) for _ in range(n))
    rows = [(i, f"{prose(60)}\n{t}\n{prose(50)}") for i, (t, w) in enumerate(NOTICES) if w not in ("none", "unknown") and "\n\n" not in t]
    rows += [(500, prose(4000) + "\nLicensed under CC BY-SA 4.0.\n" + prose(4000)), (501, prose(500))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[500].license == "CC-BY-SA-4.0" and got[501].license == "none" and got[501].n_paragraphs == 1
    right = [got[i].license == NOTICES[i][1] for i, _ in rows[:-2]]
    assert sum(right) / len(right) >= 0.9


def test_awkward_rows(spark, llm_rows, model):
    docs = llm_rows.selectExpr("*", "1 AS grams", "'x' AS license", "2 AS p", "3 AS words", "4 AS key", "5 AS at")
    got = licenses.scan_licenses(docs, model).collect()
    assert len(got) == docs.count() and all(r.license == "none" for r in got), [(r.doc_id, r.license, r.confidence) for r in got]
    rows = [(1, "text\n\nReleased under the MIT License.\n\nAll rights reserved."), (1, "text\n\nReleased under the MIT License.\n\nAll rights reserved."), (None, "All rights reserved."), (2, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((str(r.doc_id), r.n_paragraphs, r.n_license, r.licenses) for r in got) == [("1", 3, 2, ["MIT", "Proprietary"])] * 2 + [("2", 0, 0, []), ("None", 1, 1, ["Proprietary"])]
    empty = licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_windows_that_cannot_count_are_not_scored_and_nothing_else_changes(spark, model, monkeypatch):
    rng = random.Random(9)
    texts = [t for t, _ in NOTICES + WORDED] + [t for ts in (*licenses.TEMPLATES.values(), *licenses.NAMES.values(), licenses.UNKNOWN_HELD, licenses.OTHER_HELD, licenses.PLAIN) for t in ts]
    said = [w for t in texts for w in t.split()]
    texts += [f"_{t}_" for t in texts[:60]] + [t.upper() for t in texts[:60]] + [f"mit {t} by".replace(" ", rng.choice(["-", "_", "  ", "/"])) for t in texts]
    for t in list(texts):  # parts of notices among other notices' words
        w = t.split()
        cut = rng.randint(0, len(w))
        texts.append(" ".join(rng.sample(said, 12) + w[cut // 2 : cut // 2 + max(1, 2 * len(w) // 3)] + rng.sample(said, 12)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pattern = licenses.needed_pattern(licenses.needed_words(model.templates))
    got = sorted(map(tuple, licenses.scan_licenses(docs, model).collect()))
    monkeypatch.setattr(licenses, "needed_pattern", lambda needed: "")
    assert got == sorted(map(tuple, licenses.scan_licenses(docs, model).collect())) and sum(r[4] != "none" for r in got) > 200
    prose = spark.createDataFrame([(1, "the general public is free to go by any work of this kind " * 50)], "doc_id long, text string")
    assert licenses.windows(prose).count() > 5 and licenses.windows(prose, pattern).count() == 0


def test_needed_words_leave_too_little_of_each_template():
    needed = licenses.needed_words({"A": [["gnu general", "general public", "public license", "gnu general public", "general public license"]], "B": [["cc by-sa", "by-sa", "#", "by-sa #", "cc by-sa #"]]})
    assert {"licens", "gnu", "by-sa"} <= needed and "general" not in needed
    assert licenses.needed_words({"A": [["#"]]}) == {""} and licenses.needed_pattern({""}) == ""  # nothing may be left out
