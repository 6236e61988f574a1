"""Operator 4, license scans: a trained paragraph classifier, in DataFrame and ML functions only.

A paragraph is a run of lines that are not blank, joined by spaces, so wrapped
notices stay whole; long ones are read in windows of ``WINDOW`` words that overlap.
Word bigrams and trigrams of a window, with numbers as ``#``, and the single words
that licences are called by are counted against the vocabulary of the notices. A
multinomial logistic regression with an elastic net, fitted by Spark ML, names the
licence family, ``unknown`` for licence wording of no known family, or ``none``. It is
fitted on stated notices, on the families' names in common phrasings, on the same
phrasings with names of other licences, and on a bounded sample of corpus windows for
``none``. A window is scored unless its paragraph holds no word that a window which
counts must hold (``needed_words``): the answers are those of scoring every window.

The threshold is calibrated on notices, other licences and near misses that the fit
has not seen: a family is named only if its probability reaches the threshold and the
window holds enough of one of its templates; else the window is ``unknown``, which a
word of licences or rights must confirm. The version is read from the words after the licence's name; without one the licence is
just the family.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, text_key

#: How each family is commonly stated. The numbers stand for any version.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "MIT License", "Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "License: MIT", "The MIT License (MIT)", "the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache": [
        "Apache License", "Apache License 2.0", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "License: Apache 2.0", "the Apache Software License",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "GNU General Public License", "GNU General Public License v2.0", "License: GPL-3.0", "licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0", "License: GPLv3", "GNU GPL version 2", "under the GPL",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation", "a copy of the GNU General Public License along with this program",
    ],
    "LGPL": [
        "GNU Lesser General Public License", "licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later", "License: LGPLv3", "under the LGPL", "GNU Library General Public License",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "a copy of the GNU Lesser General Public License along with this library",
    ],
    "AGPL": [
        "GNU Affero General Public License", "licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later", "License: AGPLv3", "under the AGPL",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "a copy of the GNU Affero General Public License along with this program",
    ],
    "BSD": [
        "BSD License", "the 3-Clause BSD license", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD", "governed by a BSD-style license", "the simplified BSD license", "under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": [
        "Mozilla Public License", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "License: MPL 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
    ],
    "EPL": ["Eclipse Public License", "made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License, version 1.0", "SPDX-License-Identifier: EPL-2.0", "License: EPL 2.0"],
    "ISC": ["ISC License", "Licensed under the ISC License", "SPDX-License-Identifier: ISC", "License: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "License: Unlicense", "This is free and unencumbered software released into the public domain"],
    "Zlib": ["zlib license", "Licensed under the zlib license", "SPDX-License-Identifier: Zlib", "License: zlib", "In no event will the authors be held liable for any damages arising from the use of this software"],
    "BSL": [
        "Boost Software License", "Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", "License: Boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "WTFPL": ["SPDX-License-Identifier: WTFPL", "License: WTFPL", "Do What The Fuck You Want To Public License"],
    "Artistic": ["Artistic License", "under the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0", "License: Artistic 2.0", "the terms of the Perl Artistic License"],
    "CC0": ["dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "License: CC0", "the CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "CC-BY": ["Creative Commons Attribution 4.0", "CC BY", "Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "License: CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA", "Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "License: CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC", "Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "License: CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND", "Licensed under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0", "License: CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License"],
    "CC-BY-NC-SA": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA", "Licensed under CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "License: CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND", "Licensed under CC BY-NC-ND 4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "License: CC BY-NC-ND 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "Proprietary": ["All rights reserved.", "no part of this publication may be reproduced", "may not be copied or distributed without the prior written permission", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
#: Further notices, to calibrate on only.
HELD: dict[str, list[str]] = {
    "MIT": ["This library may be used under the MIT license, see LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this work and associated files to deal in the software without restriction"],
    "Apache": ["Code is available under the Apache License 2.0", "Use, reproduction and distribution are subject to the Apache License, Version 2.0 (the License)"],
    "GPL": ["You can use it under the terms of the GNU General Public License v2", "Distributed under the GNU GPL, version 3 or later", "This file is part of a program under the GNU General Public License version 2"],
    "LGPL": ["This library is covered by the GNU Lesser General Public License version 3", "Distributed under the GNU LGPL, version 2.1"],
    "AGPL": ["The server is covered by the GNU Affero General Public License version 3"],
    "BSD": ["Use of this code is subject to the BSD license found in the file", "The package is available under the 2-Clause BSD License"],
    "MPL": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "EPL": ["This program is under the Eclipse Public License 2.0"],
    "ISC": ["The code is distributed under the ISC License terms"],
    "CC-BY": ["Text is available under the Creative Commons Attribution 4.0 International License", "Photographs are shared under CC BY 3.0"],
    "CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License 3.0"],
    "CC-BY-NC": ["The figures may be shared under CC BY-NC 4.0"],
    "CC0": ["The data are released under CC0 1.0"],
    "Proprietary": ["Copyright the company. All rights reserved.", "This document may not be copied or distributed without the prior written permission of the author"],
}
#: Licence wording that names none of the families, to learn from and (the second list) to calibrate on.
UNKNOWN = [
    "Licensed under the terms set out by the publisher", "This text is released under a custom license", "Distributed under the license agreement of the vendor", "Use of this work is subject to the license terms of its owner",
    "Licensed under the European Union Public Licence", "This work is licensed under a special agreement", "The license of this document can be found on the site", "See the LICENSE file for the license of this software",
    "Licensed under the SIL Open Font License, Version 1.1", "SPDX-License-Identifier: CDDL-1.0", "License: see the file COPYING", "License: commercial", "under the terms of the Common Development and Distribution License",
    "governed by the license that came with the product", "This material is provided under the Open Government Licence", "You may use the software only under the license agreement you have accepted",
    "Licensed under the Microsoft Public License", "the Python Software Foundation License", "Licensed under the Business Source License", "SPDX-License-Identifier: OFL-1.1", "a license granted by the author of the work",
]
UNKNOWN_HELD = [
    "Licensed under the Open Data Commons Attribution License", "SPDX-License-Identifier: NCSA", "This software is licensed under the terms of the customer contract", "Released under the license in the file named NOTICE",
    "Licensed under the Academic Free License version 3.0", "License: internal", "Distributed under the PostgreSQL License", "use is subject to the license of the archive", "The work is under the Free Art License", "Licensed under the PHP License, version 3.01",
    "This work is licensed under a separate agreement", "Licensed under the Ruby License",
]
#: Wording near to that of notices which grants and reserves nothing.
PLAIN = [
    "a driver's license is needed", "he lost his license to practise", "the license plate of the car", "all rights reserved to change the plan", "they reserved all rights of way", "permission was granted to enter the house", "the public domain of knowledge",
    "the mit campus opened", "an apache helicopter", "a general public meeting", "the copyright office opened a branch", "the boost in sales was notable", "the mozilla browser", "free of charge for any person", "commons were attributed to the lord",
    "a zero sum game", "the eclipse was seen by the public", "without restriction of age", "the software was released", "you should have received a letter along with this parcel", "use in source and in print", "the terms of the contract",
]
#: What the families are called. In phrasings they train the classifier, and each confirms its family.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT licensed", "under MIT", "License: MIT", "X11 license", "Expat license"], "Apache": ["Apache License", "Apache-2.0", "Apache 2.0", "ASL 2.0", "Apache licensed", "License: Apache"],
    "GPL": ["GPL", "GNU GPL", "GPLv3", "GPL-3.0", "GNU GPLv2", "GNU General Public License", "General Public License"], "LGPL": ["LGPL", "GNU LGPL", "LGPLv3", "LGPL-2.1", "GNU Lesser General Public License", "Lesser General Public License", "Library General Public License"],
    "AGPL": ["AGPL", "GNU AGPL", "AGPLv3", "AGPL-3.0", "GNU Affero General Public License", "Affero General Public License"], "BSD": ["BSD License", "BSD-3-Clause", "3-clause BSD", "BSD licensed", "under BSD", "BSD-style license", "License: BSD", "new BSD", "modified BSD"],
    "MPL": ["MPL", "MPL-2.0", "MPL 2.0", "Mozilla Public License"], "EPL": ["EPL", "EPL-2.0", "EPL 2.0", "Eclipse Public License"], "ISC": ["ISC License", "ISC licensed", "under ISC", "License: ISC"], "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib licensed", "zlib/libpng license", "License: zlib"], "BSL": ["Boost Software License", "BSL-1.0", "BSL 1.0", "Boost License"], "WTFPL": ["WTFPL"], "Artistic": ["Artistic License", "Artistic-2.0", "Artistic 2.0"],
    "CC0": ["CC0", "CC0-1.0", "CC0 1.0", "Creative Commons Zero"], "CC-BY": ["CC BY", "CC-BY", "CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution"], "CC-BY-SA": ["CC BY-SA", "CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-Share Alike"],
    "CC-BY-NC": ["CC BY-NC", "CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial"], "CC-BY-ND": ["CC BY-ND", "CC-BY-ND-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives"],
    "CC-BY-NC-SA": ["CC BY-NC-SA", "CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike"], "CC-BY-NC-ND": ["CC BY-NC-ND", "CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives"],
}
#: Licences of no family here, to learn from in the same phrasings; the second list is for calibration.
OTHER_NAMES = ["EUPL", "European Union Public License", "SIL Open Font License", "OFL-1.1", "CDDL", "CDDL-1.0", "Microsoft Public License", "MS-PL", "Python Software Foundation License", "Business Source License", "Open Government License", "Common Public License", "IBM Public License", "ODbL", "Open Database License", "GNU Free Documentation License", "GFDL", "Elastic License", "SSPL", "Server Side Public License", "vendor license", "license agreement of the owner", "Sleepycat License", "CeCILL"]
OTHER_HELD = ["Open Software License", "PostgreSQL License", "PHP License", "NCSA", "Academic Free License", "Ruby License", "Free Art License", "LaTeX Project Public License", "Nokia Open Source License", "Vovida Software License", "Confluent Community License", "OpenSSL License", "Q Public License", "Zope Public License", "Eiffel Forum License", "Commons Clause"]
#: Phrasings of a name to learn from; the second list is for calibration.
FRAMES = ["{}", "Licensed under the {}", "Licensed under {}.", "Released under the {}", "License: {}", "SPDX-License-Identifier: {}", "distributed under the terms of the {}", "This project is {}", "available under the {}. See the file for details.", "the {} applies", "{} (see LICENSE)"]
FRAMES_HELD = ["Code here is covered by the {}", "you may redistribute this under {}", "our library uses {}", "Copyright 2014 the contributors, {}", "it falls under the {} as found on the site", "published, like the rest, under {} terms"]
#: Everyday uses of the words in those phrasings, which are no notices.
BARE = ["under the bridge", "under the terms of the treaty", "available under the counter", "distributed under the tables", "released under the cover of night", "this project is late", "the rule applies", "see the file for details", "a driving license", "his license plate", "her licensed restaurant", "a license to kill", "the pilot license was renewed", "license fees went up", "they were licensed to sell wine", "a fishing license applies here", "software for the office", "the public bought it"]
#: Starts of the words one of which an unknown licence must hold, beside the names below.
_LICENCE_WORDS = ["licens", "spdx", "copyright"]
#: Words of templates that plain texts are full of: the last to tell which windows are scored. They bear on time alone.
_EVERYDAY = ["any", "by", "for", "from", "general", "is", "may", "mit", "new", "of", "public", "the", "this", "to", "version", "with", "work"]
#: Words put around longer notices, to train on the variations that occur.
_AROUND = ["{}", "Note: {}.", "{}. See the file for details.", "(c) 2020 the authors. {}.", "{}. Thank you for reading."]
#: Single words that are features: with a number or hyphen, or a licence's own name.
_OWN = ["gpl", "lgpl", "agpl", "mpl", "epl", "wtfpl", "unlicense", "cc0", "eupl", "cddl", "ofl", "odbl", "gfdl", "sspl", "cecill"]

#: Where a family's version stands in the words of a window.
_VERSION = {
    "Apache": r"\bapache(?:[- ]|\s+(?:software\s+)?licen[cs]e[\s,-]*)(?:version\s+|v)?(\d(?:\.\d)?)",
    "GPL": r"(?:\bgnu gpl|\bgpl|(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e)(?:\s+as published by the free software foundation)?(?:\s+either)?[\s-]*(?:version\s+|v\s*)?(\d(?:\.\d)?)",
    "LGPL": r"(?:\blgpl|(?:lesser|library) general public licen[cs]e)(?:\s+as published by the free software foundation)?(?:\s+either)?[\s-]*(?:version\s+|v\s*)?(\d(?:\.\d)?)",
    "AGPL": r"(?:\bagpl|affero general public licen[cs]e)(?:\s+as published by the free software foundation)?(?:\s+either)?[\s-]*(?:version\s+|v\s*)?(\d(?:\.\d)?)",
    "BSD": r"(?:\bbsd[- ](\d)[- ]clause|\b(\d)[- ]clause\s+bsd)",
    "MPL": r"(?:\bmpl|mozilla public licen[cs]e)[\s/-]*(?:version\s+|v\s*)?(\d(?:\.\d)?)",
    "EPL": r"(?:\bepl|eclipse public licen[cs]e)[\s-]*(?:version\s+|v\s*)?(\d(?:\.\d)?)",
    "BSL": r"(?:boost software licen[cs]e|\bbsl)[\s-]*(?:version\s+|v\s*)?(\d\.\d)",
    "Artistic": r"artistic(?:\s+licen[cs]e)?[\s-]*(?:version\s+|v\s*)?(\d\.\d)",
    "CC0": r"\bcc0[\s-]*(\d\.\d)",
} | {k: r"(?:\bcc[- ]by[a-z -]*?|attribution[a-z -]*?)(?:licen[cs]e\s+)?(?:version\s+|v\s*)?(\d\.\d)" for k in ("CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-ND", "CC-BY-NC-SA", "CC-BY-NC-ND")}

NONE, UNKNOWN_NAME = "none", "unknown"
FAMILIES = [NONE, UNKNOWN_NAME, *TEMPLATES]
#: About so many documents give a window each to train the class none.
NEGATIVES = 3_000
WINDOW, STRIDE = 120, 80
#: Share of a template's n-grams that confirms a prediction.
CONFIRM = 0.6
#: Least probability of the class that a window counted as unknown is put in.
SURE = 0.5

_NUMBER = r"(?<![a-z])v?\d+(?:\.\d+)*(?:-only|-or-later|\+)?"


def _words(text: Column) -> Column:
    """Lower-case words without the points, plus signs and hyphens at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda x: F.btrim(x, F.lit(".-"))), lambda x: x != "")


def _plain(word: Column) -> Column:
    """A word as the features have it: numbers as #, ``licence`` spelt ``license``, ``gplv3`` as ``gpl``."""
    numbered = F.regexp_replace(F.regexp_replace(word, r"(?<=[a-z]pl)-?v?\d+(?:\.\d+)*(?:-only|-or-later|\+)?$", ""), _NUMBER, "#")
    return F.when(word.rlike("[0-9]"), numbered).when(word.startswith("licenc"), F.concat(F.lit("licens"), F.substring(word, 7, 20))).otherwise(word)


def plain(text: Column, words: Column) -> Column:
    """The plain words; a text without a number and the other spelling has none that changes."""
    return F.when(text.rlike("[0-9]|(?i:licenc)"), F.transform(words, _plain)).otherwise(words)


def grams(plain_words: Column) -> Column:
    """Word bigrams and trigrams of plain words, and single words that hold a hyphen or a number or are a licence's name. Repeated ones stay: the features only ask whether one is there."""

    def runs(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, w[i + 1]))
        triples = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, w[i + 1], w[i + 2]))
        return F.concat(F.filter(w, lambda x: x.isin(_OWN) | x.contains("-") | x.contains("#")), pairs, triples)

    return F.transform(F.array(plain_words), runs)[0]  # as a lambda's variable the words are made once


def text_grams(text: Column) -> Column:
    return grams(plain(text, _words(text)))


def needed_words(templates: dict[str, list[list[str]]]) -> set[str]:
    """Starts of words, one of which is in every window that can count as a licence.

    A named family takes ``CONFIRM`` of the n-grams of one of its templates: of each
    template so many words are taken that the n-grams without them are too few. An
    unknown licence takes a licence word. The words are cut before their first digit or
    the like, up to which ``_plain`` leaves a word as it is.
    """
    start = lambda w: re.match("[a-z-]*", w).group()
    needed = {*_LICENCE_WORDS, *_OWN}
    has = lambda g: any(w.startswith(n) for w in g.split(" ") for n in needed)
    for g in sorted((g for gs in templates.values() for g in gs), key=lambda g: (len(g), g)):
        while len(rest := [x for x in g if not has(x)]) / len(g) >= CONFIRM:
            words = {start(w) for x in rest for w in x.split(" ")} - {""}
            if not words:
                return {""}  # any window may count
            needed.add(min(words, key=lambda w: (w in _EVERYDAY, -len(w), w)))
    return needed


def needed_pattern(needed: set[str]) -> str:
    """A regular expression that finds a word with one of those starts in lower-case text, and perhaps more."""
    if "" in needed:
        return ""
    by_letter: dict[str, list[str]] = {}
    for w in sorted({*needed, *(w.replace("licens", "licenc", 1) for w in needed if w.startswith("licens"))}):
        by_letter.setdefault(w[0], []).append(w[1:])
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def windows(docs: DataFrame, needed: str = "") -> DataFrame:
    """Windows of paragraphs: doc_id, key, p, at, words, plain (the words as the features have them).

    needed: paragraphs whose lower-case text this pattern does not find are left out.
    """
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[^\S\n]*(?:\n[^\S\n]*)+")).alias("p", "paragraph")
    if needed:
        docs = docs.where(F.lower("text").rlike(needed))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), parts)
    if needed:
        rows = rows.where(F.lower("paragraph").rlike(needed))

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - (WINDOW - STRIDE)) / STRIDE).cast("int") - 1))
        one = lambda k: F.struct(k.alias("at"), F.slice(w, k * STRIDE + 1, F.lit(WINDOW)).alias("words"), told.alias("odd"))
        return F.transform(starts, one)

    told = F.col("paragraph").rlike("[0-9]|(?i:licenc)")

    cells = F.transform(F.array(_words(F.col("paragraph"))), cut)[0]
    return rows.select("doc_id", "key", "p", F.explode(cells).alias("c")).select("doc_id", "key", "p", "c.at", "c.words", F.when(F.col("c.odd"), F.transform("c.words", _plain)).otherwise(F.col("c.words")).alias("plain"))


def _notices(spark: SparkSession) -> DataFrame:
    """Fixed rows (label, text, held): a few thousand."""
    rows = []
    add = lambda family, texts, frames, held: rows.extend((float(FAMILIES.index(family)), frame.format(t), held) for t in texts for frame in frames)
    for family, texts in [*TEMPLATES.items(), (UNKNOWN_NAME, UNKNOWN), (NONE, PLAIN)]:
        add(family, texts, _AROUND, False)
    for family, texts in [*NAMES.items(), (UNKNOWN_NAME, OTHER_NAMES)]:
        add(family, texts, FRAMES, False)
    add(NONE, BARE, ["{}"], False)
    for family, texts in [*HELD.items(), (UNKNOWN_NAME, UNKNOWN_HELD)]:
        add(family, texts, ["{}"], True)
    for family, texts in [*NAMES.items(), (UNKNOWN_NAME, OTHER_HELD)]:
        add(family, texts, FRAMES_HELD, True)
    return spark.createDataFrame(rows, "label double, text string, held boolean")


class LicenseModel:
    """The fitted classifier, its vocabulary, threshold and the n-grams of the templates."""

    def __init__(self, model: LogisticRegressionModel, vocabulary: list[str], threshold: float, templates: dict[str, list[list[str]]]) -> None:
        self.model, self.vocabulary, self.threshold, self.templates = model, vocabulary, threshold, templates

    def score(self, rows: DataFrame) -> DataFrame:
        """Family number k, confidence and containment of the rows with grams that are not none."""
        return _containment(_predict(self.model, self.vocabulary, rows).where("k > 0"), self.templates)


def _vectors(vocabulary: list[str], rows: DataFrame) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=0.0).setBinary(True).transform(rows)


def _predict(model: LogisticRegressionModel, vocabulary: list[str], rows: DataFrame) -> DataFrame:
    scored = model.transform(_vectors(vocabulary, rows)).withColumn("probability", vector_to_array("probability"))
    return scored.withColumn("k", F.col("prediction").cast("int")).withColumn("confidence", F.array_max("probability")).drop("features", "rawPrediction", "probability", "prediction")


def _containment(rows: DataFrame, templates: dict[str, list[list[str]]]) -> DataFrame:
    """Add the greatest share that the window holds of a template of its predicted family."""
    of = F.array(*[F.array(*[F.array(*map(F.lit, g)) for g in templates.get(f, [])]).cast("array<array<string>>") for f in FAMILIES])
    share = lambda g: F.size(F.array_intersect("grams", g)) / F.size(g)
    return rows.withColumn("containment", F.aggregate(of[F.col("k")], F.lit(0.0), lambda most, g: F.greatest(most, share(g))))


def _threshold(rows: list[tuple[int, int, float, float]]) -> float:
    """The probability from which families are named. rows: label, k, confidence, containment of held notices.

    Of the cuts at which held notices gain most (a right name counts 1, a wrong one -2)
    the highest that keeps all but a hundredth of the right names: what is less sure
    than the notices that were held out is unknown.
    """
    named = [(c, label == k) for label, k, c, held in rows if k > 1 and held >= CONFIRM]
    right = sorted(c for c, ok in named if ok)
    if not right:
        return SURE
    gain = lambda t: sum(1 if ok else -2 for c, ok in named if c >= t)
    floor = right[len(right) // 100]
    return max([floor, *(c for c, _ in named if c > floor)], key=lambda t: (gain(t), -t))


def fit(docs: DataFrame, negatives: int = NEGATIVES) -> LicenseModel:
    spark = docs.sparkSession
    notices = _notices(spark).withColumn("grams", text_grams(F.col("text"))).cache()  # a few hundred fixed rows
    n = docs.count()
    u = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40))
    sample = windows(docs.where(u < int(min(1.0, negatives / max(n, 1)) * (1 << 40)) + 1))
    sample = sample.groupBy("key").agg(F.min_by("plain", F.xxhash64("p", "at", "key")).alias("plain"))  # copies count once
    sample = materialize(sample.select("key", grams(F.col("plain")).alias("grams")))
    around = [frame.format(name) for frame in FRAMES for name in ("x license", "x public license", "x software license", "x")] + ["terms of the license", "license agreement", "custom license", "license of this", "see our license"]
    frames = {g for r in spark.createDataFrame([(t,) for t in around], "text string").select(text_grams(F.col("text")).alias("g")).collect() for g in r["g"] if "x" not in g.split(" ")}
    proof = {f: [*ts, *NAMES.get(f, [])] for f, ts in TEMPLATES.items()}
    grams_of = {r["text"]: list(r["grams"]) for r in spark.createDataFrame([(t,) for ts in proof.values() for t in ts], "text string").withColumn("grams", F.array_distinct(text_grams(F.col("text")))).collect()}
    templates = {f: [grams_of[t] for t in ts if grams_of[t]] for f, ts in proof.items()}
    # from the fixed notices alone; not the other licences' own names, so that what is around a name no family has tells of a licence
    vocabulary = sorted({g for r in notices.where(f"NOT held AND label <> {FAMILIES.index(UNKNOWN_NAME)}").select("grams").collect() for g in r["grams"]} | set(frames))
    known = set(vocabulary)
    trigrams = [g for g in known if g.count(" ") == 2]
    other = sample.where(~F.arrays_overlap("grams", F.array(*[F.lit(g) for g in trigrams])))  # the sample's own notices are no examples of none
    none = other.select(F.lit(0.0).alias("label"), "grams", F.lit(5.0 / negatives).alias("weight"))
    empty = spark.createDataFrame([(0.0, [], 5.0)], "label double, grams array<string>, weight double")
    stated = notices.where("NOT held").where((F.col("label") != FAMILIES.index(UNKNOWN_NAME)) | F.exists("grams", lambda g: g.isin(vocabulary)))  # a name alone tells nothing
    train = stated.select("label", "grams", F.lit(1.0).alias("weight")).unionByName(none).unionByName(empty)
    train = _vectors(vocabulary, train).coalesce(1).cache()  # a few thousand rows at most
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=2e-4, elasticNetParam=0.2, maxIter=60, standardization=False).fit(train)
    held = _containment(_predict(model, vocabulary, notices.where("held")), templates).select("label", "k", "confidence", "containment").collect()
    train.unpersist()
    notices.unpersist()
    return LicenseModel(model, vocabulary, _threshold([(int(r["label"]), r["k"], r["confidence"], r["containment"]) for r in held]), templates)


def _license(rows: DataFrame) -> DataFrame:
    """Add ``license``: the family with the version that the words state, if any."""
    said = F.when(F.lit(False), F.lit(""))
    for f, pattern in _VERSION.items():
        said = said.when(F.col("family") == f, F.concat(*[F.regexp_extract("said", pattern, i + 1) for i in range(2 if f == "BSD" else 1)]))
    rows = rows.withColumn("said", F.array_join("words", " ")).withColumn("v", said.otherwise(F.lit("")))
    v, family = F.col("v"), F.col("family")
    whole = F.when(v.contains("."), v).otherwise(F.concat(v, F.lit(".0")))
    return rows.withColumn("license", F.when(v == "", family).when(family == "BSD", F.concat(F.lit("BSD-"), v, F.lit("-Clause"))).otherwise(F.concat(family, F.lit("-"), whole)))


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, key, n_paragraphs, n_license, license, confidence, containment, confirmed, licenses.

    ``license`` is that of the surest licence window, confirmed ones first, then the
    first; ``unknown`` or ``none``. ``licenses`` lists all that were found, ``unknown``
    only if nothing else was; ``n_license`` counts the paragraphs with any. Null,
    empty and blank texts have no paragraphs. Null ids stay null; repeated rows get
    equal rows. No documents give no rows. Other columns are ignored, whatever their
    names.
    """
    docs = docs.select("doc_id", "text")
    model = model or fit(docs)
    scored = model.score(windows(docs, needed_pattern(needed_words(model.templates))).withColumn("grams", grams(F.col("plain"))).drop("plain"))
    family = F.when((F.col("k") > 1) & (F.col("confidence") >= model.threshold) & (F.col("containment") >= CONFIRM), F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("k") + 1)).otherwise(F.lit(UNKNOWN_NAME))
    licence_word = F.exists("grams", lambda g: g.rlike(rf"(^| )({'|'.join([*_LICENCE_WORDS, *_OWN])})"))
    scored = scored.withColumn("family", family).where((F.col("family") != UNKNOWN_NAME) | (F.col("confidence") >= SURE) & licence_word)
    scored = materialize(_license(scored).select("doc_id", "key", "p", "at", "confidence", "containment", (F.col("family") != UNKNOWN_NAME).alias("confirmed"), "license"))
    found = scored.groupBy("doc_id", "key").agg(
        F.max(F.struct("confirmed", F.round("confidence", 6).alias("confidence"), (-F.col("p")).alias("p"), (-F.col("at")).alias("at"), "license", "containment")).alias("r"),
        F.countDistinct("p").alias("n_license"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("license")))).alias("licenses"),
    )
    found = materialize(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key"))
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\n[^\S\n]*(?:\n[^\S\n]*)+"), lambda x: x.rlike(r"\p{L}"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), count.alias("n_paragraphs"))
    if found.count() * 200 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["key"] == found["_key"]), "left")
    names = F.when(F.size("licenses") > 0, F.col("licenses")).when(F.col("n_license") > 0, F.array(F.lit(UNKNOWN_NAME))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "doc_id", "key", "n_paragraphs", F.coalesce("n_license", F.lit(0)).alias("n_license"), F.coalesce("r.license", F.lit(NONE)).alias("license"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("r.containment", F.lit(0.0)).alias("containment"), F.coalesce("r.confirmed", F.lit(False)).alias("confirmed"), names.alias("licenses"),
    )
