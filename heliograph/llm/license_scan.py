"""Licence scan in DataFrame operations only.

Every paragraph (line) is classified by a multinomial logistic regression over
sparse word uni- and bigrams, fitted on the driver to the texts below.  A
paragraph whose likeliest class is `none` is no notice.  A notice whose family
is less sure than the calibrated confidence is `unknown`, and word bigrams in
common with the family's texts confirm the rest.  Paragraphs that provably can't
be notices under the fitted weights are left out before the full sums.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import id_and_text, pinned

BUCKETS = 1 << 17
#: Share of an unseen family's notices that the confidence must turn into `unknown`.
CALIBRATION = 0.9
CONFIRM = 0.5
_WORD = "[^a-z0-9]+"

#: Paragraphs and short notices of each family, as their public texts have them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)", "License: MIT",
        "Licensed under the MIT License. See LICENSE in the project root for license information.", "Code available under MIT.", "Distributed under the MIT license, see the file COPYING.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "Code: Apache-2.0", "License: Apache 2.0", "Released under the Apache License 2.0.",
        "This project is licensed under the terms of the Apache 2.0 license.", "Distributed under the Apache Software License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL license, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the GNU GPL v3 or later.", "GPLv3", "License: GPLv2+", "Licensed under the GPL v2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "License: LGPLv3", "Released under the LGPL.", "Distributed under the GNU LGPL v2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License v3.0.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "License: AGPLv3", "Released under the AGPL, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD", "This project is licensed under the terms of the BSD license.", "New BSD License", "Distributed under a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "MPL-2.0", "Mozilla Public License Version 2.0", "Released under the MPL 2.0.", "License: MPL 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "ISC License", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC", "Released under the ISC License.", "License: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.", "CC BY 4.0", "CC BY-SA 4.0", "CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "Content released under CC BY 3.0.", "SPDX-License-Identifier: CC-BY-4.0", "This article is distributed under the terms of the Creative Commons Attribution License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Content released under CC BY-NC-ND 3.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc0": (
        "This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal public domain dedication, no rights reserved.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal", "Licensed under CC0.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is the confidential and proprietary information of the company and may be used only under the terms of the license agreement.", "SPDX-License-Identifier: LicenseRef-Proprietary", "Licensed under a commercial license. Redistribution is not permitted.",
        "This document contains proprietary information; no license to use it is granted.",
    ),
    # Licences without a family of their own: notices of these are `unknown`.
    "other": (
        "Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: Zlib", "License: WTFPL",
        "Licensed under the EUPL, Version 1.2 or later.", "Released under the Artistic License 2.0.", "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Open Database License.", "Use of this software is subject to the terms of its license agreement.",
        "Use is subject to the Sun Community Source License.", "Your use is governed by the Microsoft Public License agreement.", "Use, copying and distribution are subject to the Open Group Public License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Contents of this directory are covered by the license in the file COPYING.", "Use is governed by a source code license that can be found in the LICENSE file.",
    ),
}
#: Sentences near to notices that are none, some of them about licences themselves.
OTHERS = (
    "He lost his driving licence after the accident.", "The licence plate of the car was dirty.", "Her permission to leave was granted by the manager.", "A search warrant was issued by the court.", "Driving licence applications are accepted here.",
    "The warranty covers repairs for two years after purchase.", "The warranty is void if opened.", "The committee debated copyright reform for many hours.", "They redistributed the food among the families.", "Without permission nobody may enter the building.",
    "The fishing licence costs ten euros and is valid for a year.", "The song is in the public domain since last year.", "The plumber is licensed and insured.", "License fees rose sharply in the last quarter.", "The bar was licensed to sell spirits until midnight.",
    "The data warrant a closer look at the model.", "Please ask for permission before you take pictures.", "The copyright office answered the letter.", "Poetic license allows such verses.", "The software is provided to schools at a lower price.",
    "Subject to the weather, the general meeting takes place outside.", "You may obtain a copy of the report at the desk.", "See the file for details.", "The version of the program that you use is free of charge.", "The above conditions were met by all persons.",
    "The source of the river is on the other side of the mountain.", "This work is the result of ten years of study.", "It is distributed in the hope of peace, and without any fee.", "The public may use the library on all days of the week.", "The program was released in June and is available for download.",
    "A copy of this letter was sent to the foundation.", "The terms of the agreement were published by the government.", "The names of the contributors are listed in the appendix.", "MIT is a university near Boston.", "She studied at MIT and later at Berkeley.", "The Apache helicopter landed behind the hill.",
    "The Apache people lived in the south west.", "Mozilla published a new version of its browser.", "The gnu is an animal of the plains.", "Creative work in common rooms needs attribution of tasks.", "The license of the old radio station expired.", "He has a license to practice medicine in two states.",
    "A commercial use of the hall is possible.", "Copyright law protects the author of a text.", "The permission notice hung on the door.", "The lawyer explained the license agreement to her clients.", "Open source software is used by many companies.", "We compared several open source licenses in the article.",
    "The court held that the license had been granted for all purposes.", "Version 2 of the report comes in January.", "Any person who is free to come may bring others.", "The merchant sold goods fit for a particular purpose.", "The text is available in four languages.", "Read the manual before use and keep it for later.",
    "The share of the market is rising, not the commercial value.", "Use of the pool is permitted provided that a guard is present.", "The binary star was found without a telescope.", "Content of this kind is international.", "The universal rights of man were declared there.", "All in all the release was a success.",
    "Er kam mit dem Zug und fuhr mit dem Bus.", "Mit der Zeit wird alles gut.", "Mit freundlichen Gruessen und mit Dank.", "Sie spricht mit ihm.", "Kaffee mit Milch", "Mit wem gehst du mit?", "Das Kind mit dem Hut und der Mann mit Bart.", "Was ist mit?",
    "Der Name des Autors ist nicht bekannt und das Werk ist alt.", "Sie hat den Führerschein und die Erlaubnis der Behörde.", "La licencia de conducir vence en junio.", "El uso de la sala es libre y sin costo.", "Le permis de conduire est valable dix ans.", "Les droits du public sont dans la loi.",
)
#: Frequent words of four languages; sentences drawn from them are no notices either.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use during without again place american around however home small found thought went say part once general high upon school every",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros",
    "le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau",
)
DRAWN = 300
FAMILIES = (*TEMPLATES, "none")
NONE, OTHER = len(FAMILIES) - 1, FAMILIES.index("other")


def _words(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _grams(words: list[str]) -> set[str]:
    return {*words, *_pairs(words)}


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


#: Families that share texts: left out together, as the others would only mistake one for another.
KIN = (("gpl", "lgpl", "agpl"), ("cc-by", "cc-by-nc"), *((f,) for f in TEMPLATES if f not in ("gpl", "lgpl", "agpl", "cc-by", "cc-by-nc", "other")))


def _examples() -> list[tuple[list[str], int, int]]:
    """(words, family, number of the text): each text whole, parts of long ones, and with other words around it."""
    around = ("copyright 2024 the authors", "note that", "see below for details", "this file is part of the project", "c 2019 contributors")
    out = []
    for label, name in enumerate(FAMILIES):
        for text in TEMPLATES.get(name, OTHERS):
            words, number = _words(text), len({x[2] for x in out})
            forms = [words, *(words + a.split() for a in around), *(a.split() + words for a in around)]
            if len(words) > 16:
                forms += [words[: len(words) // 2], words[len(words) // 2 :]]
            out += [(f, label, number) for f in forms]
    out += [(a.split(), NONE, -1) for a in around]
    rng = np.random.default_rng(3)
    for i in range(DRAWN):  # one language each, 1 to 30 words
        out.append((_words(" ".join(rng.choice(COMMON_WORDS[i % 4].split(), rng.integers(1, 31)))), NONE, -2 - i))
    return out


class Regression:
    """Softmax regression over the grams of its examples, one a bucket; any other gram weighs nothing."""

    def __init__(self, examples: list[tuple[list[str], int, int]], rounds: int = 100, decay: float = 2e-4):
        # Drawn sentences add no bigrams: theirs come from chance.
        grams = [_grams(words) if number >= -1 else set(words) for words, _, number in examples]
        by_bucket: dict[int, str] = {}
        for gram in sorted(set().union(*grams)):
            by_bucket.setdefault(_bucket(gram), gram)
        self.grams = sorted(by_bucket.values())
        self.index = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(examples), len(self.grams) + 1), np.float32)
        for row, have in enumerate(grams):
            x[row, [self.index[g] for g in have if g in self.index]] = 1
        x[:, -1] = 1  # the bias
        x *= np.array([1 / np.sqrt(len(words) + 1.0) for words, _, _ in examples], np.float32)[:, None]
        target = np.zeros((len(examples), len(FAMILIES)), np.float32)
        target[np.arange(len(examples)), [label for _, label, _ in examples]] = 1
        w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            slope = x.T @ (self._softmax(x @ w) - target) / len(x) + decay * w
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            w -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights = np.round(w.astype(np.float64), 4)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def predict(self, words: list[str]) -> tuple[bool, int, float]:
        """Whether it is a notice, the likeliest family, and that family's share of the families' probability."""
        rows = [self.index[g] for g in _grams(words) if g in self.index]
        logits = (self.weights[rows].sum(0) + self.weights[-1]) / np.sqrt(len(words) + 1.0)
        best = int(np.argmax(logits[:NONE]))
        return bool(logits[best] > logits[NONE]), best, float(self._softmax(logits[:NONE])[best])

    def bounds(self) -> tuple[list[float], float]:
        """By bucket of a word what it and the bigrams it opens add at most to a family's lead over `none`; and the biases' lead."""
        lead = self.weights[:, :NONE].max(1) - self.weights[:, NONE]
        out = [0.0] * BUCKETS
        for gram, i in self.index.items():
            out[_bucket(gram.split(" ")[0])] += max(0.0, float(lead[i])) + 1e-6
        return [round(v, 6) for v in out], float(lead[-1])


def calibrated(examples: list[tuple[list[str], int, int]]) -> float:
    """The quantile CALIBRATION of the confidence that notices get from a model that knows none of their kin."""
    strange = []
    for kin in KIN:
        model = Regression([e for e in examples if FAMILIES[e[1]] not in kin])
        seen = [model.predict(_words(t)) for f in kin for t in TEMPLATES[f]]
        strange += [share for notice, _, share in seen if notice]
    return sorted(strange)[int(CALIBRATION * (len(strange) - 1))]


@lru_cache(maxsize=1)
def trained() -> tuple[Regression, float]:
    """The classifier, and the confidence under which a notice's family is `unknown`; fitted once a driver process."""
    examples = _examples()
    return Regression(examples), calibrated(examples)


def _constant(value: list, kind: str) -> Column:
    """A table as one literal, which the optimizer folds: not thousands of literal expressions."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed: each paragraph taken for a notice.

    Paragraphs are the lines of the whole text, counted from 0; every one is
    judged.  `family` is `unknown` for a notice of another licence or of an unsure family;
    probability is the family's share among the families, similarity the part of
    the paragraph's word bigrams that are in the family's texts, and confirmed
    says that it is half or more (`unknown` never is).  Ties go to the family
    listed first.  Null and empty texts have no paragraphs; repeated rows and
    null ids are scanned like others.
    """
    model, least = trained()
    docs = id_and_text(df, id_col, text_col)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    words = pinned(lines, "words", f"array_remove(split(lower(line), '{_WORD}'), '')", ["doc_id", "paragraph"])
    bucket = lambda g: f"cast(crc32(cast({g} AS binary)) % {BUCKETS} AS int)"
    found = pinned(words, "at", f"array_distinct(transform(words, w -> {bucket('w')}))", ["*"])

    bound, lead = model.bounds()
    reach = F.aggregate("at", F.lit(0.0), lambda acc, i: acc + F.element_at(_constant(bound, "array<double>"), i + 1))
    able = found.where(reach + lead > 0)
    pairs = pinned(able, "pairs", "CASE WHEN size(words) > 1 THEN zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1), (a, b) -> concat(a, ' ', b)) ELSE cast(array() AS array<string>) END", ["*"])
    places = [0] * BUCKETS
    for gram, i in model.index.items():
        places[_bucket(gram)] = i + 1
    place = lambda g: F.element_at(_constant(places, "array<int>"), (F.crc32(g.cast("binary")) % BUCKETS).cast("int") + 1)
    grams = _constant([*model.grams, ""], "array<string>")
    # The place of a gram, if it is the gram of that place.
    seen = F.transform(F.array_distinct(F.concat("words", "pairs")), lambda g: F.struct(place(g).alias("row"), g.alias("gram")))
    rows = F.transform(F.filter(seen, lambda s: (s["row"] > 0) & (F.element_at(grams, F.when(s["row"] > 0, s["row"]).otherwise(-1)) == s["gram"])), lambda s: s["row"])
    known = pairs.select("doc_id", "paragraph", "pairs", F.size("words").alias("n"), F.explode(F.array(rows)).alias("rows"))

    def logit(k: int) -> Column:
        weights = _constant(model.weights[:-1, k].tolist(), "array<double>")
        total = F.aggregate("rows", F.lit(0.0), lambda acc, i: acc + F.element_at(weights, i))
        return (total + float(model.weights[-1, k])) / F.sqrt(F.col("n") + F.lit(1.0))

    scored = known.select("doc_id", "paragraph", "pairs", F.explode(F.array(F.array(*(logit(k) for k in range(len(FAMILIES)))))).alias("x"))
    own = F.slice("x", 1, NONE)
    top = F.array_max(own)
    named = scored.where(top > F.element_at("x", NONE + 1))
    share = F.lit(1.0) / F.aggregate(own, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    named = named.select("doc_id", "paragraph", "pairs", F.array_position(own, top).cast("int").alias("k"), share.alias("probability"))
    family = F.when((F.col("probability") >= least) & (F.col("k") != OTHER + 1), F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("k"))).otherwise("unknown")
    templates = _constant([sorted({g for t in TEMPLATES[name] for g in _pairs(_words(t))}) for name in TEMPLATES], "array<array<string>>")
    common = F.size(F.filter("pairs", lambda g: F.array_contains(F.element_at(templates, F.col("k")), g)))
    similarity = F.when(F.size("pairs") > 0, common / F.size("pairs")).otherwise(0.0)
    out = named.select("doc_id", "paragraph", family.alias("family"), F.round("probability", 6).alias("probability"), F.round(similarity, 6).alias("similarity"))
    return out.withColumn("confirmed", (F.col("family") != "unknown") & (F.col("similarity") >= CONFIRM))
