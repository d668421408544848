"""Licence scans: a trained classifier of paragraphs by word n-grams, with an unknown class, confirmed by comparison with templates.

The classifier is a multinomial logistic regression on the presence of word unigrams and bigrams, trained here from the
templates below: each is varied by leaving out words and by strange words around it. Sentences that deny a licence, that
only mention one or that speak of other things in a licence's words train the unknown class, and notices of licences
with strange names the class OTHER. Its probabilities are calibrated by a temperature, and so is the least probability
that counts as known, on whole sentences held back from training beside variations of trained ones; a paragraph that is
likelier unknown than of any family is never claimed.

A paragraph is a line, in windows of SPAN words where it is longer, or a line with those that follow it up to a blank
one, at most LINES of them: texts that are wrapped hard are seen whole. A family is confirmed where the pairs of
neighbouring words of one of its templates stand close together, so words that lie scattered confirm nothing.

Scanning is a column expression over whole texts: no row leaves its place, nothing is shuffled or joined, and there is
no Python on the executors. A word of the model's vocabulary must stand in a paragraph for its score to differ from the
unknown class's, so paragraphs without one are passed over without losing any.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: The class of notices of a licence that is no family; it has no templates, so nothing confirms it.
OTHER = "other"
#: Least part of a template's pairs of neighbouring words that a paragraph must hold, within twice the template's length, to confirm its family; articles aren't counted.
SIMILAR = 0.6
#: Words of a window and how far the next one lies; lines that are joined at most.
SPAN, STRIDE, LINES = 64, 32, 4
#: What licences are called, by family; each name also stands behind "SPDX-License-Identifier:" if it is written as there.
NAMES = {
    "AGPL": ("GNU Affero General Public License version 3", "AGPL v3", "AGPLv3", "GNU AGPL", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache 2.0", "ASL 2.0", "Apache-2.0"),
    "Artistic": ("Artistic License 2.0", "Artistic-2.0"),
    "BSD": ("BSD License", "3-clause BSD License", "BSD", "BSD-2-Clause", "BSD-3-Clause"),
    "BSL": ("Boost Software License Version 1.0", "BSL-1.0"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "CC-BY-4.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial license", "CC-BY-NC-4.0"),
    "CC-BY-ND": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike license", "CC-BY-SA-4.0"),
    "CC0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    "EPL": ("Eclipse Public License 2.0", "Eclipse Public License version 1.0", "EPL-2.0"),
    "EUPL": ("European Union Public Licence version 1.2", "EUPL-1.2"),
    "GPL": ("GNU General Public License version 3", "GPL v3", "GPLv2", "GPLv3", "GPL", "GNU GPL", "GNU GPL version 2 or later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "ISC": ("ISC License", "ISC"),
    "LGPL": ("GNU Lesser General Public License version 2.1", "LGPL v3", "LGPLv2", "LGPLv3", "LGPL", "GNU LGPL", "LGPL-2.1-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT License", "MIT"),
    "MPL": ("Mozilla Public License version 2.0", "MPL 2.0", "MPLv2", "MPL-2.0"),
    "Proprietary": (),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "Zlib"),
}
#: The words of the licences themselves and of their usual notices.
TEXTS = {
    "AGPL": ("GNU Affero General Public License as published by the Free Software Foundation", "you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "Apache-2.0": ("you may not use this file except in compliance with the License you may obtain a copy of the License at apache org licenses LICENSE-2.0", "unless required by applicable law or agreed to in writing software distributed under the License is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    "Artistic": ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "the artistic license the intent of this document is to state the conditions under which a package may be copied"),
    "BSD": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    "BSL": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",),
    "CC-BY": ("this work is licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC": ("this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC-BY-ND": ("this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",),
    "CC-BY-SA": ("this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "text is available under the Creative Commons Attribution ShareAlike license"),
    "CC0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "EPL": ("this program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at eclipse org legal epl",),
    "EUPL": ("licensed under the EUPL you may not use this work except in compliance with the licence",),
    "GPL": ("this work is licensed under the GNU General Public License version 3", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version", "you should have received a copy of the GNU General Public License along with this program"),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "LGPL": ("you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "you should have received a copy of the GNU Lesser General Public License along with this library"),
    "MIT": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    "MPL": ("this source code form is subject to the terms of the Mozilla Public License", "if a copy of the MPL was not distributed with this file you can obtain one at mozilla org MPL 2.0"),
    "Proprietary": ("all rights reserved", "no part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher", "confidential and proprietary unauthorized copying of this file is strictly prohibited"),
    "Unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"),
    "Zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
}
#: Sentences that put something under a licence.
SAYINGS = ("licensed under the {}", "released under the {}", "distributed under the terms of the {}", "available under {}", "published under the {}", "covered by the {}", "{} licensed", "license {}")
#: How many of them can be denied, or name a strange licence.
DENIABLE = 6
#: What a sentence denies, before one of SAYINGS.
DENIALS = ("is not", "was never", "is no longer", "are not", "isn't", "cannot be", "was not", "were never", "has not been", "were not", "aren't", "nothing here is")
#: Sentences that mention a licence and put nothing under it.
MENTIONS = ("the {}", "rejected the {}", "refused the terms of the {}", "a lecture about the {}", "the history of the {}", "instead of the {}", "incompatible with the {}", "the authors of the {}", "the {} was written long ago", "unlike the {} it has no conditions", "moved away from the {}", "a critic of the terms of the {}", "not the {}")
TEMPLATES = {
    f: (*(say.format(n) for n in names for say in SAYINGS), *(f"SPDX-License-Identifier: {n}" for n in names if " " not in n), *TEXTS[f]) for f, names in NAMES.items()
}
#: Sentences that speak of other things in a licence's words.
OTHERS = ("he lost his driver license on the way", "the restaurant needs a liquor license", "a license plate was found near the road", "the city issued a fishing license and a permit", "licensed nurses work in the public hospital", "a licensed electrician must check the work", "the club was released from the contract", "the film was released in the spring", "the new version of the story is longer", "the public library is open to any person", "the general said the troops may not move", "the foundation gave the school a free copy of the book", "software updates are distributed every month", "the terms of the agreement were published in the newspaper", "the apache people live in the west", "he studied at mit in the city", "a copy of the letter is in the file", "the source of the river is in the mountains", "the notice above the door", "rights of the workers are reserved for the court", "the work was done without warranties", "creative people work in common rooms", "this work is part of a series", "the conditions of the road", "the following list of names", "commons debate on the public budget", "free of charge for any visitor", "the document is subject to change", "international law and public order", "the author has all the time", "the form must be signed in writing", "the trade was licensed under an old law of the king", "the drug is licensed under strict conditions", "a pilot licensed under the rules of another state", "the prisoners were released under a treaty", "the food was distributed under the eyes of the guards", "the room is available under the roof", "her poems were published under another name", "the floor is covered by the carpet", "the license costs more than before", "a school licensed by the state", "the shop sells licensed toys")
#: Words too common to be features of their own.
COMMON = frozenset("a an and any are as at be by can for from has he his if in is it may must no not of on or shall that the this to under was were with without you your".split())
#: Common words that are features all the same, since they tell what a sentence does with a licence; alone they make no paragraph worth a look.
CUES = frozenset("no not under".split())
#: Words that a notice may have or not have.
ARTICLES = ("a", "an", "the")
WORD = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bare(words: list[str]) -> list[str]:
    return [w for w in words if w not in ARTICLES]


def neighbours(words: list[str]) -> set[str]:
    words = bare(words)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)


def grams(words: list[str]) -> set[str]:
    """Unigrams and bigrams that hold a word that isn't common, or a cue."""
    idle = COMMON - CUES
    pairs = (f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in idle and b in idle))
    return {w for w in words if w not in idle} | set(pairs)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    least: float

    @property
    def words(self) -> list[str]:
        """Every feature holds one of these."""
        return sorted({w for g in self.weights for w in g.split() if w not in COMMON})

    def probabilities(self, text: str) -> dict[str, float]:
        """As the column expression computes them, for tests."""
        z = (np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(tokens(text)) if g in self.weights), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(z - z.max())
        return dict(zip(self.families, (e / e.sum()).tolist(), strict=True))


def lessons(rng: np.random.Generator, strange: list[str]) -> dict[str, list[tuple[str, bool]]]:
    """By class: the sentences it is taught by, and whether one is held back whole. Sentences with a name are held back by turns, so that every name and every saying is learned from others."""

    def turns(sentences: Sequence[str], every: int = 5) -> list[tuple[str, bool]]:
        return [(s, i % every == every - 1) for i, s in enumerate(sentences)]

    out = {}
    for f, names in NAMES.items():
        notices = [SAYINGS[(i + j) % len(SAYINGS)].format(n) for j, n in enumerate(names) for i in range(len(SAYINGS))]
        out[f] = [*turns(notices), *((s, False) for s in TEMPLATES[f] if s not in notices)]
    every_name = [n for names in NAMES.values() for n in names]
    several = [" ".join(rng.choice(strange, int(rng.integers(1, 4)))) + str(rng.choice(["", "", " License", " Public License", " License version 2", " v3"])) for _ in range(60)]
    out[OTHER] = turns([say.format(n) for i, n in enumerate(several) for say in SAYINGS[i % 2 : DENIABLE : 2]])
    said = [f"{DENIALS[(i + 3 * j + k) % len(DENIALS)]} {SAYINGS[j].format(n)}" for i, n in enumerate([*every_name, *several]) for j in range(DENIABLE) for k in range(4)]
    told = [m.format(n) for n in [*every_name, *several] for m in MENTIONS]
    out[UNKNOWN] = [*turns(said), *turns(told), *turns(OTHERS)]
    return out


@cache
def train(seed: int = 5, each: int = 240, steps: int = 160, rate: float = 0.1) -> Model:
    """Adam in numpy, since rare names need as long a step as common words, on variations of the fixed sentences; a fourth of them is held back for calibration, and every variation of the sentences that lessons() holds back. Each family has about `each` of them."""
    rng = np.random.default_rng(seed)
    families = (*sorted(TEMPLATES), OTHER, UNKNOWN)
    strange = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(400)]
    taught = lessons(rng, strange)
    odd, common = set(strange), sorted(COMMON)
    naming = {w for ns in NAMES.values() for n in ns for w in tokens(n)}
    known = sorted(g for g in set().union(*(grams(tokens(t)) for f in families for t, _ in taught[f] if t not in OTHERS)) if not odd & set(g.split()))
    column = {g: i for i, g in enumerate(known)}
    rows, goal, held = [], [], []
    for k, f in enumerate(families):
        groups = [[p for p in taught[f] if p[0] not in OTHERS], [p for p in taught[f] if p[0] in OTHERS]]
        for sentences, wanted in zip(groups, (each if f not in (OTHER, UNKNOWN) else 16 * each, 10 * each), strict=True):
            variations = -(-wanted // max(1, len(sentences)))
            for s, whole in sentences:
                words = tokens(s)
                for v in range(variations):
                    drop = 0.0 if v < max(2, variations // 3) or f == UNKNOWN else 0.12
                    own = [w for w in words if w in naming or rng.random() >= drop] or words
                    if v % 3 == 2:
                        # Articles come and go.
                        own = [w if w not in ARTICLES else "a" for w in own] if v % 2 else bare(own)
                    picks = rng.random((int(rng.integers(0, 12 if v % 2 else 50)), 2)).tolist()
                    around = [common[int(y * len(common))] if x < 0.4 else strange[int(y * len(strange))] for x, y in picks]
                    at = int(rng.integers(0, len(around) + 1))
                    # A denial may stand anywhere but right before a notice, which it would deny.
                    while at and around[at - 1] in CUES:
                        at -= 1
                    rows.append([column[g] for g in grams([*around[:at], *own, *around[at:]]) if g in column])
                    goal.append(k)
                    held.append(whole or len(rows) % 4 == 0)
    # Strange text without a licence, and stray words of the templates, are unknown as well.
    for _ in range(1500):
        words = [strange[i] for i in rng.integers(0, len(strange), int(rng.integers(3, 30))).tolist()]
        words += [known[int(rng.integers(len(known)))].split()[0] for _ in range(int(rng.integers(0, 3)))]
        rows.append([column[g] for g in grams([str(w) for w in rng.permutation(words)]) if g in column])
        goal.append(len(families) - 1)
        held.append(len(rows) % 4 == 0)
    x, y = np.zeros((len(rows), len(known)), np.float32), np.array(goal)
    for i, r in enumerate(rows):
        x[i, r] = 1
    held = np.array(held)

    def fitted(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias from these rows."""
        w, bias = np.zeros((len(known), len(families)), np.float32), np.zeros(len(families), np.float32)
        fit, one = x[some], np.eye(len(families), dtype=np.float32)[y[some]]
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            z = fit @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p -= one
            g = fit.T @ p / len(fit) + 2e-5 * w
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= rate * (1 - step / steps / 1.2) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            bias -= p.mean(0)
        # Sparse: weights that hardly count go, and features without any.
        w[np.abs(w) < 0.02] = 0
        return w, bias

    w, bias = fitted(~held)
    z = x[held] @ w + bias

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    heat = min(np.geomspace(0.05, 5, 60), key=lambda t: float(-np.log(soft(t)[np.arange(len(z)), y[held]] + 1e-12).mean()))
    # The least probability by which precision and recall of what is claimed are best together (F1).
    top, none = soft(heat), y[held] == len(families) - 1
    sure, right = top[:, :-1].max(1), (top[:, :-1].argmax(1) == y[held]) & ~none

    def f1(bar: float) -> float:
        claimed = (sure >= bar) & (sure >= top[:, -1])
        return 2 * float((claimed & right).sum()) / float(claimed.sum() + (~none).sum())

    least = max(np.linspace(0.3, 0.99, 70).tolist(), key=f1)
    # What was held back teaches as well, once it has told how far the scores can be trusted.
    w, bias = fitted(np.ones(len(rows), bool))
    weights = {g: [round(float(v), 6) for v in w[i]] for g, i in column.items() if w[i].any()}
    return Model(families, weights, [round(float(v), 6) for v in bias], round(float(heat), 6), round(least, 6))


def windows(words: F.Column) -> F.Column:
    """Runs of SPAN words at every STRIDE words; a shorter run is its own window."""
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - SPAN) / STRIDE).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * STRIDE + 1, F.lit(SPAN)))


def words_of_lines(text: str) -> F.Column:
    """The words of each line of a text."""
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    return F.transform(lines, lambda x: F.array_remove(F.split(F.lower(x), "[^a-z0-9]+"), ""))


def scanned(lines: str, model: Model, similar: float = SIMILAR):
    """A column, from one of words_of_lines(): array of (paragraph, family, probability, similarity, confirmed), one for each line at which a licence family claims a paragraph."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    features_ = F.from_json(F.lit(json.dumps(sorted(model.weights))), "array<string>")
    bias = F.array(*(F.lit(v) for v in model.bias))
    families = F.array(*map(F.lit, model.families[:-1]))
    shapes = {f: [{"pairs": sorted(neighbours(tokens(t))), "reach": 2 * len(bare(tokens(t)))} for t in dict.fromkeys(ts)] for f, ts in TEMPLATES.items()}
    templates = F.from_json(F.lit(json.dumps(shapes)), "map<string,array<struct<pairs:array<string>,reach:int>>>")
    vocabulary = F.from_json(F.lit(json.dumps(model.words)), "array<string>")
    split = F.col(lines)
    numbered = F.transform(split, lambda x, i: F.struct(i.alias("paragraph"), x.alias("words")))
    claimed = F.filter(numbered, lambda p: F.arrays_overlap(p["words"], vocabulary))

    # Each step is a transformation of its own, so that what several later ones need is computed once.
    def with_next(p):
        following = F.slice(split, p["paragraph"] + 1, F.lit(LINES))
        blank = F.array_position(F.transform(following, lambda w: F.size(w) == 0), F.lit(True))
        joined = F.slice(F.flatten(F.slice(following, 1, F.when(blank > 0, blank.cast("int") - 1).otherwise(F.lit(LINES)))), 1, F.lit(SPAN))
        return F.transform(F.concat(windows(p["words"]), F.array(joined)), lambda w: F.struct(p["paragraph"].alias("paragraph"), w.alias("words")))

    def features(p):
        words = p["words"]
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda x, y: F.concat_ws(" ", x, y))
        return F.struct(p["paragraph"].alias("paragraph"), words.alias("words"), F.array_intersect(F.concat(words, pairs), features_).alias("found"))

    def sums(p):
        z = F.aggregate(p["found"], bias, lambda s, g: F.zip_with(s, F.try_element_at(weights, g), lambda x, y: x + y))
        return F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), z.alias("z"))

    def highest(p):
        z = F.slice(p["z"], 1, len(model.families) - 1)
        return F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), p["z"].alias("z"), F.array_max(z).alias("top"))

    def name(p):
        # Of all families the one with the highest score; its probability is its share of the exponentials.
        family = F.try_element_at(families, F.array_position(p["z"], p["top"]).cast("int"))
        rest = F.aggregate(p["z"], F.lit(0.0), lambda s, v: s + F.exp((v - p["top"]) / model.temperature))
        unknown = p["top"] <= F.element_at(p["z"], -1)
        return F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), F.when(~unknown, family).alias("family"), (1 / rest).alias("probability"))

    def paired(p):
        words = F.filter(p["words"], lambda w: ~w.isin(*ARTICLES))
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda x, y: F.concat_ws(" ", x, y))
        return F.struct(p["paragraph"].alias("paragraph"), F.when(F.size(pairs) > 0, pairs).otherwise(words).alias("pairs"), p["family"].alias("family"), p["probability"].alias("probability"))

    def alignment(pairs, template):
        """The part of the template's pairs that stand within its reach, at the best place."""
        placed = F.transform(pairs, lambda g, i: F.struct(i.alias("i"), g.alias("g")))
        hits = F.filter(placed, lambda x: F.array_contains(template["pairs"], x["g"]))
        near = F.transform(hits, lambda x: F.size(F.array_distinct(F.transform(F.filter(hits, lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + template["reach"])), lambda y: y["g"]))))
        return F.coalesce(F.array_max(near), F.lit(0)) / F.size(template["pairs"])

    def compare(p):
        near = F.array_max(F.transform(F.try_element_at(templates, p["family"]), lambda t: alignment(p["pairs"], t)))
        return F.struct(p["paragraph"].alias("paragraph"), p["family"].alias("family"), p["probability"].alias("probability"), F.coalesce(near, F.lit(0.0)).alias("similarity"))

    def confirm(p):
        return F.struct((p["similarity"] >= similar).alias("confirmed"), p["probability"].alias("probability"), p["similarity"].alias("similarity"), p["paragraph"].alias("paragraph"), p["family"].alias("family"))

    named = F.transform(F.transform(F.transform(F.transform(F.flatten(F.transform(claimed, with_next)), features), sums), highest), name)
    judged = F.transform(F.transform(F.transform(F.filter(named, lambda p: p["family"].isNotNull() & (p["probability"] >= model.least)), paired), compare), confirm)
    # Of the paragraphs that begin at a line the surest counts.
    best = F.transform(F.array_distinct(F.transform(judged, lambda p: p["paragraph"])), lambda i: F.array_max(F.filter(judged, lambda p: p["paragraph"] == i)))
    return F.transform(best, lambda p: F.struct(*(p[c].alias(c) for c in ("paragraph", "family", "probability", "similarity", "confirmed"))))


def scan(docs: DataFrame, model: Model | None = None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + licenses (all claimed paragraphs), license, probability and similarity (of the confirmed paragraph of highest
    probability; ties: the first) for each row.

    license is `unknown` where paragraphs are claimed but none is confirmed, as for notices of licences that are no family
    (OTHER), and null where none is claimed, as for null and empty texts and where a licence is only denied or mentioned. `paragraph` is the line at which a paragraph begins. Repeated rows are scanned each. Columns beside
    `text` and `keep` are not read; an empty table gives an empty result.
    """
    model = model or train()
    found = docs.select(*(F.col(f"`{c}`") for c in keep), words_of_lines(f"`{text}`").alias("__lines")).select(*(F.col(f"`{c}`") for c in keep), scanned("__lines", model).alias("licenses"))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    best = F.try_element_at(F.array_sort(sure, lambda x, y: F.when(x["probability"] > y["probability"], -1).when(x["probability"] < y["probability"], 1).otherwise(x["paragraph"] - y["paragraph"])), F.lit(1))
    found = found.withColumn("__best", best)
    license_ = F.when(F.size("licenses") == 0, None).otherwise(F.coalesce(F.col("__best.family"), F.lit(UNKNOWN)))
    return found.withColumn("license", license_).withColumn("probability", F.col("__best.probability")).withColumn("similarity", F.col("__best.similarity")).drop("__best")
