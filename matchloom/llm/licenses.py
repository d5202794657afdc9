"""Licence notices: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, and lines up to a blank one joined, as notices may be wrapped; lines that are a
notice by themselves part those. Paragraphs that cover enough of any template to be confirmed (all others could not be
told anyway) are classified by a multinomial logistic regression on sparse word n-grams (1 to 3 words) into a licence
family or "unknown". It is trained here on paragraphs
drawn from notice templates and, as unknown, from sentences about licences that name no family and from running text,
with words dropped, changed and added, with a fixed seed. A temperature fitted on held-out paragraphs calibrates the
probabilities. A family is told where its probability reaches CONFIDENT and a template of the family confirms it: its
words cover CONFIRMED of the template's (weighted by rarity among the templates). Everything else is unknown.

Defined results: a null or empty text has no notices; line ends belong to no paragraph; repeated rows give equal rows;
a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIDENT, CONFIRMED = 0.6, 0.6
#: Paragraphs drawn for each template, a third of them held out, and as many unknown ones a family.
DRAWN = 60
#: Longer paragraphs are classified in overlapping windows of so many words.
WINDOW = 200
#: Words of the pieces in which joined lines are classified.
PIECES = (24, 48)
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
VERSION = re.compile(r"\bv(?:\. ?)?(?=[0-9])")
#: German for "with", but not before "license" or after an SPDX tag.
GERMAN_MIT = re.compile(r"(?<!identifier: )\b[Mm]it\b(?![\W_]+(?:licen[cs]|lizenz|style))")
#: Words of templates of so many families name none of them.
COMMON = 5

# Usual short notices of licence families.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 3.", "Released under the GPLv3 license."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "You can redistribute it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL version 2.", "Released under the GPLv2 license.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the LGPL version 3.", "Released under the terms of the GNU Lesser General Public License, version 2.1."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL version 3 license.", "This program is licensed under the AGPLv3."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-2-Clause", "Released under the BSD license.", "Use of this source code is governed by a BSD-style license."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0 license."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the ISC license."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, Version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under the EPL 1.0 license."),
    "cc-by": ("Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution License.", "Text is available under a Creative Commons Attribution license.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC-BY 3.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain, Unlicense.", "Released into the public domain."),
    "proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission.", "This software is proprietary and confidential; all rights reserved, use requires a commercial license."),
}

# Sentences about licences that name no family.
OTHERS = (
    "The licence fee is due each year.", "He lost his driving license.", "Licensed premises close at midnight.", "A license is required to fish here.", "See the license for details.",
    "Copyright law protects authors.", "Please read the copyright notice.", "The house was licensed to sell beer.", "Licensed under the terms stated elsewhere.", "Contact us about licensing and copyright questions.",
    "The software licence expired last year.", "The records are kept in a public archive.", "Licensed under the Example License, Version 2.0.", "Released under the Sample license, version 3.", "License plate numbers are stored.", "They published under a licence of their own, version 7.", "Licensing costs have gone up by 4.0 percent.",
)


def words_of(text: str) -> list[str]:
    """Words in lower case; numbers keep inner dots, so that versions stay whole; a German "mit" becomes "with"."""
    text = GERMAN_MIT.sub("with", text)
    return [w for x in WORD.findall(VERSION.sub("version ", text.lower().replace("gplv", "gpl v").replace("gpl-", "gpl v"))) for w in ([x] if "." not in x or x.replace(".", "").isdigit() else x.split("."))]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def drawn_paragraphs(drawn: int, seed: int) -> tuple[list[list[str]], list[str]]:
    """Words and families of training paragraphs."""
    rng = np.random.default_rng(seed)
    noise = ["an", "thed", "ention", "and", "la", "de", "en", "ist", "of", "onre", "work", "file", "see", "text", "it", "4.0", "version", "2", "by"]

    def varied(words: list[str], most: int) -> list[str]:
        out = [w if rng.random() > 0.05 else str(rng.choice(noise)) for w in words if rng.random() > 0.04]
        put = [str(x) for x in rng.choice(noise, rng.integers(0, most + 1))]
        cut = int(rng.integers(0, len(put) + 1))
        return put[:cut] + out + put[cut:]

    rows, families = [], []
    for family, texts in TEMPLATES.items():
        for text in texts:
            for k in range(drawn):
                rows.append(varied(words_of(text), 0 if k % 2 else 12))
                families.append(family)
    for k in range(drawn * len(TEMPLATES)):
        text = OTHERS[k % len(OTHERS)] if k % 3 else ""
        rows.append(varied(words_of(text), 20))
        families.append("unknown")
    return rows, families


class LicenseClassifier:
    """Multinomial logistic regression on the presence of word n-grams, with a fitted temperature."""

    def __init__(self, drawn: int = DRAWN, seed: int = 42, rounds: int = 120):
        rows, names = drawn_paragraphs(drawn, seed)
        self.families = [*TEMPLATES, "unknown"]
        y = np.array([self.families.index(f) for f in names])
        held = np.arange(len(y)) % 3 == 0
        sets = [grams_of(r) for r in rows]
        seen = Counter(g for s, h in zip(sets, held, strict=True) if not h for g in s)
        self.ids = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n >= 8))}
        x = np.zeros((len(rows), len(self.ids)), np.float32)
        for k, s in enumerate(sets):
            own = [self.ids[g] for g in s if g in self.ids]
            x[k, own] = 1 / np.sqrt(max(1, len(own)))
        want = np.eye(len(self.families), dtype=np.float32)[y]
        self.weight, self.bias, self.temperature = np.zeros((len(self.ids), len(self.families)), np.float32), np.zeros(len(self.families), np.float32), 1.0
        pace, xs, ws = np.zeros_like(self.weight), x[~held], want[~held]
        for _ in range(rounds):  # gradient steps with momentum
            error = softmax(xs @ self.weight + self.bias) - ws
            pace = 0.9 * pace - 8.0 * (xs.T @ error / len(xs) + 1e-5 * self.weight)
            self.weight += pace
            self.bias -= 0.5 * error.mean(0)
        logits, truth = x[held] @ self.weight + self.bias, y[held]
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        self.accuracy = float((logits.argmax(1) == truth).mean())
        self.templates = {f: [frozenset(words_of(t)) for t in texts] for f, texts in TEMPLATES.items()}
        n = Counter(w for texts in self.templates.values() for t in texts for w in t)
        total = sum(len(t) for t in self.templates.values())
        self.rare = {w: float(np.log(1 + total / c)) for w, c in n.items()}
        families = Counter(w for texts in self.templates.values() for w in frozenset().union(*texts))
        others = {w for t in OTHERS for w in words_of(t)}
        self.all_templates = [t for texts in self.templates.values() for t in texts]
        self.shares: dict[str, list[tuple[int, float]]] = {}
        for k, t in enumerate(self.all_templates):
            for w in t:
                self.shares.setdefault(w, []).append((k, self.rare[w] / sum(self.rare[x] for x in t)))
        self.naming = {w for w, c in families.items() if c < COMMON and w not in others and not w[0].isdigit()}

    def classify(self, words: list[str]) -> tuple[str, float]:
        own = [self.ids[g] for g in grams_of(words) if g in self.ids]
        p = softmax((self.weight[own].sum(0) / np.sqrt(max(1, len(own))) + self.bias)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.families[k], float(p[k])

    def confirm(self, family: str, words: list[str]) -> float:
        """Largest weighted share of a template of the family that the words cover; a word that names it must be among them."""
        own = set(words)
        return max((sum(self.rare[w] for w in t & own) / sum(self.rare[w] for w in t) for t in self.templates.get(family, ()) if t & own & self.naming), default=0.0)

    def coverable(self, own: set[str]) -> bool:
        """Whether confirm may reach CONFIRMED for any family, with these words or fewer."""
        own = own & self.shares.keys()
        if own.isdisjoint(self.naming):
            return False
        covered = [0.0] * len(self.all_templates)
        for w in own:
            for k, share in self.shares[w]:
                covered[k] += share
        return any(c >= CONFIRMED - 1e-9 and not self.naming.isdisjoint(t & own) for c, t in zip(covered, self.all_templates, strict=True))

    def told(self, words: list[str]) -> tuple[str, float, float] | None:
        """Family, probability and similarity of a confirmed piece."""
        if self.coverable(set(words)):
            family, p = self.classify(words)
            if family != "unknown" and p >= CONFIDENT and (s := self.confirm(family, words)) >= CONFIRMED:
                return family, p, s
        return None

    def line_notice(self, words: list[str]) -> tuple[str, float, float] | None:
        best = None
        if self.coverable(set(words)):
            for first in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
                part = words[first : first + WINDOW]
                for piece in ([part] if len(part) <= 40 else [part, *(part[a : a + 24] for a in range(0, len(part), 12))]):
                    if (found := self.told(piece)) and (best is None or found[1:] > best[1:]):
                        best = found
        return best

    def wrapped_notices(self, words: list[str]) -> list[tuple[int, int, str, float, float]]:
        """First word, end, family, probability and similarity of notices in joined lines; of those that overlap the best.

        A notice reaches as far as pieces of its family that overlap it do.
        """
        if not self.coverable(set(words)):
            return []
        step, found = PIECES[0] // 2, []
        spans = {(0, len(words))} if len(words) <= WINDOW else set()
        spans |= {(a, min(a + n, len(words))) for n in PIECES for a in range(0, len(words), step)}
        for a in range(0, len(words), WINDOW):
            # words of all pieces that begin here
            if self.coverable(set(words[a : a + 2 * WINDOW])):
                found += [(*span, *t) for span in sorted(x for x in spans if a <= x[0] < a + WINDOW) if (t := self.told(words[slice(*span)]))]
        out: list[tuple[int, int, str, float, float]] = []
        for x in sorted(found, key=lambda x: (-x[3], -x[4], x[0], x[1])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in out) and x[2] not in {y[2] for y in out}:
                out.append(x)
        return [self._widened(x, out, found) for x in out]

    @staticmethod
    def _widened(x: tuple, out: list[tuple], found: list[tuple]) -> tuple:
        """A notice with the pieces of its family that overlap it, up to the notices of other families."""
        low = max((y[1] for y in out if y[1] <= x[0]), default=0)
        high = min((y[0] for y in out if y[0] >= x[1]), default=1 << 62)
        near = [y for y in found if y[2] == x[2] and y[0] < x[1] and x[0] < y[1]]
        return max(low, min(y[0] for y in near)), min(high, max(y[1] for y in near)), *x[2:]

    def notices(self, text: str | None) -> list[tuple[int, int, int, str, float, float]]:
        """First line, start, end, family, probability and similarity of the notices of a text.

        Lines that could be notices by their words, but are told or confirmed by none, are of the family "unknown",
        with the probability of what they were taken for.
        """
        if not text:
            return []
        lines = text.split("\n")
        split = [words_of(x) for x in lines]
        if not self.coverable(set().union(*split)):
            return []
        starts = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
        out, run = [], []
        doubtful: list[int] = []

        def end_run() -> None:
            if len(run) > 1:
                at = [k for k in run for _ in split[k]]
                for a, b, *found in self.wrapped_notices([w for k in run for w in split[k]]):
                    out.append((at[a], starts[at[a]], starts[at[b - 1]] + len(lines[at[b - 1]]), *found))
            run.clear()

        for k, line in enumerate(lines):
            if found := self.line_notice(split[k]):
                end_run()
                out.append((k, starts[k], starts[k] + len(line), *found))
            elif line.strip():
                run.append(k)
                if self.coverable(set(split[k])):
                    doubtful.append(k)
            else:
                end_run()
        end_run()
        covered = [(a, b) for _, a, b, *_ in out]
        for k in doubtful:
            if not any(a < starts[k] + len(lines[k]) and starts[k] < b for a, b in covered):
                family, p = self.classify(split[k][:WINDOW])
                out.append((k, starts[k], starts[k] + len(lines[k]), "unknown", p, self.confirm(family, split[k])))
        return sorted(out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_fitted: dict[int, LicenseClassifier] = {}


def classifier(seed: int = 42) -> LicenseClassifier:
    if seed not in _fitted:
        _fitted[seed] = LicenseClassifier(seed=seed)
    return _fitted[seed]


NOTICES = "notices array<struct<paragraph:long,start:long,end:long,family:string,probability:double,similarity:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and NOTICES of every row of docs (doc_id, text); positions are code points, ends exclusive."""
    model = classifier()
    names = ("paragraph", "start", "end", "family", "probability", "similarity")
    item = pa.struct([(n, pa.string() if n == "family" else pa.float64() if n in names[4:] else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, n, strict=True)) for n in model.notices(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(item))], names=["doc_id", "notices"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {NOTICES}")


def digests(found: DataFrame) -> DataFrame:
    """A line a document: number of notices, families in order of the alphabet, notices with their spans and their
    probabilities, and the number of paragraphs of unknown family."""
    known, unknown = F.filter("notices", lambda n: n["family"] != "unknown"), F.filter("notices", lambda n: n["family"] == "unknown")
    families = F.array_join(F.array_sort(F.array_distinct(known["family"])), ",")
    spans = F.array_join(F.transform(known, lambda n: F.concat_ws(":", n["family"], n["start"], n["end"])), ",")
    told = F.array_join(F.transform(known, lambda n: F.format_string("%.4f", n["probability"])), ",")
    return found.select(
        "doc_id", F.size(known).cast("long").alias("n_notices"), families.alias("families"), spans.alias("notices"), told.alias("probabilities"), F.size(unknown).cast("long").alias("n_unknown")
    )
