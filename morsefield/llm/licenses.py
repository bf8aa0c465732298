"""License scans by template matching.

A template is license wording with mark-up: ``[[...]]`` is optional, ``{{n}}`` stands for any 0 to n words (a name, a
year), ``{{a|b}}`` for one of the wordings listed; regions nest. It compiles to a token automaton: states joined by
words, by empty moves around optional regions, and by wildcard moves. A text is accepted where the words from some
place on spell a path from start to end, so mandatory wording has to match word for word.

All automata run at once: anchors (the first mandatory words of a template) are looked up per word, so a text without
them costs one dictionary probe a word; from an anchor the set of states is advanced a word at a time. Each automaton
has a longest path, so the work for an anchor is bounded and a scan is linear in the text.

Defined results. Null text counts as empty: no words, no places, empty labels, score 0. Repeated rows are scanned one
by one. Overlapping places all count. Score is 0 without a label, 1 with an accepted template, and 0.8 for a bare
mention of a base phrase. Texts are scanned whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, bounded_batches, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = str.maketrans(UPPER, LOWER)
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Wording of public licences. Shared clauses first.
_COPYRIGHT = "[[copyright [[c]] {{16}} [[all rights reserved]]]]"
_AS_IS_SOFTWARE = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall {{the authors or copyright holders|the copyright holders|the authors}} be liable for any claim "
    "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_AS_IS_BSD = (
    "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
_AS_IS_ISC = (
    "the software is provided as is and {{12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {{12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERT = "3 all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{16}}"
_BSD_NAMES = "[[{{3|4}}]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GPL_WARRANTY = (
    "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu {{general|lesser general|affero general}} public license for more details "
    "you should have received a copy of the gnu {{general|lesser general|affero general}} public license along with this {{program|library|software}} "
    "{{if not see [[http|https]] www gnu org licenses|if not write to the free software foundation inc {{12}} usa}}"
)

#: Whole wordings (-text) and the notices by which files refer to licences (-notice).
TEMPLATES = {
    "mit-text": _COPYRIGHT
    + " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _AS_IS_SOFTWARE,
    "mit-0-text": _COPYRIGHT
    + " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so " + _AS_IS_SOFTWARE,
    "isc-text": _COPYRIGHT
    + " permission to use copy modify and {{or|and or}} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies " + _AS_IS_ISC,
    "0bsd-text": _COPYRIGHT + " permission to use copy modify and {{or|and or}} distribute this software for any purpose with or without fee is hereby granted " + _AS_IS_ISC,
    "bsd-2-text": " ".join((_COPYRIGHT, _BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _AS_IS_BSD)),
    "bsd-3-text": " ".join((_COPYRIGHT, _BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _AS_IS_BSD)),
    "bsd-4-text": " ".join((_COPYRIGHT, _BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_ADVERT, _BSD_NAMES, _AS_IS_BSD)),
    "zlib-text": _COPYRIGHT
    + " this software is provided as is without any express or implied warranty in no event will the {{author|authors}} be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "[[3]] this notice may not be removed or altered from any source distribution",
    "bsl-1-text": "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
    "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part "
    "and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement "
    "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense-text": "free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software "
    "[[for more information please refer to [[http|https]] unlicense org]]",
    "wtfpl-text": "do what the fuck you want to public license [[version 2 december 2004]] [[copyright [[c]] {{16}}]] everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed "
    "do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to",
    "apache-2-boilerplate": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http|https]] www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "gpl-boilerplate": "free software you can redistribute it and or modify it under the terms of {{the gnu general public license|version 2 of the gnu general public license}} as published by the free software foundation "
    "[[{{either version {{2|3}} of the license or [[at your option]] any later version|version {{2|3}} of the license}}]] {{4}} " + _GPL_WARRANTY,
    "lgpl-boilerplate": "free software you can redistribute it and or modify it under the terms of the gnu {{lesser|library}} general public license as published by the free software foundation "
    "either version {{2|2 1|3}} of the license or [[at your option]] any later version this {{program|library|file}} " + _GPL_WARRANTY,
    "agpl-boilerplate": "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
    "either version 3 of the license or [[at your option]] any later version this {{program|file}} " + _GPL_WARRANTY,
    "mpl-2-boilerplate": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http|https]] mozilla org mpl 2 0",
    "mit-notice": "licensed under the mit license",
    "apache-2-notice": "licensed under the apache license version 2 [[0]]",
    "bsd-notice": "licensed under the {{2 clause|3 clause|new|modified|simplified|}} bsd license",
    "gpl-notice": "[[this {{work|program|file}} is]] licensed under the gnu [[lesser|affero]] general public license version {{2|3|2 1}}",
    "cc-by-nc-notice": "licensed under cc by nc {{2|3|4}} 0",
    "cc-by-notice": "licensed under [[a]] [[the]] creative commons attribution [[4 0 international]] license",
    "cc0-notice": "to the extent possible under law {{12}} {{has|have}} waived all copyright and related or neighboring rights to {{12}}",
    "all-rights-reserved": "copyright [[c]] {{12}} all rights reserved",
}


def tokens(text: str) -> list[str]:
    return WORD.findall(text.translate(_AZ))


@dataclass
class Automaton:
    """moves[state]: word -> states; empty[state]: states reached for free; wild: states that swallow any one word."""

    label: str
    moves: list[dict[str, set[int]]]
    empty: list[set[int]]
    wild: list[set[int]]
    start: int
    end: int

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def first_words(self) -> set[str]:
        """Words that can begin a match; a template has to begin with a word."""
        begin = self.closure({self.start})
        if self.end in begin or any(self.wild[s] for s in begin):
            raise ValueError(f"{self.label}: a template begins with mandatory wording")
        return {w for s in begin for w in self.moves[s]}

    def longest(self, words: list[str], at: int) -> int:
        """End of the longest match that begins at this word, or -1."""
        states, best = self.closure({self.start}), -1
        for i in range(at, len(words)):
            nxt: set[int] = set()
            for s in states:
                nxt |= self.wild[s]
                nxt |= self.moves[s].get(words[i], set())
            if not nxt:
                return best
            states = self.closure(nxt)
            if self.end in states:
                best = i + 1
        return best


def compile_template(label: str, source: str) -> Automaton:
    parts = re.findall(r"\[\[|\]\]|\{\{|\}\}|\||[^\s\[\]{}|]+", source.translate(_AZ))
    a = Automaton(label, [], [], [], 0, 0)

    def state() -> int:
        a.moves.append({})
        a.empty.append(set())
        a.wild.append(set())
        return len(a.moves) - 1

    def sequence(at: int, i: int, stop: tuple[str, ...]) -> tuple[int, int]:
        """Reads parts from i up to one of stop; returns (state reached, place of the stop)."""
        while i < len(parts) and parts[i] not in stop:
            if parts[i] in ("[[", "{{"):
                optional = parts[i] == "[["
                close = "]]" if optional else "}}"
                after = state()
                if not optional and parts[i + 1].isdigit() and parts[i + 2] == close and int(parts[i + 1]) > 0:
                    for _ in range(int(parts[i + 1])):
                        a.empty[at].add(after)
                        nxt = state()
                        a.wild[at].add(nxt)
                        at = nxt
                    a.empty[at].add(after)
                    at, i = after, i + 3
                    continue
                if optional:
                    a.empty[at].add(after)
                i += 1
                while True:
                    begin = state()
                    a.empty[at].add(begin)
                    reached, i = sequence(begin, i, ("|", close))
                    if i >= len(parts):
                        raise ValueError(f"{label}: region is not closed")
                    a.empty[reached].add(after)
                    i += 1
                    if parts[i - 1] == close:
                        break
                at = after
            elif parts[i] in ("]]", "}}", "|"):
                raise ValueError(f"{label}: {parts[i]} without a region")
            else:
                nxt = state()
                a.moves[at].setdefault(parts[i], set()).add(nxt)
                at, i = nxt, i + 1
        return at, i

    a.start = state()
    a.end, _ = sequence(a.start, 0, ())
    return a


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.phrases = {}
        for phrase, label in phrases:
            own = phrase.split()
            self.phrases.setdefault(own[0], []).append((own, label))
        self.by_word: dict[str, list[Automaton]] = {}
        for label, source in (TEMPLATES if templates is None else templates).items():
            a = compile_template(label, source)
            for w in a.first_words():
                self.by_word.setdefault(w, []).append(a)
        self.anchors = self.phrases.keys() | self.by_word.keys()

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base labels, all labels, score, matches as (label, start, end))."""
        words = tokens(text)
        places, base, found = [], set(), []
        for i in [i for i, w in enumerate(words) if w in self.anchors]:
            for own, label in self.phrases.get(words[i], ()):
                if words[i : i + len(own)] == own:
                    places.append(i)
                    base.add(label)
            for a in self.by_word.get(words[i], ()):
                if (end := a.longest(words, i)) > i:
                    found.append((a.label, i, end))
        labels = base | {x[0] for x in found}
        score = 1.0 if found else 0.8 if base else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found


def license_report(docs: DataFrame, *, templates: dict[str, str] | None = None, matches: bool = False) -> DataFrame:
    """A row for each input row; with matches also the accepted templates and their word ranges."""
    plain = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    extra = ", matches array<struct<label:string,start:long,end:long>>"
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))]
            if matches:
                own = [[{"label": a, "start": b, "end": c} for a, b, c in m] for m in cols[7]]
                arrays.append(pa.array(own, found))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, *["matches"] * matches])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, plain + extra * matches)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))
