"""Licence scan by a generalised suffix automaton of licence tokens.

The templates are fixed texts, so the automaton is small (two states a token at most) and travels with the task. A
text is streamed through it once: after each word, the automaton's state and length are the matching statistic (the
longest run of words ending here that occurs in some template). Maximal long runs are then chained, template by
template, in increasing order on both sides; the template words a chain covers, over the template's length, is its
coverage. Words that occur in no template reset the automaton, so the loop visits only the words of licences.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Texts and notices of public licences as words, with the label of each. A chain need not cover a whole text:
# MIN_WORDS of it are enough.
_GPL_TAIL = (
    "as published by the free software foundation either version {} of the license or at your option any later version "
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
    "merchantability or fitness for a particular purpose see the {} for more details you should have received a copy of the {} "
    "along with this program if not see https www gnu org licenses"
)
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
    "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution"
)
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
    "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including "
    "but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
    "of the use of this software even if advised of the possibility of such damage"
)
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license " + _GPL_TAIL.format("3", "gnu affero general public license", "gnu affero general public license")),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
        "or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd", _BSD_HEAD + " " + _BSD_TAIL),
    (
        "bsd",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
        "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license " + _GPL_TAIL.format("3", "gnu general public license", "gnu general public license")),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license " + _GPL_TAIL.format("2 1", "gnu lesser general public license", "gnu lesser general public license")),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software " + _AS_IS,
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
]
#: Shortest run of words that counts as a long match, most words left out between two links of a chain; least coverage of a
#: template, or words of it, for a label.
MIN_MATCH, MAX_GAP, MIN_COVERAGE, MIN_WORDS = 4, 8, 0.6, 15

#: Bytes that part words after A-Z was lower-cased: all ASCII but 0-9 and a-z.
_PART = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text: lower-cased A-Z, runs of digits, letters and non-ASCII."""
    return (text or b"").lower().translate(_PART).split()


class Automaton:
    """Suffix automaton of several token sequences; position k of sequence t is (t, k)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for k, token in enumerate(sequence):
                last = self._extend(last, token, ends)
                ends[last].add((t, k))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(x) for x in ends]

    def _state(self, length: int, follow: dict, link: int, ends: list[set]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int, ends: list[set]) -> int:
        """The state for the longest string of p and token, where that is shorter than q's."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, ends: list[set]) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token, ends)
        new, p = self._state(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][token], token, ends)
        return new


@lru_cache(maxsize=4)
def _compiled(base: tuple, templates: tuple):
    texts = [(label, phrase.encode().split(), True) for phrase, label in base] + [(label, text.encode().split(), False) for label, text in templates]
    ids: dict[bytes, int] = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in x] for _, x, _ in texts]
    machine = Automaton(sequences)
    #: base phrases that end wherever a match in this state ends, if the match is as long: those whose whole string the
    #: state stands for, and those of its shorter suffixes
    phrases: list[list] = [[] for _ in machine.ends]
    for s in sorted(range(1, len(phrases)), key=lambda s: machine.length[s]):
        above = machine.link[s]
        own = [(len(sequences[t]), t) for t, k in machine.ends[s] if texts[t][2] and k == len(sequences[t]) - 1]
        phrases[s] = [x for x in own if machine.length[above] < x[0] <= machine.length[s]] + phrases[above]
    return texts, ids, machine, phrases


def scan(text: bytes | None, base: tuple = tuple(BASE.items()), templates: tuple = tuple(TEMPLATES), min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_coverage: float = MIN_COVERAGE, min_words: int = MIN_WORDS) -> dict:
    """n_words, hits [(start, label)] of base phrases, spans [(label, first, last word, coverage)] of templates."""
    texts, ids, machine, phrases = _compiled(base, templates)
    found = words(text)
    at = [(i, ids[w]) for i, w in enumerate(found) if w in ids]
    hits, runs = [], []
    state = length = 0
    before, follow, link, longest = -2, machine.next, machine.link, machine.length
    for i, token in at:
        if i != before + 1:
            if length >= min_match:
                runs.append((before, length, state))
            state = length = 0
        held = (before, length, state)
        while state and token not in follow[state]:
            state = link[state]
            length = longest[state]
        if token in follow[state]:
            state, length = follow[state][token], length + 1
        if held[1] >= min_match and length != held[1] + 1 and i == before + 1:
            runs.append(held)
        hits.extend((i - n + 1, texts[t][0]) for n, t in phrases[state] if n <= length)
        before = i
    if length >= min_match:
        runs.append((before, length, state))
    return {"n_words": len(found), "hits": hits, "spans": _chain(runs, texts, machine, max_gap, min_coverage, min_words)}


def _chain(runs: list[tuple], texts: list, machine: Automaton, max_gap: int, min_coverage: float, min_words: int) -> list[tuple]:
    """Spans (label, first, last word, coverage): chains of runs, in order in text and template, that cover enough.

    Chains that the text has left behind by more than the gap are closed, so few are open at any place."""
    by_template: dict[int, list[tuple]] = {}
    for end, length, state in runs:
        for t, k in machine.ends[state]:
            if not texts[t][2] and k + 1 >= length:
                by_template.setdefault(t, []).append((end - length + 1, end, k - length + 1, k))
    spans = []
    for t, matches in by_template.items():
        size, open_chains, top = len(texts[t][1]), [], {}
        enough = min(min_coverage * size, min_words)

        def close(chain: list, top=top, enough=enough) -> None:
            if chain[4] >= enough and (chain[0] not in top or chain[4] > top[chain[0]][4]):
                top[chain[0]] = chain

        for first, last, a, b in sorted(matches):
            still = []
            for c in open_chains:
                still.append(c) if first - c[1] - 1 <= max_gap else close(c)
            # the longest open chain that this match continues: later in the text and in the template
            able = [c for c in still if first > c[1] and a > c[3]]
            best = max(able, key=lambda c: c[4], default=None)
            still.append([best[0], last, best[2], b, best[4] + b - a + 1] if best else [first, last, a, b, b - a + 1])
            open_chains = still
        for c in open_chains:
            close(c)
        spans += [(c[0], c[1], -c[4], texts[t][0], min(1.0, c[4] / size)) for c in top.values()]
    return sorted((label, first, last, coverage) for first, last, _, label, coverage in _best(sorted(spans)))


def _best(spans: list[tuple]) -> list[tuple]:
    """Without spans that overlap one of more words: templates share passages, and the one that covers most names the place."""
    out, cluster, end = [], [], -1
    for span in [*spans, (1 << 62,) * 3]:
        if span[0] > end:
            kept: list[tuple] = []
            for x in sorted(cluster, key=lambda x: x[2]):
                if not any(y[2] < x[2] and y[0] <= x[1] and x[0] <= y[1] for y in kept):
                    kept.append(x)
            out.extend(kept)
            cluster = []
        cluster.append(span)
        end = max(end, span[1])
    return out


SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])


def scan_licences(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans of every row.

    Base phrases are found at all places, overlaps included; labels are those of base phrases and of templates of
    which a chain covers ``min_coverage``, or ``min_words`` words; score is the largest coverage found (1 with a base phrase, 0 with nothing).
    A null text is an empty one: no words, empty labels, null places. Repeated rows are scanned alike."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for x in b.column("text").to_pylist():
                r = scan(x, **options)
                starts, own = [s for s, _ in r["hits"]], {label for _, label in r["hits"]}
                values = (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in r["spans"]})), 1.0 if own else max((s[3] for s in r["spans"]), default=0.0), [dict(zip(("label", "first", "last", "coverage"), s)) for s in r["spans"]])
                for k, v in zip(out, values):
                    out[k].append(v)
            n, s, f = pa.int64(), pa.string(), pa.float64()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), (n, n, n, n, s, s, f, pa.list_(SPAN)))]], ["doc_id", *out])

    held = documents.select("doc_id", F.col(text).cast("binary").alias("text"))
    kind = dict(held.dtypes)["doc_id"]
    return mapped(held, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,coverage:double>>")
