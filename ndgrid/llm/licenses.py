"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Texts and templates become lower-case words of letters and digits, then shingles of SHINGLE words. Templates of up to
M = 2**c words (and over M / 2) form a class. For each class a text is cut into strips of M / 2 words; a window is
three strips in a row (fewer at the end), one starting at every strip, so every run of M words lies within a window.
A window has at most 3 M / 2 shingles. A template of n words has n - SHINGLE + 1, of which an occurrence holds at
least CONTAINMENT: for n of five or more that is a quarter of the window's or more (3 of 12, 6 of 24, 12 of 48, ...).
Each band is one MinHash, and BANDS of them miss such a window with a chance of (3/4)**BANDS, about 1e-8. Templates of
three or four words share a sixth or more with their window, and are missed with a chance of (5/6)**BANDS, about 1e-5.
A template that shares a band with a window is a candidate there; the share of its shingles in the window, counted
exactly, decides. Shingles have three words because notices have as few as five.

Windows that hold the template and overlap are one region, which :func:`occurrences` splits into occurrences. Sibling
licenses share most of their words: an occurrence needs those of REQUIRED exactly, and of templates that overlap the one
with most shingles there gives the place its name.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ndgrid.llm.rows import map_texts

SHINGLE = 3
BANDS = 64
#: Share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Bytes of text that are cut into words together: an array of its words' hashes stays in a core's cache.
SLICE_BYTES = 500_000

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_KEEP = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_SHOW = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "This software is provided by the copyright holders and contributors \"as is\""
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License v{}"
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Short forms of public licenses' notices, by SPDX identifier. Any mapping may be given instead. What
#: licenses of one family have in common and does not tell them apart has a LicenseRef of its own.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Released under the MIT License", f"{_PERMIT}, to deal in the Software without restriction"],
    "MIT-0": [f"{_PERMIT} (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. The software is provided \"as is\""],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: " + _GNU.format("General Public License", ",", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; " + _GNU.format("General Public License", ";", "2"), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "This program is free software: " + _GNU.format("Affero General Public License", ",", "3")],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", "This library is free software: " + _GNU.format("Lesser General Public License", ",", "3")],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; " + _GNU.format("Lesser General Public License", ";", "2.1")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", _CC.format("-NonCommercial")],
    "CC-BY-4.0": [_CC.format(""), "Licensed under CC BY 4.0"],
    "CC-BY-SA-4.0": [_CC.format("-ShareAlike"), "Licensed under CC BY-SA 4.0"],
    "CC-BY-ND-4.0": [_CC.format("-NoDerivatives"), "Licensed under CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": [_CC.format("-NonCommercial-ShareAlike"), "Licensed under CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": [_CC.format("-NonCommercial-NoDerivatives"), "Licensed under CC BY-NC-ND 4.0"],
    "CC0-1.0": ["Licensed under CC0 1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "LicenseRef-BSD": [_BSD],
    "BSD-2-Clause": [f"{_BSD}: {_KEEP} {_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD}: {_KEEP} {_ENDORSE} {_AS_IS}"],
    "BSD-4-Clause": [f"{_BSD}: {_KEEP} {_SHOW} {_ENDORSE} {_AS_IS}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "EPL-2.0": [_EPL.format(". 2.0"), _EPL.format("2.0")],
    "EPL-1.0": [_EPL.format("1.0")],
    "ISC": [f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": [f"{_USE}. The software is provided \"as is\" and the author disclaims all warranties"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}

_TWO, _THREE = ("version 2", "v2", "gplv2"), ("version 3", "v3", "gplv3", "lgplv3", "agplv3")
#: Words that tell a license from its siblings: of each tuple that a template of it has, an occurrence has one, exactly.
REQUIRED = {
    "Apache-2.0": [("Apache License Version 2",)],
    "MIT": [("to deal in the software",), ("MIT License",)],
    "MIT-0": [("to do so the software is provided",)],
    "GPL-3.0": [("GNU General Public License",), _THREE],
    "GPL-2.0": [("GNU General Public License",), _TWO],
    "AGPL-3.0": [("GNU Affero General Public License",), _THREE],
    "LGPL-3.0": [("GNU Lesser General Public License",), _THREE],
    "LGPL-2.1": [("GNU Lesser General Public License",), ("version 2 1", "v2 1", "lgplv2 1")],
    "CC-BY-4.0": [("Commons Attribution 4",), ("CC BY 4",)],
    "CC-BY-NC-4.0": [("Attribution-NonCommercial 4",), ("CC BY-NC 4",)],
    "CC-BY-SA-4.0": [("Attribution-ShareAlike 4",), ("CC BY-SA 4",)],
    "CC-BY-ND-4.0": [("Attribution-NoDerivatives 4",), ("CC BY-ND 4",)],
    "CC-BY-NC-SA-4.0": [("Attribution-NonCommercial-ShareAlike 4",), ("CC BY-NC-SA 4",)],
    "CC-BY-NC-ND-4.0": [("Attribution-NonCommercial-NoDerivatives 4",), ("CC BY-NC-ND 4",)],
    "BSD-2-Clause": [("provided with the distribution this software is provided",)],
    "BSD-3-Clause": [("endorse or promote products",)],
    "BSD-4-Clause": [("all advertising materials",), ("endorse or promote products",)],
    "MPL-2.0": [("Public License 2", "Public License v 2", "Public License v2", "Public License version 2")],
    "EPL-2.0": [("Public License 2", "Public License v 2", "Public License v2", "Public License version 2")],
    "EPL-1.0": [("Public License 1", "Public License v 1", "Public License v1", "Public License version 1")],
    "ISC": [("provided that the above copyright notice and this permission notice",)],
    "0BSD": [("hereby granted the software is provided",)],
    "BSL-1.0": [("Boost Software License Version 1",)],
}

MATCHES = "array<struct<license:string,containment:double,start:bigint,end:bigint>>"
_OUT = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

#: a-z, 0-9 and bytes of non-ASCII characters make words; A-Z fold.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _bands() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the MinHash functions, by rule."""
    rng = np.random.Generator(np.random.PCG64(20_11))
    return rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words, given the words' hashes; of the whole text if it has fewer."""
    k = min(k, len(h))
    if not k:
        return h
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out ^ (h[i : i + len(out)] * _MIX[i])) * _MIX[0]
        out ^= out >> np.uint64(29)
    return out


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def _runs(h: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Where ``run`` begins in ``h``."""
    ok = np.ones(max(0, len(h) - len(run) + 1), dtype=bool)
    for i, x in enumerate(run):
        ok &= h[i : i + len(ok)] == x
    return np.flatnonzero(ok)


class Templates:
    """The templates' shingles, and for each class a lookup from (band, MinHash) to templates."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.shingles, self.times, self.sizes, self.required = [], [], [], [], []
        for name in sorted(templates):
            for text in templates[name]:
                words = _words(text)
                if words:
                    h = word_hashes(words)
                    groups = [[word_hashes(_words(x)) for x in group] for group in REQUIRED.get(name, ())]
                    self.required.append([g for g in groups if any(len(_runs(h, run)) for run in g)])
                    self.names.append(name)
                    shingles, times = np.unique(shingle_hashes(h), return_counts=True)
                    self.shingles.append(shingles)
                    self.times.append(times.tolist())
                    self.sizes.append(len(words))
        self.mult, self.add = _bands()
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        for i, (n, s) in enumerate(zip(self.sizes, self.shingles)):
            c = max(2, (n - 1).bit_length())
            lookup = self.classes.setdefault(c, [{} for _ in range(BANDS)])
            for band, value in zip(lookup, self.minhash(s)):
                band.setdefault(int(value), []).append(i)
        self.keys = {c: [np.array(sorted(b), dtype=np.uint64) for b in bands] for c, bands in self.classes.items()}

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles[:, None] * self.mult + self.add).min(axis=0)


def find(t: Templates, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, template, containment, first word, last word) of each occurrence of a template.

    ``hashes`` are the words' of all texts, ``first`` each text's first word and, last, their number. A text's words
    are followed through on their own: no shingle or window goes across two texts.
    """
    n_words = np.diff(first)
    # Shingles by text; a strip's shingles are those that begin in it.
    k = np.minimum(SHINGLE, n_words)
    n_sh = np.where(n_words > 0, n_words - k + 1, 0)
    long = n_words >= SHINGLE
    if not t.classes or not n_sh.sum():
        return []
    at = np.repeat(first[:-1], n_sh) + _counting(n_sh)
    whole = shingle_hashes(hashes) if len(hashes) >= SHINGLE else np.zeros(len(hashes), dtype=np.uint64)
    sh = np.zeros(len(at), dtype=np.uint64)
    ok = np.repeat(long, n_sh)
    sh[ok] = whole[at[ok]]
    for i in np.flatnonzero(~long & (n_words > 0)).tolist():
        sh[np.searchsorted(at, first[i])] = shingle_hashes(hashes[first[i] : first[i + 1]])[0]
    begin = np.concatenate(([0], np.cumsum(n_sh)))
    # Strips of a class are whole runs of strips of the smallest one, whose minima are taken once for all classes.
    fine = 1 << (min(t.classes) - 1)
    n_fine = -(-n_sh // fine)
    fine_begin = np.cumsum(n_fine) - n_fine
    fine_edge = np.repeat(begin[:-1], n_fine) + fine * _counting(n_fine)
    # A column for each strip; a text's last one is made whole with the last shingle, which leaves the minimum as it is.
    columns = sh[np.minimum(fine_edge + np.arange(fine)[:, None], np.repeat(begin[1:], n_fine) - 1)]
    cuts = {}
    for c in sorted(t.classes):
        ratio = (1 << (c - 1)) // fine
        strips = -(-n_fine // ratio)
        number = _counting(strips)
        last_strip = np.repeat(np.cumsum(strips), strips)  # of each strip, the end of its text's strips
        window_end = np.minimum(np.arange(len(number)) + 3, last_strip)
        inside = [np.flatnonzero(np.arange(len(number)) + step < window_end) for step in (1, 2)]
        cuts[c] = (np.repeat(fine_begin, strips) + ratio * number, np.repeat(begin[:-1], strips) + ratio * fine * number, window_end, inside)
    candidates: dict[int, set] = {c: set() for c in cuts}
    value = np.empty_like(columns)
    for band in range(BANDS):
        np.multiply(columns, t.mult[band], out=value)
        np.add(value, t.add[band], out=value)
        fine_low = value.min(axis=0)
        for c, (at_fine, _, _, inside) in cuts.items():
            low = np.minimum.reduceat(fine_low, at_fine) if len(at_fine) < len(fine_low) else fine_low
            win = low.copy()
            for step, on in enumerate(inside, 1):
                win[on] = np.minimum(win[on], low[on + step])
            keys = t.keys[c][band]
            spot = np.minimum(np.searchsorted(keys, win), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == win)
            candidates[c].update((w, i) for w in hit.tolist() for i in t.classes[c][band][int(win[w])])
    out = []
    for c, (_, edge, window_end, _) in cuts.items():
        edges, most = np.append(edge, len(sh)), 3 << (c - 1)
        regions: dict[int, list[list[int]]] = {}
        for w, i in sorted(candidates[c]):
            a, b = int(edges[w]), int(edges[window_end[w]])
            if len(np.intersect1d(sh[a:b], t.shingles[i])) / len(t.shingles[i]) >= CONTAINMENT:
                text = int(np.searchsorted(begin, a, side="right") - 1)
                known = regions.setdefault(i, [])
                if known and known[-1][0] == text and a <= known[-1][2]:
                    known[-1][2] = b
                else:
                    known.append([text, a, b])
        for i, known in regions.items():
            for text, a, b in known:
                place = np.minimum(np.searchsorted(t.shingles[i], sh[a:b]), len(t.shingles[i]) - 1)
                held = np.flatnonzero(t.shingles[i][place] == sh[a:b])
                at_word = at[a + held] - first[text]
                tells = _teller(t, i, hashes[first[text] : first[text + 1]], int(at_word[0]), int(at_word[-1] + k[text]))
                for share, lo, hi in occurrences(at_word.tolist(), place[held].tolist(), t.times[i], most, int(k[text]), tells):
                    out.append((text, i, share, lo, hi))
    # A place has one name: that of the template with most shingles there, at the same number the larger share.
    out.sort(key=lambda x: (x[0], -round(x[2] * len(t.shingles[x[1]])), -x[2], x[4] - x[3], x[3], x[1]))
    kept: list[tuple[int, int, int, int, float]] = []
    for text, i, share, lo, hi in out:
        spot = bisect.bisect(kept, (text, lo))
        if (not spot or kept[spot - 1][:2] < (text, 0) or kept[spot - 1][2] < lo) and (spot == len(kept) or kept[spot][:2] > (text, hi)):
            kept.insert(spot, (text, lo, hi, i, share))
    return [(text, i, share, lo, hi) for text, lo, hi, i, share in kept]


def _teller(t: Templates, i: int, words: np.ndarray, begin: int, end: int) -> Callable[[int, int], bool]:
    """Whether words lo to hi, within ``begin`` to ``end``, have what tells template ``i`` from its siblings.

    An occurrence that lacks words at its ends is filled up to the template's length, as those may be written otherwise.
    """
    size = t.sizes[i]
    lo = max(0, begin - size)
    groups = [[(len(run), (lo + _runs(words[lo : end + size], run)).tolist()) for run in group] for group in t.required[i]]

    def tells(lo: int, hi: int) -> bool:
        lo, hi = min(lo, hi - size + 1), max(hi, lo + size - 1)
        return all(any((x := bisect.bisect_left(places, lo)) < len(places) and places[x] + n - 1 <= hi for n, places in group) for group in groups)

    return tells


def occurrences(at: list[int], shingle: list[int], times: list[int], most: int, k: int = SHINGLE, tells: Callable[[int, int], bool] = lambda lo, hi: True) -> list[tuple[float, int, int]]:
    """(containment, first word, last word) of each occurrence of a template that has each of its shingles ``times``.

    ``at`` and ``shingle`` are the places of held shingles of ``k`` words, ascending, and which ones they are. A run of
    them that spans at most ``most`` shingles and holds CONTAINMENT of the distinct ones may be an occurrence; its rank
    is the shingles it holds, each at most ``times``, over those it spans or the template's number, whichever is larger.
    A run over two copies spans what lies between as well, so a copy ranks above it. The highest ranks are taken first,
    then the shorter, then the earlier; occurrences have no word in common. What they leave between them is searched in
    the same way. A run whose first and last word ``tells`` refuses is none.
    """
    n, length = len(times), sum(times)
    need = next(x for x in range(n + 1) if x / n >= CONTAINMENT)
    out, parts = [], [(0, len(at))]
    while parts:
        begin, end = parts.pop()
        if end - begin < need:
            continue
        # For each place, the one before with the same shingle, and the one before by as many as the template has.
        places: dict[int, list[int]] = {}
        before = []
        for x in range(begin, end):
            seen = places.setdefault(shingle[x], [])
            before.append((seen[-1] if seen else -1, seen[-times[shingle[x]]] if len(seen) >= times[shingle[x]] else -1))
            seen.append(x)
        runs, counts, distinct, copies, j = [], [0] * n, 0, 0, begin  # j: after the shortest run from i with enough
        for i in range(begin, end):
            while j < end and distinct < need:
                distinct += not counts[shingle[j]]
                copies += counts[shingle[j]] < times[shingle[j]]
                counts[shingle[j]] += 1
                j += 1
            if distinct < need:
                break
            held, whole, last, best = distinct, copies, j - 1, None
            counts[shingle[i]] -= 1
            distinct -= not counts[shingle[i]]
            if counts[shingle[i]] >= times[shingle[i]]:
                continue  # the run from the next place is as good and shorter
            copies -= 1
            room = most  # a longer run cannot rank higher, had it all shingles
            while last < end and at[last] - at[i] < room:
                if last >= j:
                    if before[last - begin][1] >= i:
                        last += 1
                        continue
                    held += before[last - begin][0] < i
                    whole += 1
                span = at[last] - at[i] + 1
                rank = (whole / max(length, span), -span)
                if best is None or rank > best[0]:
                    best = (rank, held, last)
                    room = min(most, int(length / rank[0] + 1e-9))
                last += 1
            if best and tells(at[i], at[best[2]] + k - 1):
                runs.append((-best[0][0], -best[0][1], i, best[2], best[1]))
        taken: list[tuple[int, int]] = []
        for _, _, i, last, held in sorted(runs):
            spot = bisect.bisect(taken, (i, last))
            if (not spot or at[taken[spot - 1][1]] + k <= at[i]) and (spot == len(taken) or at[last] + k <= at[taken[spot][0]]):
                taken.insert(spot, (i, last))
                out.append((held / n, at[i], at[last] + k - 1))
        if taken:
            edges = [begin, *(x for i, last in taken for x in (bisect.bisect(at, at[i] - k, begin, end), bisect.bisect_left(at, at[last] + k, begin, end))), end]
            parts += list(zip(edges[::2], edges[1::2]))
    return sorted(out, key=lambda x: x[1])


def _counting(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def scan(t: Templates, texts: list[str | None]) -> list[list[dict]]:
    """Matches of each text, by place; offsets in its characters."""
    folded = [(x or "").encode("utf-8", "replace").translate(_FOLD) for x in texts]
    out: list[list[dict]] = [[] for _ in texts]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(folded[hi]) <= SLICE_BYTES):
            size += len(folded[hi])
            hi += 1
        split = pc.ascii_split_whitespace(pa.array([f.strip() for f in folded[lo:hi]], pa.large_binary()).cast(pa.large_string()))
        words, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        count = np.array([0 if not f.strip() else 1 for f in folded[lo:hi]])
        hashes = word_hashes([w.encode() for w in words.dictionary.to_pylist()])[words.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.uint64)
        # An empty text splits into one empty word, which is none.
        keep = np.repeat(count, np.diff(offsets)).astype(bool)
        first = np.concatenate(([0], np.cumsum(np.diff(offsets) * count)))
        spans, of = [], None
        for text, i, share, a, b in find(t, hashes[keep], first):
            if of != text:  # matches come by text
                spans, of = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", texts[lo + text])], text
            out[lo + text].append({"license": t.names[i], "containment": share, "start": spans[a][0], "end": spans[b][1]})
        lo = hi
    return out


def find_licenses(docs: DataFrame, *, text: str = "text", templates: dict[str, list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) in a struct ``row``, and ``matches``: license, containment, start and end.

    Whole texts, one row for each row, no shuffle. The templates are broadcast: they are a parameter, not data.

    Defined cases: a null or empty text has no matches; a text or template of fewer than SHINGLE words is one shingle;
    templates without words are left out; several occurrences are several matches, also next
    to each other; matches have no word in common; repeated rows each get theirs; an empty table gives an empty result; columns of any name may be kept, as they stay inside ``row``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def make():
        t = Templates(sent.value)
        return lambda texts: [pa.array(scan(t, texts.to_pylist()), _OUT)]

    return map_texts(docs, text, keep, make, f"matches {MATCHES}")
