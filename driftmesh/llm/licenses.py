"""License scans by an exact set-similarity join against notice templates.

The words of a text that stand in a template end blocks: for each such place and
template the block is the SPREAD x (template's words) words that end there, over
however many lines a notice may be wrapped and whatever stands between its words.
A block matches a template if it holds at least ``threshold`` of the template's
distinct words. The join orders tokens by their number of places in all texts
(rarest first, ties by the token), probes an index of the templates' prefixes
with a text's tokens, and drops candidates by the length and positional filters;
then only blocks around a prefix token are counted. A block over the threshold
can't be lost, since of its overlap at least one token is in the prefix.

``matches`` names every label with a block over the threshold, and the most
containment. Templates of nearly the same words (GPL, AGPL, LGPL) are told apart
in ``labels``: a block's label gives way where a block of another label that
overlaps it holds a larger share of its template, or as much of a longer one;
equal ones stand together.

The frequencies are counted over all texts; only the templates' own tokens are
counted, so what the driver gets is bounded by the templates.

Null and empty texts have no words and no labels; a null id stays null. Repeated
rows are each scanned by themselves; an empty table gives an empty table. Only
the named columns are read, so no other can clash. A text of n words takes time
in proportion to n, and to the templates' words around the rare ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, load, map_rows

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public notices and their labels.
TEMPLATES = (
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Words of a block for each word of the template.
SPREAD = 2


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Index:
    """Templates as token ranks, and an index of their prefixes."""

    def __init__(self, templates: tuple, frequency: dict[str, int], threshold: float):
        sets = [(label, set(words_of(text))) for label, text in templates]
        order = sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.items, self.prefixes = [], defaultdict(list)
        for (label, own), (_, text) in zip(sets, templates, strict=True):
            ranks = sorted(self.rank[w] for w in own)
            need = math.ceil(threshold * len(ranks) - 1e-9)
            for at in range(len(ranks) - need + 1):
                self.prefixes[ranks[at]].append((len(self.items), at))
            self.items.append((label, frozenset(ranks), need, SPREAD * len(words_of(text)), frozenset(ranks[: len(ranks) - need + 1])))

    def candidates(self, block: list[int]) -> list[int]:
        """Templates of which the sorted distinct ranks may hold enough: by prefix, length and position."""
        found = set()
        for i, r in enumerate(block):
            for t, at in self.prefixes.get(r, ()):
                _, ranks, need, _, _ = self.items[t]
                # length: enough tokens at all; position: enough behind this one in both
                if len(block) >= need and 1 + min(len(block) - i - 1, len(ranks) - at - 1) >= need:
                    found.add(t)
        return sorted(found)

    def blocks(self, words: list[str]) -> list[tuple[str, int, int, float, int]]:
        """(label, first, last, share, size) of each block that a template of size distinct words is contained in: its template words' first and last place."""
        places = [(i, r) for i, w in enumerate(words) if (r := self.rank.get(w)) is not None]
        out = []
        for t in self.candidates(sorted({r for _, r in places})):
            label, ranks, need, span, prefix = self.items[t]
            own = [x for x in places if x[1] in ranks]
            held: Counter = Counter()
            first, rare = 0, -1
            for at, r in own:
                held[r] += 1
                rare = at if r in prefix else rare
                while own[first][0] <= at - span:
                    gone = own[first][1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    first += 1
                if rare > at - span and rare >= 0 and len(held) >= need:
                    out.append((label, own[first][0], at, len(held) / len(ranks), len(ranks)))
        return out


def winners(blocks: list[tuple[str, int, int, float, int]]) -> set[str]:
    """Labels with a block that no overlapping block of another label outdoes."""
    ranked = sorted(blocks, key=lambda b: (-b[3], -b[4]))
    out = set()
    for label, lo, hi, *weight in ranked:
        if label in out:
            continue
        for other, a, b, *more in ranked:
            if more <= weight:
                out.add(label)
                break
            if other != label and a <= hi and lo <= b:
                break
    return out


def phrases(words: list[str], base: list[tuple[list[str], str]]) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand one after another."""
    out = []
    for phrase, label in base:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def frequencies(docs: DataFrame, templates: tuple, text_col: str = "text") -> dict[str, int]:
    """Places of each template token in all texts."""
    own = sorted({w for _, text in templates for w in words_of(text)})

    def run(batches):
        seen: Counter = Counter()
        known = frozenset(own)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for text in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist():
                    seen.update(w for w in words_of(text) if w in known)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    counted = docs.select(text_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in counted.collect()}


def scan(docs: DataFrame, templates: tuple = TEMPLATES, base: dict = BASE, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    frequency = frequencies(docs, templates, text_col)
    split = [(p.split(), label) for p, label in base.items()]

    def row(index: Index, key: int, text: str | None) -> tuple:
        words = words_of(text)
        places = phrases(words, split)
        starts = [at for at, _ in places]
        own = {label for _, label in places}
        blocks = index.blocks(words) if not index.rank.keys().isdisjoint(words) else []
        most: dict[str, float] = {}
        for label, _, _, share, _ in blocks:
            most[label] = max(share, most.get(label, 0.0))
        score = max([float(bool(own)), *most.values()])
        matched = ",".join(f"{x}:{most[x]:.3f}" for x in sorted(most))
        return key, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | winners(blocks))), score, matched

    schema = f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"
    return map_rows(docs, [id_col, text_col], row, schema, lambda: Index(templates, frequency, threshold))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
