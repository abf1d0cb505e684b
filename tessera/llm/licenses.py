"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A text is cut into overlapping blocks of words.  A block meets a template when it holds
at least the template's threshold of its distinct words (containment).  Template words
are ordered by how many blocks of the whole corpus hold them, rarest first.  Then

* prefix filter: a block that holds none of a template's first ``n - need + 1`` words
  can't hold ``need`` of its ``n`` words, so only those words are looked up;
* length filter: a block must have ``need`` template words at all;
* positional filter: from the places of a shared word in both orders follows how many
  more can be shared; pairs that can't reach ``need`` are dropped before counting.

Survivors are counted exactly.  A template may also be a phrase, whose words must stand
next to each other: its survivors are searched for the phrase.

Labels are stricter than matches.  A short template's words must also stand in its order
and close together, since any page on licences holds them somewhere; and a template all of
whose words another one has gives no label where the larger one is met.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import map_rows

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Words of a block; the next one starts half a block on.
BLOCK = 64
#: Templates of at most so many distinct words are checked for order.
SHORT = 12


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.9
    phrase: bool = False

    @property
    def words(self) -> tuple[bytes, ...]:
        return tuple(words_of(self.text))


#: The phrases whose places are counted, and their labels.
BASE = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
)

#: Sentences of well-known licences and the labels they stand for.
TEMPLATES = (
    Template("mit", "Released under the MIT License."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", 0.95),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", 0.95),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        0.85,
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        0.85,
    ),
    Template(
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation",
        0.85,
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        0.9,
    ),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def block_size(templates: tuple[Template, ...]) -> int:
    """Words of a block: twice the longest template, so that each lies whole in some block."""
    return max(BLOCK, 2 * max((len(t.words) for t in templates), default=0))


def blocks_at(place: int, total: int, block: int = BLOCK) -> range:
    """Numbers of the blocks that hold the word at a place of a text of ``total`` words."""
    stride = block // 2
    last = max(0, -(-(total - block) // stride))
    return range(min(last, max(0, (place - block) // stride + 1)), min(last, place // stride) + 1)


class Index:
    """Templates with their words in global order, and postings of their prefixes."""

    def __init__(self, templates: tuple[Template, ...], often: dict[bytes, int]):
        self.templates = templates
        self.size = block_size(templates)
        self.stride = self.size // 2
        vocabulary = {w for t in templates for w in t.words}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in templates]
        self.need = [max(1, ceil(t.threshold * len(s) - 1e-9)) for t, s in zip(templates, self.sets, strict=True)]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, s in enumerate(self.sets):
            for i in range(len(s) - self.need[t] + 1):
                self.postings[s[i]].append((t, i))
        self.prefix = {w for w, r in self.rank.items() if r in self.postings}
        self.phrases = {t: x.words for t, x in enumerate(templates) if x.phrase}

    def blocks(self, words: list[bytes]) -> dict[int, list[bytes]]:
        """Blocks that hold a prefix word, by number."""
        found = dict.fromkeys(b for i, w in enumerate(words) if w in self.prefix for b in blocks_at(i, len(words), self.size))
        return {b: words[b * self.stride : b * self.stride + self.size] for b in found}

    def matches(self, block: list[bytes]) -> dict[int, float]:
        """Templates that the block meets, with their containment."""
        own = sorted({self.rank[w] for w in block if w in self.rank})
        shared: Counter[int] = Counter()
        dead: set[int] = set()
        for j, r in enumerate(own):
            for t, i in self.postings.get(r, ()):
                if t in dead:
                    continue
                if len(own) < self.need[t]:
                    dead.add(t)
                elif shared[t] + 1 + min(len(self.sets[t]) - i - 1, len(own) - j - 1) < self.need[t]:
                    dead.add(t)
                else:
                    shared[t] += 1
        held, out = set(own), {}
        for t in shared:
            if t not in dead:
                n = sum(r in held for r in self.sets[t])
                if n >= self.need[t]:
                    out[t] = n / len(self.sets[t])
        return out

    def scan(self, text: str | None) -> tuple[list[bytes], dict[int, set[int]], dict[int, list[tuple[int, float]]]]:
        """The words; for each phrase its places; for each other template, every block that
        meets it, by its first word, with the containment."""
        words = words_of(text)
        places: dict[int, set[int]] = defaultdict(set)
        met: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for number, block in self.blocks(words).items():
            for t, score in self.matches(block).items():
                phrase = self.phrases.get(t)
                if phrase is None:
                    met[t].append((number * self.stride, score))
                    continue
                n, at = len(phrase), -1
                while phrase[0] in block[at + 1 :]:
                    at = block.index(phrase[0], at + 1)
                    if tuple(block[at : at + n]) == phrase:
                        places[t].add(number * self.stride + at)
        return words, places, met


    def confirmed(self, words: list[bytes], met: dict[int, list[tuple[int, float]]]) -> dict[int, float]:
        """The templates that give their label, with their best containment: matches that
        are in order where that is asked for, and beside no match of a larger template."""
        kept = {}
        for t, found in met.items():
            n = len(self.templates[t].words)
            if len(self.sets[t]) <= SHORT:
                found = [(b, s) for b, s in found if in_order(words[b : b + self.size], self.templates[t].words, self.need[t], 2 * n)]
            if found:
                kept[t] = found
        out = {}
        for t, found in kept.items():
            larger = [b for u, other in kept.items() if set(self.sets[t]) < set(self.sets[u]) for b, _ in other]
            alone = [s for b, s in found if all(abs(b - c) >= self.size for c in larger)]
            if alone:
                out[t] = max(alone)
        return out


def in_order(block: list[bytes], template: tuple[bytes, ...], need: int, span: int) -> bool:
    """Whether ``need`` words of a template stand in its order within ``span`` words."""
    own = set(template)
    for i, word in enumerate(block):
        if word in own:
            row = [0] * (len(template) + 1)  # longest common subsequence
            for w in block[i : i + span]:
                if w in own:
                    last = 0
                    for j, x in enumerate(template, 1):
                        last, row[j] = row[j], last + 1 if w == x else max(row[j], row[j - 1])
            if row[-1] >= need:
                return True
    return False


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[bytes, int]:
    """How many blocks of all texts hold each template word.  Counted over the whole
    corpus; as many numbers come back as the templates have words.  Null and empty texts
    hold none; an empty table gives an empty dict."""
    vocabulary = frozenset(w for t in templates for w in t.words)
    size = block_size(templates)

    def rows():
        def apply(cols):
            total: Counter[bytes] = Counter()
            for text in cols["text"]:
                words = words_of(text)
                held = {(b, w) for i, w in enumerate(words) if w in vocabulary for b in blocks_at(i, len(words), size)}
                total.update(w for _, w in held)
            return {"word": list(total), "n": list(total.values())}

        return apply

    counted = map_rows(docs.select(docs[text_col].alias("text")), rows, "word binary, n bigint")
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_documents(
    docs: DataFrame,
    base: tuple[Template, ...] = BASE,
    templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence labels of each text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``
    and ``blocks`` (template label, first word of the block, containment: every block that
    meets a template, so one notice may be in two overlapping blocks).  ``n_base``
    counts all places of base phrases; first and last are their smallest and largest
    starts, null without any; labels are distinct, sorted and joined by commas (empty
    without any) and stricter than ``blocks`` (order of short templates, larger templates
    first); the score is the best containment behind a label, 1 for a base phrase, 0 without
    a label.  A null or empty text has no words; texts of any length are read whole.
    Repeated rows and null identifiers pass through; an empty table gives an empty table;
    other columns are not read.
    """
    every = tuple(base) + tuple(templates)
    often = word_frequencies(docs, every, text_col)

    def rows():
        index = Index(every, often)

        def apply(cols):
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
            out: dict[str, list] = {"id": cols["id"]} | {n: [] for n in names}
            for text in cols["text"]:
                words, places, met = index.scan(text)
                given = index.confirmed(words, met)
                starts = [p for ps in places.values() for p in ps]
                own = {every[t].label for t in places}
                out["n_words"].append(len(words))
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {every[t].label for t in given})))
                out["score"].append(1.0 if starts else max(given.values(), default=0.0))
                out["blocks"].append([{"label": every[t].label, "start": b, "containment": s} for t in sorted(met) for b, s in sorted(met[t])])
            return out

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, blocks array<struct<label:string,start:bigint,containment:double>>"
    )
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_rows(picked, rows, schema).withColumnRenamed("id", id_col)
