"""License scan with a positional rare-token index.

Every notice is a template of words with mandatory key phrases. Document frequencies of the license words are counted over all
documents; the rarest word of each phrase is its entry in the index, and a notice of one phrase has its second rarest place, too. A
document looks up only those of its words that are entries, intersects the postings of each template by the start they give, and every
alignment left is verified by its key phrases.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import SLICE, annotate, flat, plain_words, raw_text

#: Phrases whose every place counts, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of the method: label, words of the notice, key phrases that must stand at their places in it.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license", ["use this file except in compliance with"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["bsd license"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     ["redistribute it and or modify it under the terms of", "general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify and or distribute this software"]),
    ("cc-by", "licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software released into the public domain"]),
    ("public-domain", "released into the public domain", ["released into the public domain"]),
    ("proprietary", "proprietary and confidential", ["proprietary and confidential"]),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, int], ...]  # spans that must match: start and end in words
    base: bool = False


def templates(notices=NOTICES, base=BASE_PHRASES) -> list[Template]:
    made = []
    for phrase, label in base.items():
        words = tuple(plain_words(phrase.encode()))
        made.append(Template(label, words, ((0, len(words)),), True))
    for label, notice, keys in notices:
        words = tuple(plain_words(notice.encode()))
        spans = []
        for key in keys:
            part = tuple(plain_words(key.encode()))
            at = next((i for i in range(len(words)) if words[i:i + len(part)] == part), None)
            if not part or at is None:
                raise ValueError(f"key phrase {key!r} isn't in the notice of {label}")
            spans.append((at, at + len(part)))
        made.append(Template(label, words, tuple(spans)))
    return made


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each license word, over all documents; at most one row per word reaches the driver."""

    def make():
        def rows(batch: pa.RecordBatch):
            found: dict[bytes, int] = {}
            for at in range(0, batch.num_rows, SLICE):
                for raw in batch.slice(at, SLICE).column(0).to_pylist():
                    for w in vocabulary.intersection(plain_words(raw)):
                        found[w] = found.get(w, 0) + 1
            yield [list(found), list(found.values())]

        return rows

    counted = flat(docs.select(raw_text()), "word binary, n bigint", make).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


@dataclass
class Index:
    """postings: entry word -> (template, its place there); entries: the places of each template's entries."""

    templates: list[Template]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    entries: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        for t, template in enumerate(self.templates):
            rarity = lambda i: (self.idf.get(template.words[i], math.inf), template.words[i], -i)
            entries = [max(range(a, b), key=rarity) for a, b in template.keys]
            others = [i for a, b in template.keys for i in range(a, b) if i not in entries]
            if len(entries) == 1 and others:
                entries.append(max(others, key=rarity))
            self.entries.append(entries)
            for place in entries:
                self.postings.setdefault(template.words[place], []).append((t, place))

    def starts(self, words: list[bytes]) -> dict[int, set[int]]:
        """For each template the starts that all its entries in the index give."""
        places: dict[bytes, list[int]] = {}
        entries = self.postings.keys() & set(words)
        if entries:
            for at, word in enumerate(words):
                if word in entries:
                    places.setdefault(word, []).append(at)
        met: dict[int, set[int]] = {}
        for t in {t for entry in entries for t, _ in self.postings[entry]}:
            each = sorted(((places.get(self.templates[t].words[i], []), i) for i in self.entries[t]), key=lambda x: len(x[0]))
            left = {at - each[0][1] for at in each[0][0]}
            for found, i in each[1:]:
                if not left:
                    break
                left.intersection_update([at - i for at in found])
            if left:
                met[t] = left
        return met

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its first word, share of its words there) of each verified alignment, also partly outside the text."""
        found = []
        n = len(words)
        for t, starts in self.starts(words).items():
            template = self.templates[t]
            for start in starts:
                if all(start + a >= 0 and tuple(words[start + a:start + b]) == template.words[a:b] for a, b in template.keys):
                    same = sum(0 <= start + i < n and words[start + i] == w for i, w in enumerate(template.words))
                    found.append((t, start, same / len(template.words)))
        return found


def scan_licenses(docs: DataFrame, notices=NOTICES, base=BASE_PHRASES, into: str = "license") -> DataFrame:
    """Add struct `into`: n_words, places (start and end in words, label, base) of every match, base_labels, labels, score.

    The score is the largest share of a notice's words found at its alignment, 1 for a base phrase, 0 without a match. Null and empty
    texts have no words and no match; repeated rows give equal results each; all other columns pass through.
    """
    known = templates(notices, base)
    vocabulary = {w for t in known for w in t.words}
    n = docs.count()
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in word_frequencies(docs, vocabulary).items()}
    index = docs.sparkSession.sparkContext.broadcast(Index(known, idf))

    def make():
        table = index.value

        def row(raw):
            words = plain_words(raw)
            found = table.scan(words)
            places, best = [], 0.0
            for t, start, share in sorted(found, key=lambda x: (x[1], x[0])):
                template = table.templates[t]
                places.append({"start": start, "end": start + len(template.words), "label": template.label, "base": template.base})
                best = max(best, share)
            return (len(words), places, sorted({p["label"] for p in places if p["base"]}), sorted({p["label"] for p in places}), best)

        return row

    fields = ("n_words bigint, places array<struct<start:bigint,end:bigint,label:string,base:boolean>>, base_labels array<string>, "
              "labels array<string>, score double")
    return annotate(docs, into, fields, [raw_text()], make)
