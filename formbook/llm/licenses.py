"""License scan by a positional index of rare words.

A template is a word sequence with a label, the share of its weight that a
place must match and key phrases that must stand there whole. A word weighs
its inverse document frequency, counted over all documents. Of each template
the rarest words are indexed with their positions: the fewest whose weight
exceeds what a place may miss, so every place the template can match holds
one of them where the template has it. A file looks up its occurrences of
indexed words; a posting moved to the occurrence says where the template
would begin; the places so found are compared word by word, at their
relative positions, and kept if the share is reached and every key phrase
is there. A place may reach over the ends of the text as far as its share
allows.

The base phrases are templates that must match whole (share 1); their rarest
word alone finds all places. The other templates add labels of their own.
A document's score is the greatest share of a kept place, weighted by how
many rare words stand behind it: share x W / (W + w), W being the matched
weight and w the weight of a word that no document has; 0 without a place.

At scale: two scans and no exchange of texts. The first counts in how many
documents each template word stands (an array of counts a task, summed by
Spark, as long as the templates' vocabulary). Index and weights are as large
as the templates, whatever the corpus, and go with the tasks.

Defined results: null texts are empty; a text without a place has n_base 0,
null first_word and last_word, empty labels and score 0; all places count,
also overlapping ones and all of a very long text; equal rows are each a
document; null doc_ids keep their rows; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.llm.common import chunks, record_batch, utf8
from formbook.llm.wordarrays import Words

SHARE = 0.8
EPSILON = 1e-9
SLICE_WORDS = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = SHARE
    base: bool = False

    def words(self) -> list[str]:
        return words_of(self.text)


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


# The phrases of the contract.
BASE = (Template("mit", "MIT License", share=1.0, base=True),
        Template("apache", "Apache License", share=1.0, base=True),
        Template("gpl", "General Public License", share=1.0, base=True))

# Notices of public licenses, and the words that only they have.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the Software), to deal in the Software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
             "compliance with the License", ("apache license version 2 0",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation", ("general public license",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("public license version 3",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             ("lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             ("affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", ("source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted", ("with or without fee",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license",)),
    Template("epl", "made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("unencumbered software", "public domain")),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
)
TEMPLATES = BASE + NOTICES


class Vocabulary:
    """The templates' words, numbered."""

    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for w in t.words()})
        self.number = {w: i for i, w in enumerate(self.words)}

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The words of a batch as numbers, -1 being any other, and where
        each text begins, and the end."""
        data, offsets = utf8(batch.column("text"))
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        words = Words(data, offsets, ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128))
        codes, dictionary = words.coded()
        known = pc.index_in(dictionary, pa.array([w.encode() for w in self.words], pa.large_binary()))
        return np.asarray(pc.fill_null(known, -1)).astype(np.int64)[codes], words.first


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each word."""
    size = len(vocabulary.words)
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)  # the last one counts documents
        for batch in chunks(batches):
            ids, first = vocabulary.read(batch)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            seen = np.unique(doc[ids >= 0] * size + ids[ids >= 0]) % size
            total[:size] += np.bincount(seen, minlength=size)
            total[size] += batch.num_rows
        yield record_batch(schema, [np.arange(size + 1), total])

    counts = dict(docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    return counts.get(size, 0), np.array([counts.get(i, 0) for i in range(size)], np.int64)


class Index:
    """Templates by word numbers, their weights, and the postings
    (template, position) of each template's rarest words."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: Vocabulary, documents: int, counts: np.ndarray):
        self.templates, self.vocabulary = templates, vocabulary
        self.unseen = math.log1p(documents + 1)
        self.weight = np.log1p((documents + 1) / (counts + 1))
        number = vocabulary.number
        self.words = [np.array([number[w] for w in t.words()], np.int64) for t in templates]
        self.total = [float(self.weight[w].sum()) for w in self.words]
        self.keys = [[(at, len(k)) for k in map(words_of, t.keys) for at in places(t.words(), k)] for t in templates]
        postings = []
        for t, words in enumerate(self.words):
            spare, got = (1 - templates[t].share) * self.total[t] + EPSILON, 0.0
            for word in sorted(set(words.tolist()), key=lambda w: (-self.weight[w], w)):
                if got > spare:
                    break
                own = np.flatnonzero(words == word)
                got += self.weight[word] * len(own)
                postings += [(word, t, int(at)) for at in own]
        self.postings = np.array(sorted(postings), np.int64).reshape(-1, 3)

    def look_up(self, ids: np.ndarray, first: np.ndarray, slice_words: int = SLICE_WORDS) -> list[tuple[int, int, int, float]]:
        """(text, template, start, share) of all places in the texts; about
        ``slice_words`` words are compared at a time."""
        out = []
        low = np.searchsorted(self.postings[:, 0], ids, "left")
        rare = np.flatnonzero((ids >= 0) & (low < np.searchsorted(self.postings[:, 0], ids, "right")))
        for t, words in enumerate(self.words):
            hits = [(rare[ids[rare] == word], at) for word, of, at in self.postings.tolist() if of == t]
            at = np.concatenate([h for h, _ in hits])
            begin = np.concatenate([h - a for h, a in hits])
            if not len(at):
                continue
            text = np.searchsorted(first, at, side="right") - 1
            pairs = np.unique(np.stack([text, begin]), axis=1)
            for i in range(0, pairs.shape[1], slice_words // len(words) + 1):
                text, begin = pairs[:, i:i + slice_words // len(words) + 1]
                at = begin[:, None] + np.arange(len(words))
                inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
                same = inside & (ids[np.clip(at, 0, len(ids) - 1)] == words)
                share = same @ self.weight[words] / self.total[t]
                good = share >= self.templates[t].share - EPSILON
                for a, n in self.keys[t]:
                    good &= same[:, a:a + n].all(1)
                out += [(int(d), t, int(b - first[d]), min(1.0, float(s)))
                        for d, b, s in zip(text[good], begin[good], share[good])]
        return sorted(out)

    def score(self, template: int, share: float) -> float:
        matched = share * self.total[template]
        return share * matched / (matched + self.unseen)


def places(words: list[str], phrase: list[str]) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i:i + len(phrase)] == phrase]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, score); a place has the template's label,
    number and kind, its first word, length and matched share."""
    vocabulary = Vocabulary(templates)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(templates, vocabulary, *document_counts(texts, vocabulary))
    place = pa.struct([("label", pa.string()), ("template", pa.int32()), ("base", pa.bool_()), ("start", pa.int64()),
                       ("length", pa.int64()), ("share", pa.float64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, first = vocabulary.read(batch)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            score = np.zeros(batch.num_rows)
            for d, t, start, share in index.look_up(ids, first):
                own = templates[t]
                found[d].append({"label": own.label, "template": t, "base": own.base, "start": start,
                                 "length": len(index.words[t]), "share": share})
                score[d] = max(score[d], index.score(t, share))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(found, pa.list_(place)),
                 pa.array(score, pa.float64())], ["doc_id", "n_words", "places", "score"])

    return texts.mapInArrow(make, "doc_id long, n_words long, places array<struct<label:string,template:int,base:boolean,"
                                  "start:long,length:long,share:double>>, score double")


def digest(docs: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")

    return scan(docs).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                             F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                             labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")
