"""Licence scan by a positional index of rare words.

The index maps the rarest words of every licence template, by their document frequency in the scanned corpus, to (template,
position). Where a file has such a word, the template is laid over the file so that the two positions meet; places that agree are
one alignment. An alignment counts when its words agree by weight and every mandatory key phrase of the template stands where the
template has it. Apart from that, base phrases are looked up word by word at every place of the text.

The index holds the templates' words only, a setting's size. Texts are read twice, once for document frequencies and once for the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspan.llm.common import bounded

#: Phrases whose every place counts, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Bytes that separate words: ASCII other than digits and letters.
_SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


@dataclass(frozen=True)
class Template:
    """A licence's telling sentence in words, and the phrases of it without which it is not that licence."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Sentences of public licences.
TEMPLATES = (
    Template("agpl-3", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("lgpl-3", "under the terms of the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "obtaining a copy of this software")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:bigint,words:bigint,score:double>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)
#: Stands between texts so that no phrase reaches from one into the next.
_GAP = -2


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_TABLE).split() if text else []


def _vocabulary(templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]) -> dict[bytes, int]:
    texts = [t.text for t in templates] + [k for t in templates for k in t.keys] + [p for p, _ in base]
    return {w: i for i, w in enumerate(sorted({w for x in texts for w in words(x)}))}


def _ids(found: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Documents that hold each word of the vocabulary, over all documents; the last entry is the number of documents."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                ids = _ids(words(text.as_py()), vocabulary)
                total[np.unique(ids[ids >= 0])] += 1
                total[size] += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["word", "n"])

    out = np.zeros(size + 1, np.int64)
    for row in docs.select("text").mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row["word"]] = row["n"]
    return out


@dataclass(frozen=True)
class _Laid:
    """A template as word numbers: weights of its words, index entries (word, position), and the positions of its key phrases."""

    label: str
    ids: np.ndarray
    weights: np.ndarray
    anchors: tuple[tuple[int, int], ...]
    keys: np.ndarray


def _lay(template: Template, vocabulary: dict[bytes, int], idf: np.ndarray, anchors: int) -> _Laid:
    ids = _ids(words(template.text), vocabulary)
    rare = sorted(set(ids.tolist()), key=lambda w: (-idf[w], w))[:anchors]
    keys: set[int] = set()
    for phrase in template.keys:
        found = _ids(words(phrase), vocabulary)
        places = [i for i in range(len(ids) - len(found) + 1) if (ids[i:i + len(found)] == found).all()]
        if not places:
            raise ValueError(f"key phrase {phrase!r} is not in its template")
        keys.update(range(places[0], places[0] + len(found)))
    entries = tuple((int(w), i) for i, w in enumerate(ids) if w in rare)
    return _Laid(template.label, ids, idf[ids], entries, np.array(sorted(keys)))


def _places(flat: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively."""
    at = np.nonzero(flat[:len(flat) - len(phrase) + 1] == phrase[0])[0]
    for i, word in enumerate(phrase[1:], 1):
        at = at[flat[at + i] == word]
    return at


def _aligned(flat: np.ndarray, laid: _Laid, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts at which the template agrees, and how far; `flat` has gaps of the longest template's length at both ends."""
    starts = np.unique(np.concatenate([np.nonzero(flat == w)[0] - i for w, i in laid.anchors]))
    starts = starts[(starts >= 0) & (starts + len(laid.ids) <= len(flat))]
    if len(laid.keys):
        for i in laid.keys.tolist():
            starts = starts[flat[starts + i] == laid.ids[i]]
    agree = (flat[starts[:, None] + np.arange(len(laid.ids))] == laid.ids) @ laid.weights / laid.weights.sum()
    return starts[agree >= share], agree[agree >= share]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, anchors: int = 3, share: float = 0.6) -> DataFrame:
    """Licences of every document, one row per row of `docs` (doc_id, text), as SCHEMA names them.

    Words are runs of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased. `n_base`, `first_word` and `last_word` count
    base phrases at all places; `labels` adds those of aligned templates to the base labels, and `spans` says where. `score` is 1 with a
    base phrase, else the best alignment's share of weight, else 0. A template's `anchors` highest-IDF words are its index entries;
    ties go by the words' order. Null and empty texts have no words, no places and empty label lists. Repeated rows and null ids
    are scanned like any others; other columns are ignored; an empty table gives an empty table.
    """
    vocabulary = _vocabulary(templates, base)
    counted = document_frequencies(docs, vocabulary)
    idf = np.log((counted[-1] + 1) / (counted[:-1] + 1)) + 1e-3
    laid = [_lay(t, vocabulary, idf, anchors) for t in templates]
    phrases = [(_ids(words(p), vocabulary), label) for p, label in base]
    gap = np.full(max([len(x.ids) for x in laid] + [len(p) for p, _ in phrases]), _GAP, np.int32)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = [_ids(words(t), vocabulary) for t in batch.column("text").to_pylist()]
        flat = np.concatenate([gap, *(y for x in ids for y in (x, gap))])
        lengths = np.array([len(x) for x in ids], np.int64)
        first = len(gap) + np.concatenate(([0], np.cumsum(lengths + len(gap))[:-1]))
        based = [[] for _ in ids]
        spans: list[list[tuple]] = [[] for _ in ids]
        for phrase, label in phrases:
            at = _places(flat, phrase)
            for doc, p in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                based[doc].append((p - int(first[doc]), label))
        for x in laid:
            at, agree = _aligned(flat, x, share)
            owner = np.clip(np.searchsorted(first, at + int(x.keys[0]) if len(x.keys) else at, "right") - 1, 0, None)
            for doc, p, score in zip(owner.tolist(), at.tolist(), agree.tolist(), strict=True):
                spans[doc].append((x.label, p - int(first[doc]), len(x.ids), min(1.0, score)))
        for doc, key in enumerate(batch.column("doc_id").to_pylist()):
            places = [p for p, _ in based[doc]]
            labels = sorted({label for _, label in based[doc]})
            every = sorted({*labels, *(s[0] for s in spans[doc])})
            score = 1.0 if places else max((s[3] for s in spans[doc]), default=0.0)
            yield (key, int(lengths[doc]), len(places), min(places, default=None), max(places, default=None), ",".join(labels), ",".join(every), score,
                   [dict(zip(("label", "start", "words", "score"), s, strict=True)) for s in sorted(spans[doc], key=lambda s: (s[1], s[0]))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            columns = list(zip(*rows(batch), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(of, SCHEMA)
