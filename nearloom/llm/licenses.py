"""Licence scans by a positional index of rare words.

Templates are licence notices with mandatory key phrases.  Of the words of a
template's key phrases, those that the fewest documents of the corpus hold are
its index: postings of a template and the word's position in it.  A file's
words that the index holds are looked up, rarest first; postings of one
template that agree on where in the file it would begin are candidates, and
of these the key phrases are verified.

A notice is in a file where its first key phrase stands and every other one
stands at its distance from the first, give or take ``DRIFT`` words.  As all
key phrases are mandatory, so are their rarest words: the index loses no notice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.runtime import ship, slices

#: Words by which a key phrase may be nearer to or farther from the first one than in the template.
DRIFT = 4
#: Index words of a template.
RARE = 2
#: The score of a label that is only mentioned; a notice scores more, up to 1.
MENTION = 0.5

#: Letters and digits, and all that is not ASCII, of UTF-8 text in small letters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Template(NamedTuple):
    """A notice as words; each of ``keys`` stands in it, and the first ends no later than another begins."""

    label: str
    text: str
    keys: tuple[str, ...]


# Phrases and labels of the base, and public licence notices with the phrases that they cannot lack: fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    Template("apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("is free software", "gnu general public license", "free software foundation"),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template("bsd", "spdx license identifier bsd 3 clause", ("spdx license identifier bsd",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee", "appear in all copies"),
    ),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ("without any express or implied warranty", "authors be held liable for any damages"),
    ),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
)


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words of a text, A-Z in small letters, as UTF-8."""
    if text is None:
        return []
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


class _Notice(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]  # where a key phrase begins, and its words


def _place(words: Sequence[bytes], phrase: Sequence[bytes]) -> int:
    for at in range(len(words) - len(phrase) + 1):
        if words[at : at + len(phrase)] == phrase:
            return at
    raise ValueError(f"a key phrase does not stand in its template: {b' '.join(phrase).decode()}")


def _notice(template: Template) -> _Notice:
    words = words_of(template.text)
    if not template.keys:
        raise ValueError("a template needs a key phrase")
    return _Notice(template.label, words, [(_place(words, key), key) for key in map(words_of, template.keys)])


class Index:
    """The postings of the templates' rarest mandatory words, and of each base phrase's rarest word."""

    def __init__(self, frequency: dict[bytes, int], templates: Iterable[Template] = TEMPLATES, base: Iterable[tuple[str, str]] = BASE):
        self.notices = [_notice(t) for t in templates]
        self.postings: list[list[tuple[bytes, int]]] = []  # per notice, rarest first
        rarity = lambda posting: (frequency.get(posting[0], 0), posting)
        for n in self.notices:
            rare: dict[bytes, int] = {}
            for word, at in sorted(((w, at + i) for at, key in n.keys for i, w in enumerate(key)), key=rarity):
                if len(rare) < RARE:
                    rare.setdefault(word, at)
            self.postings.append(list(rare.items()))
        self.base = []
        for phrase, label in base:
            words = words_of(phrase)
            self.base.append((label, words, min(range(len(words)), key=lambda i: rarity((words[i], i)))))
        #: The notices whose rarest word this is, and all words that a file is searched for.
        self.rarest: defaultdict[bytes, list[int]] = defaultdict(list)
        for t, postings in enumerate(self.postings):
            self.rarest[postings[0][0]].append(t)
        self.vocabulary = {w for postings in self.postings for w, _ in postings} | {words[at] for _, words, at in self.base}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """``(label, start)`` of base phrases, and ``(label, first word, last word, score)`` of notices, in order."""
        if self.vocabulary.isdisjoint(words):
            return [], []
        places: defaultdict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places[w].append(i)
        mentions = [(label, i - at) for label, phrase, at in self.base for i in places.get(phrase[at], ()) if i >= at and words[i - at : i - at + len(phrase)] == phrase]
        found = [hit for w in self.rarest.keys() & places.keys() for t in self.rarest[w] for hit in self._found(t, words, places)]
        return sorted(mentions, key=lambda m: m[::-1]), sorted(found, key=lambda f: (f[1], f[2], f[0], f[3]))

    def _found(self, t: int, words: list[bytes], places: dict[bytes, list[int]]) -> Iterator[tuple[str, int, int, float]]:
        notice = self.notices[t]
        first, *others = ([i - at for i in places.get(w, ())] for w, at in self.postings[t])
        at0, phrase0 = notice.keys[0]
        begins = set()
        for o in first:
            # Where two words of one notice say that it begins differs by their phrases' drifts.
            if all((k := bisect_left(other, o - 2 * DRIFT)) < len(other) and other[k] <= o + 2 * DRIFT for other in others):
                begins |= set(_stands(words, phrase0, o + at0)) - begins
        for start in sorted(begins):
            o, ends = start - at0, [start + len(phrase0)]
            for at, key in notice.keys[1:]:
                near = _stands(words, key, o + at)
                if not near:
                    break
                ends.append(near[-1] + len(key))
            else:
                hits = sum(w in words[max(0, o + j - DRIFT) : max(0, o + j + DRIFT + 1)] for j, w in enumerate(notice.words))
                yield notice.label, start, max(ends) - 1, MENTION + (1 - MENTION) * (hits / len(notice.words))


def _stands(words: list[bytes], phrase: list[bytes], at: int) -> list[int]:
    """Where ``phrase`` stands within DRIFT words of ``at``."""
    n = len(phrase)
    return [i for i in range(max(0, at - DRIFT), min(len(words) - n, at + DRIFT) + 1) if words[i] == phrase[0] and words[i : i + n] == phrase]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def frequencies(docs: DataFrame, words: Iterable[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents of the corpus hold each of some ``words``; each task counts by itself, the driver sees a row per word."""
    ship(docs.sparkSession)
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in slices(batches):
            for text in _texts(b):
                counts.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


SCANNED = {"n_words": "long", "mentions": "array<struct<label: string, word: long>>", "notices": "array<struct<label: string, first_word: long, last_word: long, score: double>>"}
_MENTIONS = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_NOTICES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE, text_col: str = "text") -> DataFrame:
    """``docs`` with the licences of each whole text: ``n_words``, ``mentions`` (base phrases) and ``notices`` (verified templates).

    Places are numbers of words from 0, in order; a notice reaches from its
    first key phrase to the end of its last.  Null texts are empty: no words,
    empty arrays.  All rows are kept, repeated ones too; of the other columns,
    those named like a new one are replaced.  An empty table gives no rows.
    The corpus is read twice, once to count the templates' words; nothing is
    shuffled but those counts.
    """
    mandatory = {w for t in templates for _, key in _notice(t).keys for w in key} | {w for phrase, _ in base for w in words_of(phrase)}
    index = Index(frequencies(docs, mandatory, text_col), templates, base)
    kept = [c for c in docs.columns if c not in SCANNED]
    schema = docs.select(*kept, *(F.lit(None).cast(kind).alias(name) for name, kind in SCANNED.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, mentions, notices = [], [], []
            for text in _texts(b):
                words = words_of(text)
                said, found = index.scan(words)
                counts.append(len(words))
                mentions.append([{"label": label, "word": i} for label, i in said])
                notices.append([{"label": label, "first_word": i, "last_word": j, "score": score} for label, i, j, score in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(mentions, _MENTIONS), pa.array(notices, _NOTICES)], [*kept, *SCANNED])

    return docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document of :func:`scan`: counts, places and labels, and the best ``score`` (0: no licence; MENTION: only named)."""
    places = F.transform("mentions", lambda m: m["word"])
    named, noticed = F.transform("mentions", lambda m: m["label"]), F.transform("notices", lambda n: n["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("notices", lambda n: n["score"]))
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        "n_words",
        F.size("mentions").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(named).alias("base_labels"),
        joined(F.concat(named, noticed)).alias("labels"),
        F.coalesce(F.greatest(best, F.when(F.size("mentions") > 0, MENTION)), F.lit(0.0)).alias("score"),
    )


def oracle(templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> str:
    """DuckDB SQL for :func:`digest` over ``documents``: every place of every key phrase, without an index."""
    said = [(label, phrase, len(words_of(phrase)), i, w.decode()) for phrase, label in base for i, w in enumerate(words_of(phrase))]
    keys, whole = [], []
    for t, n in enumerate(map(_notice, templates)):
        keys += [(t, n.label, k, at, len(key), i, w.decode()) for k, (at, key) in enumerate(n.keys) for i, w in enumerate(key)]
        whole += [(t, len(n.words), j, w.decode()) for j, w in enumerate(n.words)]
    values = lambda rows: ", ".join(map(str, rows))
    return rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM split
), base(label, phrase, size, off, word) AS (
  VALUES {values(said)}
), said AS (
  SELECT doc_id, label, i - off AS pos FROM w JOIN base USING (word) GROUP BY doc_id, label, phrase, size, i - off HAVING count(*) = size
), keys(t, label, k, pos, size, off, word) AS (
  VALUES {values(keys)}
), stands AS (
  SELECT doc_id, t, label, k, i - off AS start, keys.pos AS pos FROM w JOIN keys USING (word) GROUP BY doc_id, t, label, k, keys.pos, size, i - off HAVING count(*) = size
), begun AS (
  SELECT doc_id, t, label, start - pos AS o FROM stands WHERE k = 0
), held AS (
  SELECT b.doc_id, b.t, b.label, b.o FROM begun b JOIN stands s ON s.doc_id = b.doc_id AND s.t = b.t AND abs(s.start - s.pos - b.o) <= {DRIFT}
  JOIN (SELECT t, count(DISTINCT k) AS n FROM keys GROUP BY t) z ON z.t = b.t GROUP BY b.doc_id, b.t, b.label, b.o, z.n HAVING count(DISTINCT s.k) = z.n
), whole(t, size, j, word) AS (
  VALUES {values(whole)}
), notices AS (
  SELECT h.doc_id, h.label, h.o, h.t, {MENTION} + (1 - {MENTION}) * (count(DISTINCT x.j)::DOUBLE / x.size) AS score
  FROM held h JOIN whole x ON x.t = h.t JOIN w ON w.doc_id = h.doc_id AND w.word = x.word AND abs(w.i - x.j - h.o) <= {DRIFT}
  GROUP BY h.doc_id, h.label, h.o, h.t, x.size
), labels AS (
  SELECT doc_id, label FROM said UNION SELECT doc_id, label FROM notices
), mentions AS (
  SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM said GROUP BY doc_id
)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_base, m.first_word::BIGINT AS first_word, m.last_word::BIGINT AS last_word,
  coalesce(m.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, greatest(coalesce(n.score, 0), CASE WHEN m.n > 0 THEN {MENTION} ELSE 0 END)::DOUBLE AS score
FROM split s LEFT JOIN mentions m USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM labels GROUP BY doc_id) l USING (doc_id)
LEFT JOIN (SELECT doc_id, max(score) AS score FROM notices GROUP BY doc_id) n USING (doc_id)
"""
