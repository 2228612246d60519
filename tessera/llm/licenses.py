"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a token set; a text block is a window of 2 * step words, one beginning every step words,
so any step words in a row lie within a block. The step is SHORTEST words, doubled for longer templates
until they fit, so that each length of template has blocks of its own and none is too long. Tokens are ordered by corpus frequency, rarest
first, counted over all texts. A block that holds share s of template T holds a = ceil(s * |T|) of its
tokens, and so one of the first |T| - a + 1 in that order (prefix filter, an inverted index of the
templates' prefixes); blocks with fewer than a template tokens (length filter) and pairs whose tokens
after the first common one can't reach a (positional filter) are dropped before the sets are compared.
Tokens of no template never count towards an overlap, so a block's set leaves them out.

Base phrases are templates of share 1, and the matched blocks are then searched for the phrase's words in
a row. Templates and their index are a parameter's size and travel with the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: License sentences and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}

#: The least step between blocks.
SHORTEST = 24
SHARE = 0.85

#: A-Z lower-cased; every other ASCII byte that isn't a digit or letter ends a word.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    phrase: bool


class Index:
    """Templates of `step` words at most in token order, and their prefixes' inverted lists."""

    def __init__(self, templates: list[Template], counts: Mapping[bytes, int], share: float, step: int = SHORTEST):
        for t in templates:
            if not 0 < len(t.words) <= step:
                raise ValueError(f"a template has 1 to {step} words here: {t}")
        self.templates, self.step = templates, step
        tokens = {w for t in templates for w in t.words}
        self.rank = {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in templates]
        self.need = [len(s) if t.phrase else math.ceil(share * len(s) - 1e-9) for s, t in zip(self.sets, templates, strict=True)]
        self.lists: dict[bytes, list[tuple[int, int]]] = {}
        names = {k: w for w, k in self.rank.items()}
        for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for place, token in enumerate(s[: len(s) - need + 1]):
                self.lists.setdefault(names[token], []).append((t, place))

    def join(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(block, template, overlap) of every block and template that meet the share; a block begins at block * step."""
        lists, blocks, step = self.lists, {}, self.step
        last = max(0, -(-(len(words) - step) // step))
        for at in [k for k, w in enumerate(words) if w in lists]:
            home = at // step
            for block in {min(home, last), min(max(home - 1, 0), last)}:
                if block * step <= at < (block + 2) * step:
                    blocks.setdefault(block, set()).update(lists[words[at]])
        for block, hits in blocks.items():
            part = words[block * step : (block + 2) * step]
            have = sorted({self.rank[w] for w in part if w in self.rank})
            place_of = {token: k for k, token in enumerate(have)}
            done = set()
            for t, place in sorted(hits):
                s, need = self.sets[t], self.need[t]
                if t in done or len(have) < need:
                    continue
                if 1 + min(len(s) - place - 1, len(have) - place_of[s[place]] - 1) < need - sum(x in place_of for x in s[:place]):
                    continue
                done.add(t)
                both = sum(x in place_of for x in s)
                if both >= need:
                    yield block, t, both


def indexes(templates: list[Template], counts: Mapping[bytes, int], share: float) -> list[Index]:
    """An index per step that the templates' lengths need."""
    steps: dict[int, list[Template]] = {}
    for t in templates:
        step = SHORTEST
        while step < len(t.words):
            step *= 2
        steps.setdefault(step, []).append(t)
    return [Index(group, counts, share, step) for step, group in sorted(steps.items())]


def scan(found_by: list[Index], text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    words = words_of(text)
    places, base, labels, score = set(), set(), set(), 0.0
    for index, block, t, both in ((index, *hit) for index in found_by for hit in index.join(words)):
        template = index.templates[t]
        if not template.phrase:
            labels.add(template.label)
            score = max(score, both / len(index.sets[t]))
            continue
        n, first = len(template.words), template.words[0]
        for at in range(block * index.step, min((block + 2) * index.step, len(words)) - n + 1):
            if words[at] == first and tuple(words[at : at + n]) == template.words:
                places.add((at, index.step, t))
                base.add(template.label)
                score = 1.0
    starts = [p for p, *_ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def parse(phrases: Mapping[str, str], templates: Mapping[str, str]) -> list[Template]:
    return [Template(tuple(words_of(k)), v, phrase) for group, phrase in ((phrases, True), (templates, False)) for k, v in group.items()]


def template_counts(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[bytes, int]:
    """How often each template token occurs in all texts; the driver gets a row per token of the templates at most."""
    tokens = frozenset(w for t in templates for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(filter(tokens.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in rows.toLocalIterator()}


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    share: float = SHARE,
) -> DataFrame:
    """A row per row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template in a block that meets the threshold, 1 where a phrase
    stands, else 0. Null and empty texts have no words, empty labels and score 0. Null and repeated ids
    pass through, one row each. Only the id and text are read. An empty table gives no rows.
    """
    parsed = parse(phrases, templates)
    found_by = indexes(parsed, template_counts(docs, parsed, text_col), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in _OUT.split(", ")]
        for batch in batches:
            rows = [scan(found_by, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], ["id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, {_OUT}").withColumnRenamed("id", id_col)


def _base_sql() -> str:
    here = " ".join(f"when {' and '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))} then '{label}'" for p, label in PHRASES.items())
    return f"""with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
h as (select doc_id, w, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'at': i - 1, 'label': case {here} end}}), lambda x: x.label is not null) as h from t)
select doc_id, len(w)::bigint as n_words, len(h)::bigint as n_base, h[1].at::bigint as first_word, h[-1].at::bigint as last_word,
  array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x.label))), ',') as base_labels from h"""


#: DuckDB SQL for the base columns; labels and score are the method's own.
BASE_SQL = _base_sql()
