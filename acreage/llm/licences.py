"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions.

The automaton runs over a text's words joined by single blanks, so a phrase is found wherever its words stand consecutively,
whatever lies between them. Where it meets the words of an identifier tag, the tag's expression is read from the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm import text as X

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a text under a label may be used; an unknown label has 0.5.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0-1.0": 1.0, "unlicense": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "cc-by-4.0": 0.9, "mpl": 0.6, "mpl-2.0": 0.6, "epl": 0.6, "epl-2.0": 0.6, "lgpl": 0.6, "lgpl-2.1-only": 0.6, "lgpl-3.0-only": 0.6,
    "gpl": 0.3, "gpl-2.0-only": 0.3, "gpl-2.0-or-later": 0.3, "gpl-3.0-only": 0.3, "gpl-3.0-or-later": 0.3, "agpl": 0.2, "agpl-3.0-only": 0.2, "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.5

_SEPARATORS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TAG_TEXT = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Postfix order of a licence expression by the shunting-yard method: ``with`` binds closest, then ``and``, then ``or``.

    Reading ends at the first token that cannot follow, so prose after a tag is left out; an open bracket is closed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if operand:
            if word == "(":
                stack.append("(")
            elif word == ")" or word in _RANK:
                break
            else:
                out.append(word)
                operand = False
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif word == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand:  # an operator or brackets without what follows them
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float | None]:
    """(labels, freedom) of a postfix expression: ``or`` lets one choose, ``and`` binds to both, ``with`` adds an exception."""
    values: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _RANK:
            values.append(({token}, FREEDOM.get(token, UNKNOWN_FREEDOM)))
            continue
        if len(values) < 2:
            continue
        (b, y), (a, x) = values.pop(), values.pop()
        if token == "with":
            values.append((a, min(1.0, x + 0.1)))
        else:
            values.append((a | b, max(x, y) if token == "or" else min(x, y)))
    return values[-1] if values else (set(), None)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = (text or "").encode().translate(_SEPARATORS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base: set[str] = set()
    more: set[str] = set()
    places: list[int] = []
    tagged = False
    for end, phrase in machine.iter(line):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            base.add(BASE[phrase])
            places.append(end - len(phrase) - 1)
        else:
            more.add(NOTICES[phrase])
    free = [FREEDOM.get(label, UNKNOWN_FREEDOM) for label in base | more]
    if tagged:
        for expression in _TAG_TEXT.findall(text or ""):
            labels, value = evaluate(to_postfix(expression))
            more |= labels
            free += [] if value is None else [value]
    first = line.count(" ", 0, min(places)) if places else None
    last = line.count(" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), min(free) if free else 0.0


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per row of ``docs``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. base_* hold the base phrases only; labels adds
    notices and the identifiers of tags. score is how freely the text may be used as all findings together say (0 without any).
    Cases: null and empty texts have no words, places null, labels empty and score 0. Overlapping places all count. Repeated
    rows stay; other columns are ignored; an empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in X.pieces(batches, 1):
            rows = [scan(t, machine) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_NAMES])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
