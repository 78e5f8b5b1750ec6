"""License scan by ordered signature rules.

A text is read as a stream of words (A-Z in lower case; runs of letters, digits
and everything beyond ASCII).  Hundreds of regular expressions
(``license_rules``) are tried on the stream, each only if the text holds one of
its keywords.  Of overlapping detections one is suppressed if it lies inside
another of higher priority, or inside a longer one of the same priority (equal
ones: the earlier rule stays).

Three base phrases are looked for at every place, whatever the rules find.

``score``: the chance that at least one detection is right, from the sureness of
each label (its best surviving detection; a base phrase counts ``BASE_SURE``).

Defined cases: a null text is empty (no words, empty labels, score 0); ids may
be null or repeated, each row is scanned by itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import LOWER, UPPER
from frostline.llm.license_rules import RULES, SURE

# base phrases and labels (fixed values)
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SURE = 0.5
ROWS = 256          # results handed on at a time

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_BASE = [(label, frozenset(p.split()), re.compile(f"(?<= ){p}(?= )")) for p, label in BASE.items()]
_BY_KEYWORD: dict[str, list[int]] = {}
for _i, _rule in enumerate(RULES):
    for _k in _rule.keywords:
        _BY_KEYWORD.setdefault(_k, []).append(_i)
_KEYWORDS = frozenset(_BY_KEYWORD) | frozenset(w for p in BASE for w in p.split())


class Detection(NamedTuple):
    start: int          # first word
    end: int            # word behind the last one
    rule: int


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower() if text.isascii() else text.translate(_ASCII_LOWER))


def suppress(found: list[Detection]) -> list[Detection]:
    """The detections that lie inside no other of higher priority, nor inside a
    longer one of the same priority.  One sweep: by start, longest first, the
    farthest end of each tier so far is all that a later one can lie inside of."""
    farthest: dict[int, int] = {}
    out = []
    for d in sorted(found, key=lambda d: (d.start, -d.end, RULES[d.rule].tier, d.rule)):
        tier = RULES[d.rule].tier
        if any(end >= d.end for t, end in farthest.items() if t <= tier):
            continue
        out.append(d)
        farthest[tier] = max(farthest.get(tier, 0), d.end)
    return out


def scan_words(words: list[str]) -> tuple[list[tuple[int, str]], list[Detection]]:
    """Base places (first word, label) in order, and the detections that stay."""
    have = _KEYWORDS.intersection(words)
    if not have:
        return [], []
    stream = f" {' '.join(words)} "
    base = [(m.start(), label) for label, need, p in _BASE if need <= have for m in p.finditer(stream)]
    hits = [(m.start(), m.end(), i) for i in sorted({i for k in have for i in _BY_KEYWORD.get(k, ())}) for m in RULES[i].pattern.finditer(stream)]
    if not base and not hits:
        return [], []
    # where the words start in the stream
    at, starts = 1, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    places = sorted((bisect_left(starts, s), label) for s, label in base)
    return places, suppress([Detection(bisect_left(starts, s), bisect_left(starts, e), i) for s, e, i in hits])


def scan_text(text: str | None) -> dict:
    words = words_of(text or "")
    places, found = scan_words(words)
    sure = {label: BASE_SURE for _, label in places}
    for d in found:
        rule = RULES[d.rule]
        sure[rule.label] = max(sure.get(rule.label, 0.0), SURE[rule.tier])
    wrong = 1.0
    for label in sorted(sure):
        wrong *= 1.0 - sure[label]
    return {"n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None, "base_labels": ",".join(sorted({label for _, label in places})),
            "labels": ",".join(sorted(sure)), "score": 1.0 - wrong,
            "detections": [{"label": RULES[d.rule].label, "tier": RULES[d.rule].tier, "start": d.start, "end": d.end} for d in found]}


_FIELDS = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"),
           ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double")]
_DETAIL = ("detections", pa.list_(pa.struct([("label", pa.string()), ("tier", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])),
           "array<struct<label:string,tier:int,start:long,end:long>>")


def scan(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Figures, labels and score of every row of ``docs(doc_id, text)``; with
    ``spans`` also the detections with their words (``end`` is exclusive)."""
    fields = [*_FIELDS, _DETAIL] if spans else _FIELDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                got = [scan_text(t.as_py()) for t in b.column(1)]
                cols = [pa.array([g[n] for g in got], k) for n, k, _ in fields]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *[n for n, _, _ in fields]])

    schema = "doc_id long, " + ", ".join(f"{n} {k}" for n, _, k in fields)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
