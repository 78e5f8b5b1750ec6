"""Quality rules, line first.

Each line is judged by itself: symbol soup, navigation bars, shouting, one word
over and over, and boilerplate phrases fail.  The failing lines are removed, and
a document is rejected when too much of its text went with them (or when the
base rules on the whole text fail).

Base figures, over the whole text: ``n_words`` (runs of characters other than
the six ASCII white-space characters), ``word_chars``, ``n_symbols``,
``n_dup_lines`` (lines with a word, equal to an earlier line) and
``n_repeat_words`` (words inside an eight-word window that occurs at least
twice).

Defined cases: a null text is empty (no words, base_failed); ids may be null or
repeated, each row is judged by itself; an empty table gives an empty result;
other columns are ignored by ``judge`` and passed through by ``keep_good``, but
for ``n_chars``, which is the length of the cleaned text there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import claim

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST = 0.5          # share of the word characters that cleaning may remove
# phrases of page furniture; a short line holding one is dropped (fixed values)
BOILERPLATE = (
    "accept all cookies", "accept cookies", "all rights reserved", "click here", "enable javascript",
    "log in", "privacy policy", "sign up", "skip to content", "subscribe to our newsletter", "terms of use",
)
ROWS_CLEANED = 500      # documents cleaned at a time in a task
BOILERPLATE_WORDS = 12  # longer lines are text that mentions the phrase
_ASCII_SPACE = " \t\n\r\x0b\x0c"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, lost_chars long, kept boolean")


def repeated_words(words: list[str]) -> int:
    """Words inside a window of ``WINDOW`` words that occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # equal hashes are checked on the words themselves
    at = np.flatnonzero(twice).tolist()
    seen = Counter(tuple(words[i:i + WINDOW]) for i in at)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i:i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def n_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def line_fails(line: str, words: list[str]) -> bool:
    """The rules for one line (with its words)."""
    n = len(words)
    chars = sum(map(len, words))
    symbols = n_symbols(line)
    if symbols * 4 > chars or (n >= 4 and symbols * 3 > n):       # punctuation and navigation bars
        return True
    if n >= 4 and sum(map(str.isupper, line)) * 10 > 7 * max(1, sum(map(str.isalpha, line))):   # shouting
        return True
    if n >= 8 and max(Counter(words).values()) * 2 > n:           # one word over and over
        return True
    if n <= BOILERPLATE_WORDS:
        low = line.lower()
        return any(p in low for p in BOILERPLATE)
    return False


def judge_text(text: str | None) -> tuple:
    text = text or ""
    words = _WORDS(text)
    word_chars = sum(map(len, words))
    seen: set[str] = set()
    dup = lost = 0
    for line in text.split("\n"):
        own = _WORDS(line)
        if not own:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, own):
            lost += sum(map(len, own))
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and lost <= MAX_LOST * word_chars
    return len(words), word_chars, n_symbols(text), dup, repeat, failed, lost, kept


def clean_text(text: str) -> str:
    """The text without its failing lines."""
    return "\n".join(x for x in text.split("\n") if not (w := _WORDS(x)) or not line_fails(x, w))


def judge(docs: DataFrame, cleaned: bool = False) -> DataFrame:
    """Figures and verdict for every row of ``docs(doc_id, text)``; with
    ``cleaned`` also the text without its failing lines, as ``cleaned_text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept"]
        for b in batches:
            if b.num_rows:
                texts = b.column(1).to_pylist()
                cols = [pa.array(c, k) for c, k in zip(zip(*map(judge_text, texts), strict=True), kinds, strict=True)]
                more = [pa.array([clean_text(t or "") for t in texts], pa.string())] if cleaned else []
                yield pa.RecordBatch.from_arrays([b.column(0), *cols, *more], names=["doc_id", *names, *["cleaned_text"][:len(more)]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT + ", cleaned_text string" * cleaned)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their failing lines removed from
    ``text`` and ``n_chars`` (if there is one) in line; other columns as they were."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim({})
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_CLEANED):
                b = whole.slice(start, ROWS_CLEANED)
                texts = b.column(at).to_pylist()
                good = [judge_text(t)[-1] for t in texts]
                texts = [clean_text(t) for t, g in zip(texts, good, strict=True) if g]      # a null text is never kept
                b = b.filter(pa.array(good))
                cols = list(b.columns)
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if size is not None:
                    cols[size] = pa.array(map(len, texts), b.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
