"""Token ids of whole texts by the ``tokenizers`` library, with memory.

A byte-level BPE text falls apart at white space: no token spans the start of
a " word" chunk.  So each chunk is encoded once by the library's model and its
ids are kept (as little-endian unsigned 32-bit bytes) for the next occurrence.
``IdEncoder`` takes one text at a time, ``BatchEncoder`` an Arrow column of them:
there chunks are cut and counted by numpy and Arrow, and only distinct ones that
are not yet known reach the library.
Tests compare the results with the library's own ``encode`` on whole texts.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from frostline.llm.common import claim

# Unicode white space as the tokenizer's own pattern understands it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

CHUNKS_KEPT = 500_000   # chunks remembered per Python worker
PIECES_KEPT = 300_000   # distinct pre-tokens remembered per Python worker
LONGEST_KEPT = 64       # longer chunks are encoded anew each time


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, as byte-level BPE vocabularies spell bytes:
    printable Latin-1 bytes stand for themselves, the others get the code
    points from 256 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    def __init__(self, model):
        super().__init__()
        self.model, self.spelling = model, byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.spelling)
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) < PIECES_KEPT and len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


# below this all character classes are alike in every Unicode version; beyond
# it the library's own pre-tokenizer cuts
SETTLED = "\u0250"


class _Chunks(dict):
    def __init__(self, pieces: _Pieces, pattern, pre_tokenizer):
        super().__init__()
        self.pieces, self.split, self.library = pieces, pattern.findall, pre_tokenizer.pre_tokenize_str

    def __missing__(self, chunk: str) -> bytes:
        parts = self.split(chunk) if max(chunk) < SETTLED else [chunk[a:b] for _, (a, b) in self.library(chunk)]
        ids = b"".join(map(self.pieces.__getitem__, parts))
        if len(self) < CHUNKS_KEPT and len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids


class IdEncoder:
    """``encode(text)`` -> ids as little-endian unsigned 32-bit bytes; the
    vocabulary's special strings inside a text become their special ids, which
    is the library's default."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = {t.content: array("I", [i]).tobytes() for i, t in tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chunks = _Chunks(_Pieces(tok.model), regex.compile(public_tokenizers.PATTERN), tok.pre_tokenizer)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text))


# The same white space as bytes of UTF-8 (fixed values): the one-byte ones, and the
# first byte of each longer one with what may follow it.
_NARROW = np.zeros(256, bool)
_NARROW[[9, 10, 11, 12, 13, 32]] = True
_WIDE = {w.encode() for w in map(chr, range(128, 0x3001)) if re.match(f"[{SPACE}]", w)}
_WIDE_FIRST = np.zeros(256, bool)
_WIDE_FIRST[[w[0] for w in _WIDE]] = True

KNOWN = 500_000         # chunks that a worker's BatchEncoder remembers
JOINED = 500            # chunks that go to the library as one text
SLICE = 8 << 20         # bytes of texts that a BatchEncoder is given at a time


def chunk_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the chunks of texts start that lie one after the other in ``data``
    (bytes of UTF-8); ``begins``: where each text that is not empty starts.  A run
    of white space is cut off from the word before it; its last character, if it
    is an ASCII one and a word follows, from the rest of the run, and from the
    word too unless it is a blank."""
    space = _NARROW[data]
    wide = np.flatnonzero(_WIDE_FIRST[data])
    for w in _WIDE if len(wide) else ():
        at = wide[wide <= len(data) - len(w)]
        for i, byte in enumerate(w):
            at = at[data[at + i] == byte]
        for i in range(len(w)):
            space[at + i] = True
    begin = np.zeros(len(data), bool)
    begin[begins] = True
    cut = begin.copy()
    cut[1:] |= space[1:] & ~space[:-1]
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begin[1:])
    last = last[data[last] < 128]
    cut[last] = True
    cut[last[data[last] != 32] + 1] = True
    return np.flatnonzero(cut)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, dealt anew: about ``size`` bytes of
    texts in ``column`` at a time, or one text that is longer."""
    size = size or SLICE
    held, total = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(), dtype=np.int64)
        n = int(ends[-1]) if len(ends) else 0
        parts = max(1, -(-n // size))
        borders = [0, *np.searchsorted(ends, [n * i // parts for i in range(1, parts)]).tolist(), len(ends)]
        for first, last in pairwise(borders):
            if first == last:
                continue
            held.append(b.slice(first, last - first))
            total += int(ends[last - 1]) - (int(ends[first - 1]) if first else 0)
            if total >= size // 2:
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def pick_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[s:s + n]`` for each of ``starts`` and ``sizes``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


class BatchEncoder:
    """``encode(texts)`` -> ids of all texts one after the other, and where each
    text's begin (one more entry than texts).  The library encodes every distinct
    chunk of the call that is not remembered, once."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        [self.newline] = self._library(["\n"])[0]
        self.keys = pa.array([], pa.large_binary())
        self.flat, self.starts, self.sizes, self.used = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64, np.int64))
        self.calls = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of chunks whose only white space is a blank in front:
        as lines of one text, since no other chunk has the id of a line's end."""
        ends, data = _bytes_of(words)
        lines = np.insert(data, ends[1:], ord("\n")).tobytes()
        border = (ends + np.arange(len(ends)))[[*range(0, len(words), JOINED), len(words)]].tolist()
        found, sizes = [], []
        for a, b in pairwise(border):
            ids = np.array(self._library([lines[a:b].decode()])[0], np.uint32)
            end = np.flatnonzero(ids == self.newline)
            sizes.append(np.diff(end, prepend=-1) - 1)
            found.append(np.delete(ids, end))
        return np.concatenate(found), np.concatenate(sizes)

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct chunks, in their order."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends, data = _bytes_of(chunks)
        begins = ends[:-1]
        # white space after a chunk's first character, or other than a blank there
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_NARROW[data] | _WIDE_FIRST[data], out=odd[1:])
        plain = odd[ends[1:]] - odd[begins] == (data[begins] == 32)
        plain &= (ends[1:] - begins > 1) | (data[begins] != 32)
        flat, sizes = [], np.zeros(len(chunks), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        if n:
            ids, sizes[order[:n]] = self._encode_words(chunks.take(pa.array(order[:n])))
            flat.append(ids)
        for i in range(n, len(order), JOINED):
            some = order[i:i + JOINED]
            ids = self._library(chunks.take(pa.array(some)).cast(pa.large_string()).to_pylist())
            sizes[some] = list(map(len, ids))
            flat += [np.array(x, np.uint32) for x in ids]
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return pick_runs(np.concatenate(flat), starts, sizes), sizes

    def _encode_plain(self, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are special strings or hold none; ``ends``: where they begin
        in ``data``, and the end of the last."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        cuts = chunk_starts(data, np.unique(ends[ends < len(data)]))
        cuts = np.append(cuts, len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        known = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy()
        new = np.flatnonzero(known < 0)
        old = known[known >= 0]
        fresh = distinct.take(pa.array(new))
        flat, size = self._encode_chunks(fresh)
        starts, sizes = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        starts[new], sizes[new] = np.cumsum(size) - size + len(self.flat), size
        starts[known >= 0], sizes[known >= 0] = self.starts[old], self.sizes[old]
        ids = pick_runs(np.concatenate([self.flat, flat]), starts[codes], sizes[codes])
        before = np.zeros(len(cuts), np.int64)
        np.cumsum(sizes[codes], out=before[1:])
        self.calls += 1
        self.used[old] = self.calls
        self._remember(fresh, flat, size)
        return ids, before[np.searchsorted(cuts, ends)]

    def _remember(self, chunks: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        short = np.flatnonzero(pc.binary_length(chunks).to_numpy() <= LONGEST_KEPT)
        chunks = chunks.take(pa.array(short))
        flat, sizes = pick_runs(flat, (np.cumsum(sizes) - sizes)[short], sizes[short]), sizes[short]
        if len(self.keys) + len(chunks) > KNOWN:    # those not met for the longest time go
            stay = np.sort(np.argsort(-self.used, kind="stable")[:KNOWN // 2])
            self.keys, self.used = self.keys.take(pa.array(stay)), self.used[stay]
            self.flat, self.sizes = pick_runs(self.flat, self.starts[stay], self.sizes[stay]), self.sizes[stay]
            chunks, sizes = chunks[:KNOWN // 2], sizes[:KNOWN // 2]
            flat = flat[:sizes.sum()]
        self.keys = pa.concat_arrays([self.keys, chunks])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.used = np.concatenate([self.used, np.full(len(chunks), self.calls)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        parts = np.ones(len(texts), np.int64)
        cut, done = [], 0
        for row in np.flatnonzero(special).tolist():    # a special string is a text of its own
            cut += [texts[done:row], pa.array(self.cut.split(texts[row].as_py()), pa.large_string())]
            parts[row], done = len(cut[-1]), row + 1
        texts = pa.concat_arrays([*cut, texts[done:]])
        ids, begins = self._encode_plain(*_bytes_of(texts))
        return ids, begins[np.append(0, np.cumsum(parts))]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of an array without nulls begin and the last ends, and their bytes."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], data[ends[0]:ends[-1]]


_ENCODERS: dict[str, IdEncoder | BatchEncoder] = {}


def batch_encoder(vocabulary: str) -> BatchEncoder:
    """As ``encoder``, for columns of texts."""
    claim(_ENCODERS)
    key = f"batch {vocabulary}"
    if key not in _ENCODERS:
        _ENCODERS[key] = BatchEncoder(vocabulary)
    return _ENCODERS[key]


def encoder(vocabulary: str) -> IdEncoder:
    """The worker's encoder for a vocabulary file; it outlives a task, until an
    operator of another kind claims the worker's memory."""
    claim(_ENCODERS)
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = IdEncoder(vocabulary)
        # the collector need not walk through the remembered chunks again and again
        gc.collect()
        gc.freeze()
    return _ENCODERS[vocabulary]
