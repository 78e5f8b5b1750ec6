"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

The vocabulary file gives the merge ranks.  A text is normalised and cut into
pre-tokens as the file says (NFC, lower case, letters / one digit / other runs,
white space dropped), a pre-token is spelled as byte symbols with the word end
on the last one, and its count is the number of symbols minus the number of
merges: a heap yields the adjacent pair of lowest rank, a linked list joins its
neighbours.  Counts of chunks and pre-tokens seen before are remembered.

Defined cases: a null text is empty (0 bytes, 0 tokens); ids may be null or
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.bpe_ids import CHUNKS_KEPT, LONGEST_KEPT, PIECES_KEPT, SETTLED, SPACE, byte_alphabet

LIMIT = 2048
# the vocabulary's pre-token pattern (fixed value of the file)
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def merges_done(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of merges that byte-pair encoding makes on ``symbols``."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
            if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    done = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue                    # one of the two has been merged meanwhile
        done += 1
        symbols[i], symbols[j] = a + b, ""
        right[i] = after = right[j]
        right[j] = -1
        if after >= 0:
            left[after] = i
            if (r := ranks.get((symbols[i], symbols[after]))) is not None:
                heappush(heap, (r, i, symbols[i], symbols[after]))
        before = left[i]
        if before >= 0 and (r := ranks.get((symbols[before], symbols[i]))) is not None:
            heappush(heap, (r, before, symbols[before], symbols[i]))
    return done


class _PieceCounts(dict):
    def __init__(self, ranks, word_end: str):
        super().__init__()
        self.ranks, self.word_end, self.spelling = ranks, word_end, byte_alphabet()

    def __missing__(self, piece: str) -> int:
        symbols = list(piece.encode().decode("latin-1").translate(self.spelling))
        symbols[-1] += self.word_end
        n = len(symbols) - merges_done(symbols, self.ranks)
        if len(self) < PIECES_KEPT and len(piece) <= LONGEST_KEPT:
            self[piece] = n
        return n


class _ChunkCounts(dict):
    def __init__(self, pieces: _PieceCounts, library):
        super().__init__()
        import regex
        self.pieces, self.split = pieces, regex.compile(PRE_TOKEN).findall
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def __missing__(self, chunk: str) -> int:
        if max(chunk) < SETTLED:
            parts = self.split(unicodedata.normalize("NFC", chunk).lower())
        else:       # character classes differ between Unicode versions: as the library has them
            low = self.normalize(chunk)
            parts = [low[a:b] for _, (a, b) in self.pre_tokenize(low)]
        n = sum(map(self.pieces.__getitem__, parts))
        if len(self) < CHUNKS_KEPT and len(chunk) <= LONGEST_KEPT:
            self[chunk] = n
        return n


class TokenCounter:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special)))
        self.chunks = _ChunkCounts(_PieceCounts(ranks, model.get("end_of_word_suffix") or ""),
                                   Tokenizer.from_file(public_tokenizers.path(vocabulary)))
        self.split = re.compile(f"[^{SPACE}]+").findall

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(s in text for s in self.special):
            return sum(map(self.chunks.__getitem__, self.split(text)))
        found = len(self.cut.findall(text))
        return found + sum(sum(map(self.chunks.__getitem__, self.split(t))) for t in self.cut.split(text))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(vocabulary: str) -> TokenCounter:
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = TokenCounter(vocabulary)
        # the collector need not walk through the remembered chunks again and again
        gc.collect()
        gc.freeze()
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """Counts for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
