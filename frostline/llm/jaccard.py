"""N-gram Jaccard join: documents whose sets of five-word shingles have a
Jaccard similarity of at least ``PERCENT`` hundredths are linked; each gets the
smallest id it can reach by links.  The join is exact.

1. One pass over the texts hashes every document's shingles (64 bits) to a set
   and the set to a signature.  Copies share a signature and are one set from
   here on.  Shingle fingerprints are counted over the whole corpus, in buckets;
   those of a text that is there more than once are counted once (as far as
   ``MAX_REPEATED`` such texts go), so that copies do not make them frequent.
2. Prefix filter, rarest shingles first: two similar sets share a shingle among
   the first ``size - ceil(t * size) + 1`` of each.  A shingle that no other set
   has cannot be shared, so most documents post nothing.  The order only has to
   be the same everywhere, not exact: it comes from the counted frequencies in
   two structures of limited size (a bit filter of repeated fingerprints, and the
   ``MAX_FREQUENT`` most frequent ones), broadcast whole.
3. The posted index lists tie sets into candidate clusters.  Two sets of a list
   are tied unless their sizes or their sketches rule a link out: a sketch is the
   parity of the shingles in each of some thousand cells, and two sets differ in
   at least as many shingles as their sketches do in cells.
4. Set-relation skipping inside a cluster: sets stand in the order of their
   size.  Shingles of few sets are counted by their index lists; a set is
   skipped if its size, or what it shares of those, rules out enough overlap.
   The other shingles are columns of a bit matrix, and a set that is close to
   one already answered takes over its overlaps, corrected by the words of the
   matrix in which the two differ.  A cluster too large for one task is dealt
   into blocks, and every pair of blocks is a task.

Words are lower-cased A-Z and are runs of characters other than the six ASCII
white-space characters; with fewer than five words the whole sequence is one
shingle.

Defined cases: a null or empty text has no shingles, links with nothing and is a
component of its own; rows with a null id take part, but a null is never the
smallest id (a component of null ids only has a null id); repeated rows are
copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import TEXTS, claim, materialize

WORDS = 5
PERCENT = 75
BYTES = 4_000_000           # of texts hashed at a time
LONGEST_WORD = 64           # bytes; longer words are hashed one by one
MAX_REPEATED = 1 << 20      # repeated texts known as such (16 MB at most)
FILTER_BITS = 1 << 29       # bit filter of fingerprints met twice or more (64 MB at most)
FILTER_SPACE = 8            # ... with so many bits for each of them at least, as far as that goes
MAX_FREQUENT = 1 << 20      # fingerprints whose frequency is known (16 MB at most)
FREQUENT = 4                # from this frequency on
SETS_IN_TASK = 2_048        # a larger cluster is dealt into blocks
SHINGLES_IN_TASK = 2_000_000
SKETCH_BITS = 1 << 10       # cells of a sketch; sets over so many shingles have
LONG_SKETCH_BITS = 1 << 13  # ... so many, which fold to the shorter ones
LONGEST_LIST = 1 << 16      # the sets of a longer list are tied without looking
SHORT_LIST = 64             # the pairs of lists up to here are looked at all at once
LIST_ROWS = 20_000          # rows of lists looked at together
FIRST_WORDS = 6             # of a sketch, compared before the rest
RARE_PAIRS = 1_000_000      # pairs from index lists added up at a time
ROWS = 512                  # rows of a cluster's bit matrix compared at a time
PIVOTS = 16                 # answered sets whose overlaps are kept
FEW_SETS = 32               # so few are compared without them
PAIRS = 50_000              # pairs whose sketches are compared at a time
RARE = 64                   # a shingle in fewer than one of so many sets of a cluster is counted by its index list
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other, and where
    each text's words begin (and the last one's end).  Words are read in pieces
    of eight bytes; two words of up to eight bytes never share a hash unless
    their lengths differ."""
    low = np.zeros(len(data) + 8, np.uint8)     # a word's last piece may reach beyond it
    low[:-8] = _LOWER[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[1:] > bounds[:-1]             # words end with their text
    first[bounds[:-1][full]] = inside[bounds[:-1][full]]
    last[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
    starts = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - starts
    pieces = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    h = length.astype(np.uint64) * _MIX[3]
    at = np.arange(len(starts))
    for done in range(0, LONGEST_WORD, 8):
        x = h[at] ^ pieces[starts[at] + done] & _KEPT[np.minimum(length[at] - done, 8)]
        x = (x ^ x >> np.uint64(32)) * _MIX[0]
        x = (x ^ x >> np.uint64(29)) * _MIX[1]
        h[at] = x ^ x >> np.uint64(32)
        at = at[length[at] > done + 8]
        if not len(at):
            break
    if len(at):
        import xxhash
        for i in at.tolist():
            h[i] = xxhash.xxh3_64_intdigest(low[starts[i]:starts[i] + length[i]])
    return h, np.searchsorted(starts, bounds)


def _sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one after the other,
    and where each text's begin."""
    h, begin = _word_hashes(data, bounds)
    n_words = np.diff(begin)
    n = np.where(n_words < WORDS, np.minimum(n_words, 1), n_words - WORDS + 1)
    ends = np.cumsum(n)
    key = np.zeros(int(ends[-1]), np.uint64)
    whole = np.zeros(len(key), bool)            # shingles of texts with fewer words
    for k in range(1, WORDS):
        short = np.flatnonzero(n_words == k)
        at = ends[short] - 1
        x = np.full(len(short), k, np.uint64)
        for j in range(k):
            x = x * _MIX[0] + h[begin[short] + j] * _MIX[j + 1]
        key[at], whole[at] = x, True
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        rolled = h[:m] * _MIX[0]
        for j in range(1, WORDS):
            rolled += h[j:j + m] * _MIX[j]
        within = np.ones(len(h), bool)          # those that begin in a text's last words reach into the next text
        for j in range(1, WORDS):
            within[np.maximum(begin[1:] - j, 0)[begin[1:] >= j]] = False
        key[~whole] = rolled[within[:m]]
    key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    edges = np.concatenate([[0], ends])
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b - a > 1:
            key[a:b].sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    keep[edges[:-1][n > 0]] = True
    return key[keep], np.concatenate([[0], np.cumsum(keep)])[edges]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in runs of some ``BYTES`` bytes: the number of the run's first text, and
    the sets of its texts as of ``_sets``; null as an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BYTES, "right")) - 1)
        b = min(b, len(texts))
        yield a, *_sets(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
        a = b


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return next(shingle_sets(pa.array([text], pa.string())))[1]


def signature(s: np.ndarray) -> int | None:
    """Hash of a whole set; None for the empty one."""
    import xxhash
    if not len(s):
        return None
    h = xxhash.xxh3_64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def least_overlap(a, b):
    """Smallest overlap of linked sets of sizes a and b: 100 i >= P (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """A linked set has at least ceil(P n / 100) of the n shingles in common."""
    return n - -(-PERCENT * n // 100) + 1


# --- 1. sets and frequencies -------------------------------------------------
# rows: documents (prints is null), packed fingerprints, or counted ones
_MARKED = "doc_id long, h long, n_shingles long, sig long, bucket int, prints binary, bits binary, counts binary"
_NAMES = ["doc_id", "h", "n_shingles", "sig", "bucket", "prints", "bits", "counts"]
_KINDS = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 3
PACKED = 2_000_000          # fingerprints packed at a time


def _arrow(cols, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _pack_repeated(share: float):
    """Repeated texts (h, least, copies), packed; those with the most copies if not all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, least, n = (b.column(c).to_numpy() for c in ("h", "least", "copies"))
            top = np.argsort(-n, kind="stable")[:int(len(n) * share)]
            yield _arrow([[h[top].tobytes()], [least[top].tobytes()]], [pa.binary()] * 2, ["h", "least"])
    return run


class Repeated:
    """Which rows hold a text that another row stands for."""

    def __init__(self, rows):
        h, least = (np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in (0, 1))
        order = np.argsort(h)
        self.h, self.least = h[order], least[order]

    def first(self, h: np.ndarray, doc_id: pa.Array) -> np.ndarray:
        """True for the row of smallest id of a repeated text, and for all other texts."""
        if not len(self.h):
            return np.ones(len(h), bool)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        own = doc_id.is_valid().to_numpy(zero_copy_only=False) & (doc_id.fill_null(0).to_numpy() == self.least[i])
        return own | (self.h[i] != h)


def _repeated(d: DataFrame, most: int) -> Repeated:
    again = d.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and least is not null")
    again = materialize(again, "repeated-texts")
    total = again.count()
    return Repeated(again.mapInArrow(_pack_repeated(min(1.0, most / max(1, total))), "h binary, least binary").collect())


def _hash_documents(bucket_bits: int, repeated):
    """Documents, and the fingerprints of their sets in buckets; of a repeated
    text once.  A fingerprint is the high bits of a shingle: its bucket, and 32
    bits more."""
    shift, edges = np.uint64(32 - bucket_bits), np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim({})
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def packed():
            every = np.sort(np.concatenate(held) >> shift)
            cuts = [0, *np.searchsorted(every, edges).tolist(), len(every)]
            every = every.astype(np.uint32)
            rows = [(i, every[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            none = [None] * len(rows)
            return _arrow([none, none, none, none, [r[0] for r in rows], [r[1] for r in rows], none, none], _KINDS, _NAMES)

        for b in batches:
            n, sigs = [], []
            first = repeated.value.first(b.column(1).to_numpy(), b.column(0))
            for at, values, bounds in shingle_sets(b.column(2)):
                cuts = bounds.tolist()
                for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    s = values[x:y]
                    sig = signature(s)
                    n.append(y - x)
                    sigs.append(sig)
                    if sig is not None and first[at + i] and sig not in seen:
                        seen.add(sig)
                        held.append(s)
                        size += y - x
                if size >= PACKED:
                    yield packed()
                    held, size = [], 0
            none = [None] * len(n)
            # documents are dealt out over all buckets
            yield _arrow([b.column(0), b.column(1), n, sigs, [i % (1 << bucket_bits) for i in range(len(n))], none, none, none], _KINDS, _NAMES)
        if held:
            yield packed()
    return run


def _count_prints(per_slice: int):
    """Documents as they are, and per bucket its slice of the bit filter (a
    power of two of bits, ``per_slice`` at most) and its frequent fingerprints."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            is_doc = b.column("prints").is_null()
            if is_doc.true_count:
                yield b.filter(is_doc)
            p = b.filter(is_doc.cast(pa.int8()).to_numpy(zero_copy_only=False) == 0) if is_doc.true_count < b.num_rows else None
            if p is not None:
                for bucket, prints in zip(p.column("bucket").to_pylist(), p.column("prints").to_pylist(), strict=True):
                    held.setdefault(bucket, []).append(prints)
        for bucket in sorted(held):
            p, n = np.unique(np.frombuffer(b"".join(held.pop(bucket)), np.uint32), return_counts=True)
            again = p[n > 1]
            bits = np.zeros(min(per_slice, 1 << max(3, (FILTER_SPACE * len(again)).bit_length())), bool)
            bits[(again & np.uint32(len(bits) - 1)).astype(np.int64)] = True
            frequent = n >= FREQUENT
            yield _arrow([[None]] * 4 + [[bucket], [p[frequent].tobytes()], [np.packbits(bits).tobytes()],
                                         [n[frequent].astype(np.int64).tobytes()]], _KINDS, _NAMES)
    return run


class Frequencies:
    """What the order of shingles is made from; of limited size."""

    def __init__(self, rows, bucket_bits: int, most: int):
        self.bucket_bits = bucket_bits
        rows = sorted(rows, key=lambda r: r.bucket)
        slices = [np.zeros(1, np.uint8), *(np.frombuffer(r.bits, np.uint8) for r in rows)]     # the first one: of buckets without a slice
        self.bits = np.concatenate(slices)
        self.start, self.mask = np.zeros(1 << bucket_bits, np.int64), np.zeros(1 << bucket_bits, np.int64)
        buckets = [r.bucket for r in rows]
        sizes = np.array([len(x) for x in slices])
        self.start[buckets] = 8 * np.cumsum(sizes)[:-1]
        self.mask[buckets] = 8 * sizes[1:] - 1
        prints, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in rows:
            prints.append(np.frombuffer(r.prints, np.uint32).astype(np.uint64) | np.uint64(r.bucket) << np.uint64(32))
            counts.append(np.frombuffer(r.counts, np.int64))
        p, n = np.concatenate(prints), np.concatenate(counts)
        top = np.sort(np.argsort(-n, kind="stable")[:most])
        self.prints, self.counts = p[top], n[top]

    def of(self, s: np.ndarray) -> np.ndarray:
        """1 (met once), 2 (twice or more, or hidden by the filter), or the known count."""
        p = s >> np.uint64(32 - self.bucket_bits)
        bucket = (p >> np.uint64(32)).astype(np.int64)
        at = self.start[bucket] + (p.view(np.int64) & self.mask[bucket])
        n = 1 + (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(np.int64)
        if len(self.prints):
            again = np.flatnonzero(n > 1)
            p = p[again]
            i = np.minimum(np.searchsorted(self.prints, p), len(self.prints) - 1)
            n[again] = np.where(self.prints[i] == p, self.counts[i], 2)
        return n


def _frequencies(marked: DataFrame, bucket_bits: int, most: int) -> Frequencies:
    rows = marked.filter("prints is not null").select("bucket", "bits", "prints", "counts")
    total = rows.agg(F.sum(F.length("prints") / 4)).first()[0] or 0
    if total > most:        # the most frequent ones of every bucket reach the driver
        share = most / total

        def cut(batches):
            for b in batches:
                ps, ns = [], []
                for p, n in zip(b.column("prints").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    p, n = np.frombuffer(p, np.uint32), np.frombuffer(n, np.int64)
                    top = np.sort(np.argsort(-n, kind="stable")[:int(len(n) * share)])
                    ps.append(p[top].tobytes())
                    ns.append(n[top].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("bits"), pa.array(ps, pa.binary()), pa.array(ns, pa.binary())],
                                                 names=["bucket", "bits", "prints", "counts"])
        rows = rows.mapInArrow(cut, rows.schema)
    return Frequencies(rows.collect(), bucket_bits, most)


# --- 2. posted sets ----------------------------------------------------------
def _post(frequencies, repeated):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim({})
        seen: set[int] = set()
        for b in batches:
            out = []
            first = repeated.value.first(b.column(1).to_numpy(), b.column(0))
            for at, values, bounds in shingle_sets(b.column(2)):
                n = frequencies.value.of(values)
                sizes = np.diff(bounds)
                alone = np.diff(np.concatenate([[0], np.cumsum(n == 1)])[bounds])
                posted = prefix_length(sizes) - alone       # the prefix begins with the shingles that no other set has
                for i in np.flatnonzero((posted > 0) & (sizes > 0) & first[at:at + len(sizes)]).tolist():
                    s = values[bounds[i]:bounds[i + 1]]
                    sig = signature(s)
                    if sig in seen:
                        continue
                    seen.add(sig)
                    # the set in the common order, and how much of it is posted
                    s = s[np.argsort(n[bounds[i]:bounds[i + 1]], kind="stable")]
                    out.append((sig, len(s), s.tobytes(), int(alone[i]), int(posted[i])))
            if out:
                yield _arrow(list(zip(*out, strict=True)), [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()],
                             ["sig", "size", "tokens", "skip", "posted"])
    return run


def _explode_posts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim({})
    for b in batches:
        sigs, sizes, tokens = [], [], []
        for sig, size, raw, skip, posted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = np.frombuffer(raw, np.int64)[skip:skip + posted]
            tokens.append(t)
            sigs.append(np.full(len(t), sig, np.int64))
            sizes.append(np.full(len(t), size, np.int32))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sigs))],
                                             names=["token", "size", "sig"])


# --- 3. candidate clusters ---------------------------------------------------
class Forest:
    """Union-find over arbitrary keys; the root is the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _edge_batches(edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if edges:
        yield _arrow(list(zip(*edges, strict=True)), [pa.int64(), pa.int64()], ["a", "b"])


def sketch(tokens: np.ndarray) -> bytes:
    bits = SKETCH_BITS if len(tokens) <= SKETCH_BITS else LONG_SKETCH_BITS
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _arrow([b.column(0), [sketch(np.frombuffer(t, np.uint64)) for t in b.column(1).to_pylist()]],
                     [pa.int64(), pa.binary()], ["sig", "sketch"])


def _shared_posts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted posts (token, size, sig) -> those of lists with two sets at least."""
    last = None                     # the post before, and whether it has gone out
    for b in batches:
        t, n, g = (b.column(c).to_numpy() for c in ("token", "size", "sig"))
        if not len(t):
            continue
        same = np.zeros(len(t), bool)       # shares its list with the post before it
        same[1:] = t[1:] == t[:-1]
        if last is not None:
            same[0] = t[0] == last[0]
            if same[0] and not last[3]:
                yield _arrow([[last[0]], [last[1]], [last[2]]], [pa.int64(), pa.int32(), pa.int64()], ["token", "size", "sig"])
        out = same.copy()
        out[:-1] |= same[1:]
        yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(n[out]), pa.array(g[out])], names=["token", "size", "sig"])
        last = (int(t[-1]), int(n[-1]), int(g[-1]), bool(out[-1]))


class Sketches:
    """Sets in ascending size with their sketches, folded to the short length
    and, where there is one, the long one."""

    def __init__(self, sizes: np.ndarray, column: pa.Array):
        _, offsets, data = column.buffers()
        cuts = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        words = np.frombuffer(data, np.uint64)[cuts[0] // 8:cuts[-1] // 8].reshape(-1, SKETCH_BITS // 64)
        at = (cuts[:-1] - cuts[0]) * 8 // SKETCH_BITS
        self.sizes = sizes.astype(np.int64)
        self.folded = np.bitwise_xor.reduceat(words, at, axis=0)
        self.first = np.ascontiguousarray(self.folded[:, :FIRST_WORDS].T)
        self.most = (100 - PERCENT) * sizes.astype(np.int32)
        has = np.diff(cuts) * 8 == LONG_SKETCH_BITS
        self.long = words[at[has][:, None] + np.arange(LONG_SKETCH_BITS // SKETCH_BITS)].reshape(-1, LONG_SKETCH_BITS // 64)
        self.at = np.where(has, np.cumsum(has) - 1, -1)

    def possible(self, x, y: np.ndarray) -> np.ndarray:
        """Which of the pairs neither size nor sketch rules out, ``x`` (one set,
        or one for each of ``y``) being the smaller one.  A link means
        100 i >= P (a + b - i), so at most (100 - P) / (100 + P) of a + b shingles
        are in one set only."""
        one = np.ndim(x) == 0
        most = (100 - PERCENT) * (self.sizes[x] + self.sizes[y])
        ok = np.flatnonzero(100 * self.sizes[x] >= PERCENT * self.sizes[y])
        for words, at in ((self.folded, None), (self.long, self.at)):
            if at is not None:          # sketches of unlike lengths have been compared
                own = at[x] if one else at[x[ok]]
                both = np.flatnonzero((own >= 0) & (at[y[ok]] >= 0))
                left, right = own if one else own[both], at[y[ok[both]]]
            else:
                both = np.arange(len(ok))
                left, right = x if one else x[ok], y[ok]
            if not len(both):
                continue
            apart = np.concatenate([np.bitwise_count(words[left if one else left[k:k + PAIRS]] ^ words[right[k:k + PAIRS]]).sum(axis=1, dtype=np.int64)
                                    for k in range(0, len(both), PAIRS)])
            bad = (100 + PERCENT) * apart > most[ok[both]]
            ok = np.delete(ok, both[bad])
        out = np.zeros(len(y), bool)
        out[ok] = True
        return out

    def later(self, x: int, group: np.ndarray | None = None) -> np.ndarray:
        """The sets after ``x`` that neither size nor sketch rules out; with
        ``group``, those of other groups."""
        end = np.searchsorted(self.sizes, 100 * self.sizes[x] // PERCENT, "right")
        apart = np.zeros(max(0, end - x - 1), np.uint16)
        for words in self.first:
            apart += np.bitwise_count(words[x + 1:end] ^ words[x])
        y = np.flatnonzero((100 + PERCENT) * apart.astype(np.int32) <= self.most[x + 1:end] + self.most[x]) + x + 1
        if group is not None:
            y = y[group[y] != group[x]]
        return y[self.possible(x, y)] if len(y) else y


def possible_links(sizes: np.ndarray, raw: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For sets in ascending size: the later ones that neither size nor sketch
    rules out."""
    sets = Sketches(sizes, pa.array(raw, pa.binary()))
    for x in range(len(raw) - 1):
        y = sets.later(x)
        if len(y):
            yield x, y


class Groups:
    """Which of some numbered things hang together."""

    def __init__(self, of: np.ndarray):
        self.of = of
        self.links: list[tuple[int, int]] = []      # that made one of two groups

    def tie(self, x: int, ys: np.ndarray) -> None:
        ys = ys[self.of[ys] != self.of[x]]
        for group, at in zip(*np.unique(self.of[ys], return_index=True)):
            self.links.append((x, int(ys[at])))
            self.of[self.of == group] = self.of[x]

    def apart(self) -> bool:
        return bool((self.of != self.of[0]).any())


def _tie_list(sets: Sketches, sigs: np.ndarray, forest: Forest) -> None:
    """One long list."""
    def groups():
        return Groups(np.unique(np.array([forest.root(s) for s in sigs.tolist()], np.int64), return_inverse=True)[1])

    if not groups().apart():
        return
    x = np.arange(len(sigs) - 1)        # most neighbours of a long list are close: often they tie it all
    for i in np.flatnonzero(sets.possible(x, x + 1)).tolist():
        forest.join(int(sigs[i]), int(sigs[i + 1]))
    g = groups()
    for i in x.tolist():
        if not g.apart():
            break
        g.tie(i, sets.later(i, g.of))
    for i, j in g.links:
        forest.join(int(sigs[i]), int(sigs[j]))


def _tie_lists(token: np.ndarray, sets: Sketches, sigs: np.ndarray, forest: Forest) -> None:
    """Short lists, all at once."""
    rows, pairs = np.arange(len(token)), []
    for k in range(1, len(token)):
        rows = rows[rows + k < len(token)]
        rows = rows[token[rows] == token[rows + k]]         # those whose list goes on as far
        if not len(rows):
            break
        pairs.append(np.stack([rows, rows + k]))
    if not pairs:
        return
    x, y = np.concatenate(pairs, axis=1)
    names, number = np.unique(sigs, return_inverse=True)
    # a pair may be in many lists
    _, once = np.unique(number[x] * len(names) + number[y], return_index=True)
    x, y = x[once], y[once]
    ok = sets.possible(x, y)
    for a, c in zip(sigs[x[ok]].tolist(), sigs[y[ok]].tolist()):
        forest.join(a, c)


def _list_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists (token, size, sig, sketch) -> a spanning forest of the pairs
    that may be links."""
    forest = Forest()

    def chain(sigs):        # no pair is lost: the whole list is tied, and the join looks at every tied pair
        for a, c in zip(sigs, sigs[1:]):
            forest.join(a, c)

    def settle(table, token, long):
        """Lists that are whole; the first one may be the rest of a longer one."""
        table = table.combine_chunks()
        starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
        sigs = table.column("sig").to_numpy()
        sizes = np.diff(starts)
        short = sizes <= SHORT_LIST
        short[0] &= not long
        for i in np.flatnonzero(~short).tolist():
            a, c = int(starts[i]), int(starts[i + 1])
            if c - a > LONGEST_LIST or i == 0 and long:
                chain(sigs[a:c].tolist())
            else:
                part = table.slice(a, c - a)
                _tie_list(Sketches(part.column("size").to_numpy(), part.column("sketch").combine_chunks()), sigs[a:c], forest)
        rows = np.flatnonzero(np.repeat(short & (sizes > 1), sizes))
        if len(rows):
            part = table.take(pa.array(rows)).combine_chunks()
            _tie_lists(token[rows], Sketches(part.column("size").to_numpy(), part.column("sketch").combine_chunks()), sigs[rows], forest)

    held, n_held, long = [], 0, False       # from the beginning of the list that is still open
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n_held += b.num_rows
        if n_held < LIST_ROWS:
            continue
        table = pa.Table.from_batches(held)
        token = table.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut:
            settle(table.slice(0, cut), token[:cut], long)
            long = False
        table = table.slice(cut)
        if table.num_rows > LONGEST_LIST:
            chain(table.column("sig").to_pylist())
            table, long = table.slice(table.num_rows - 1), True
        held, n_held = table.to_batches(), table.num_rows
    if held:
        table = pa.Table.from_batches(held)
        settle(table, table.column("token").to_numpy(), long)
    yield from _edge_batches(forest.edges())


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node of every node's component, for nodes with
    an edge.  Labels spread over the edges and jump to their label's label; no
    round moves more than the edges and nodes."""
    # not a union: that would find the edges twice
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = materialize(edges.select(ways.alias("way")).select("way.a", "way.b").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0")
    for i in range(1, 64):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
                .withColumnRenamed("a", "node"))
        spread = labels.join(near, "node").select("node", F.least("root", "m").alias("step"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("step"), F.col("root").alias("further"))
        new = materialize(spread.join(jump, "step").select("node", F.least("step", "further").alias("root"), "old"), f"{name}-{i}")
        changed = new.filter("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


# --- 4. exact join inside a cluster -------------------------------------------
def join_cluster(tokens: list[np.ndarray], cross: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Links among sets: for each set its linked partners among the sets before
    it, by size.  With ``cross`` only partners of the other side count.

    Shingles of one set alone are in no overlap.  Those of few sets are counted
    by their index lists, pair by pair; the others are the columns of a bit
    matrix, and overlaps in them are counted 64 shingles (a word) at a time,
    skipping sets that cannot be partners and words that a close set has alike."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    by_size = np.argsort(sizes, kind="stable")
    sizes = sizes[by_size]
    n_sets = len(sizes)
    every = np.concatenate([tokens[i] for i in by_size])
    order = np.argsort(every)
    every = every[order]
    begins = np.concatenate([[0], np.flatnonzero(every[1:] != every[:-1]) + 1])
    del every
    counts = np.diff(np.concatenate([begins, [len(order)]]))
    owner = np.repeat(np.arange(n_sets, dtype=np.int32), sizes)[order]
    del order
    often = counts * RARE >= max(n_sets, RARE * 2)

    def spread(lists):
        """The entries of some index lists."""
        n = counts[lists]
        return np.repeat(begins[lists] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    # index lists of the others: pairs k entries apart, list by list
    rare = np.zeros((n_sets, n_sets) if (few := np.flatnonzero((counts > 1) & ~often)).size else (1, 1), np.int32)
    at, ends = spread(few), np.repeat(begins[few] + counts[few], counts[few])
    for k in range(1, int(counts[few].max(initial=0))):
        more = at + k < ends
        at, ends = at[more], ends[more]
        for i in range(0, len(at), RARE_PAIRS):
            x, y = owner[at[i:i + RARE_PAIRS]].astype(np.int64), owner[at[i:i + RARE_PAIRS] + k].astype(np.int64)
            pairs = np.sort(np.maximum(x, y) * n_sets + np.minimum(x, y))
            first = np.concatenate([[0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1, [len(pairs)]])
            rare.reshape(-1)[pairs[first[:-1]]] += np.diff(first).astype(np.int32)
    del at, ends
    much = np.flatnonzero(often)
    bits = np.zeros((n_sets, max(1, -(-len(much) // 64))), np.uint64)
    for i in range(0, len(much), 64):       # one column of words at a time
        w = much[i:i + 64]
        square = np.zeros((n_sets, 64), np.uint8)
        square[owner[spread(w)], np.repeat(np.arange(len(w)), counts[w])] = 1
        bits[:, i // 64] = np.packbits(square, axis=1, bitorder="little").view(np.uint64).ravel()
    del owner

    often_of = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    side = None if cross is None else cross[by_size]
    pivots: list[tuple[int, np.ndarray]] = []

    def overlaps(x, among, words=slice(None)):
        """In the columns, or in some words of them."""
        return np.concatenate([np.bitwise_count(bits[among[i:i + ROWS]][:, words] & bits[x, words]).sum(axis=1, dtype=np.int64)
                               for i in range(0, len(among), ROWS)])

    for x in range(1, n_sets):
        n = int(sizes[x])
        among = np.arange(np.searchsorted(sizes, -(-PERCENT * n // 100)), x)        # smaller sets are no partners
        if side is not None:
            among = among[side[among] != side[x]]
        # skipped: those that share too few of the rare shingles for what their sizes ask
        inter = rare[x, among] if len(few) else np.zeros(len(among), np.int64)
        might = np.minimum(often_of[x], often_of[among]) + inter >= least_overlap(n, sizes[among])
        among, inter = among[might], inter[might]
        if not len(among):
            continue
        unlike = [np.flatnonzero(bits[p] != bits[x]) for p, _ in pivots] if len(among) > FEW_SETS else []
        closest = min(range(len(unlike)), key=lambda k: len(unlike[k]), default=None)
        if closest is not None and 3 * len(unlike[closest]) < bits.shape[1]:
            # the overlaps of a close set, corrected by the words in which the two differ
            p, whole = pivots[closest]
            inter = inter + whole[among] + overlaps(x, among, unlike[closest]) - overlaps(p, among, unlike[closest])
        elif len(among) > FEW_SETS and 4 * len(among) > n_sets:
            pivots = [(x, overlaps(x, np.arange(n_sets))), *pivots[:PIVOTS - 1]]
            inter = inter + pivots[0][1][among]
        else:
            inter = inter + overlaps(x, among)
        linked = by_size[among[100 * inter >= PERCENT * (n + sizes[among] - inter)]]
        if len(linked):
            yield int(by_size[x]), linked


_LINKS = "a long, b long, n_links long"


def _join_clusters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (cluster, i, j) -> a spanning forest of the links
    (a, b), and the number of linked documents (a, n_links)."""

    def solve(rows, crossed):
        sigs = np.array([r[0] for r in rows], np.int64)
        copies = np.array([r[1] for r in rows], np.int64)
        side = np.array([r[2] for r in rows])
        degree = np.zeros(len(rows), np.int64)
        groups = Groups(np.arange(len(rows)))
        for x, partners in join_cluster([np.frombuffer(r[3], np.uint64) for r in rows], side if crossed else None):
            degree[x] += copies[partners].sum()
            degree[partners] += copies[x]
            groups.tie(x, partners)
        linked = np.flatnonzero(degree)
        # every linked set hangs on the smallest one of its group
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, groups.of, sigs)
        least = least[groups.of]
        ends = linked[least[linked] != sigs[linked]]
        return (sigs[ends].tolist() + sigs[linked].tolist(), least[ends].tolist() + [None] * len(linked),
                [None] * len(ends) + degree[linked].tolist())

    claim({})
    task, rows = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("cluster", "i", "j", "sig", "copies", "block", "tokens")]
        for cluster, i, j, *row in zip(*cols, strict=True):
            if (cluster, i, j) != task:
                if len(rows) > 1:
                    yield _arrow(solve(rows, task[1] != task[2]), [pa.int64()] * 3, ["a", "b", "n_links"])
                task, rows = (cluster, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield _arrow(solve(rows, task[1] != task[2]), [pa.int64()] * 3, ["a", "b", "n_links"])


def link_documents(docs: DataFrame, filter_bits: int = FILTER_BITS, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked directly,
    copies included) for every row of ``docs(doc_id, text)``; also h (hash of
    the text) and sig (signature of the set)."""
    spark = docs.sparkSession
    # more buckets for more partitions: a bucket is counted in memory
    bucket_bits = min(20, max(4, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1))
    per_slice = max(8, filter_bits >> bucket_bits)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("h"), "text")
    repeated = spark.sparkContext.broadcast(_repeated(d, MAX_REPEATED))
    marked = d.mapInArrow(_hash_documents(bucket_bits, repeated), _MARKED)
    marked = materialize(marked.repartition("bucket").mapInArrow(_count_prints(per_slice), _MARKED), "shingle-sets", batch=TEXTS)
    frequencies = spark.sparkContext.broadcast(_frequencies(marked, bucket_bits, max_frequent))
    own = marked.filter("prints is null").select("doc_id", "h", "n_shingles", "sig")
    classes = materialize(own.filter("sig is not null").groupBy("sig")
                          .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "shingle-classes")

    posted = d.mapInArrow(_post(frequencies, repeated), "sig long, size int, tokens binary, skip int, posted int")
    # a copy in another task posts the same set again
    sets = materialize(posted.dropDuplicates(["sig"]), "posted-sets", batch=TEXTS)
    posts = sets.select("sig", "size", "tokens", "skip", "posted").mapInArrow(_explode_posts, "token long, size int, sig long")
    in_lists = lambda p: p.repartition("token").sortWithinPartitions("token", "size", "sig")
    shared = in_lists(posts).mapInArrow(_shared_posts, "token long, size int, sig long")
    sketches = sets.select("sig", "tokens").mapInArrow(_sketches, "sig long, sketch binary")
    lists = in_lists(shared.join(sketches, "sig").select("token", "size", "sig", "sketch"))
    clusters = connected(lists.mapInArrow(_list_edges, "a long, b long"), "clusters")

    members = (sets.select("sig", "size", "tokens").join(clusters.withColumnRenamed("node", "sig"), "sig")
               .withColumnRenamed("root", "cluster").join(classes.select("sig", "copies"), "sig"))
    members = materialize(members, "cluster-sets")
    extent = (members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
              .select("cluster", F.greatest(F.ceil(F.col("n") / SETS_IN_TASK), F.ceil(F.col("t") / SHINGLES_IN_TASK)).alias("blocks")))
    dealt = (members.join(extent, "cluster")
             .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
             # every block meets every block, itself included, in one task
             .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    tasks = (dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "sig")
             .select("cluster", "i", "j", "sig", "copies", "block", "tokens"))
    links = materialize(tasks.mapInArrow(_join_clusters, _LINKS), "links")

    roots = connected(links.filter("b is not null").select("a", "b"), "components")
    degree = links.filter("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("n_links").alias("n_links"))
    known = (classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
             .withColumn("root", F.coalesce("root", "sig")).join(degree, "sig", "left"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    of_sig = materialize(known.join(smallest, "root").select(
        F.col("sig").alias("s"), "component", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "components")
    out = own.join(of_sig, F.col("sig") == F.col("s"), "left")
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), "sig")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of every component: the one of
    smallest id (a null id last).  Documents without shingles stay, repeated
    rows of one document become one."""
    linked = link_documents(docs).withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    # components of null ids have no number: their sets tell them apart
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("sig")).alias("own")]
    first = linked.filter("sig is not null").groupBy(*group).agg(F.min("place").alias("p"))
    keep = first.select("p.doc_id", "p.h").union(linked.filter("sig is null").select("doc_id", "h")).distinct()
    times = linked.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times"))
    keep = keep.join(times.withColumnsRenamed({"doc_id": "d", "h": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("t")))
    keep = materialize(keep.select("doc_id", "h", "times"), "kept-documents")
    # a row of docs as c0, c1, ...: no name of its own clashes
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("row_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("row_h"))
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_h") == F.col("h"))
    # the list is the side that a task holds: the texts meet it without a sort
    kept = rows.join(keep.filter("times = 1").hint("shuffle_hash"), same)
    if keep.filter("times > 1").limit(1).count():       # rows that the table has more than once become one
        kept = kept.unionByName(rows.join(keep.filter("times > 1"), same).dropDuplicates(["row_id", "row_h"]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
