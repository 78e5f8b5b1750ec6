"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are compared: the target model from
the labelled good documents (``quality = 1`` and not toxic), the raw model from
all documents.  A document's importance weight is the ratio of the two, raised
to ``SHARPNESS``; the weights' logarithms plus Gumbel noise are sorted and the
top k are kept, which samples k documents in proportion to their weights without
replacement.

n-grams: words (lower case, without the punctuation around them), the
punctuation around a word, upper-case words, pairs of adjacent words, and a word
followed by itself once or ``RUN`` times; each is counted once a document.  An n-gram carries weight
only if its target count is off the expected one by more than chance
(``Z`` standard deviations); the expected share is the median ratio, so ordinary
words weigh nothing however much junk the raw text holds.

``k`` follows from the corpus: it is the number of documents whose log weight is
not under a cut.  The cut is the one that parts the labelled rows best: the share
of bad ones under it less ``CLEAN_COST`` times the share of good ones.

The labelled rows are a bounded sample: the ``MAX_LABELLED`` rows of lowest
hash.  Counts, weights, k and the selection are over all documents.

Defined cases: a null or empty text has no n-grams and log weight 0; ids may be
null (then unlabelled) or repeated; of several labels of an id the worst holds;
null labels are no labels; without labels every document is kept; an empty table
gives an empty result; other columns are ignored by ``score`` and passed through
by ``keep_sampled``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm.common import TEXTS, batches_of, claim, materialize

BUCKETS = 1 << 19       # of both tables together
MAX_LABELLED = 200_000
SMOOTHING = 0.5
Z = 4.0
SHARPNESS = 8.0
CLEAN_COST = 3.0
CUTS = 4, 80        # cuts tried: so many per unit, and so many in all, from -1/2 down
WORDS_KEPT = 400_000
RUN = 6
_PARTS = 16
CLASSES = 1024      # classes of keys counted at a time when the k-th largest is looked for
SORTED = 100_000    # ... until a class has no more rows
ROWS = 1_000        # documents scored at a time in a task


class _Words(dict):
    """word -> core hash (high half) and hash of the punctuation around it."""

    def __missing__(self, word: str) -> int:
        import xxhash
        low = word.lower()
        core = low.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        around = low.replace(core, " ", 1) if core else low
        shout = "^" if len(core) > 1 and word.upper() == word and word != low else ""
        h = xxhash.xxh32_intdigest(core) << 32 | (xxhash.xxh32_intdigest(around[:16] + shout) if around != " " or shout else 0)
        if len(self) < WORDS_KEPT and len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()


def features(text: str | None) -> np.ndarray:
    """The buckets of a text's distinct n-grams, a column for each; the two rows
    are two hashings into tables of their own."""
    words = text.split() if text else []
    if not words:
        return np.zeros((2, 0), np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    core, around = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    around = around[around > 0]
    pair = core[:-1] * np.uint64(0x9E3779B97F4A7C15) + core[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    # a word after itself, and a run of RUN equal words, whatever the word
    same = core[:-1] == core[1:]
    pair[same] = np.uint64(0x165667B19E3779F9)
    run = np.cumsum(np.concatenate([[0], same]))
    run = np.full(int((run[RUN - 1:] - run[:1 - RUN] == RUN - 1).any()), 0x27D4EB2F165667C5, np.uint64)
    grams = np.unique(np.concatenate([core * np.uint64(0x9E3779B97F4A7C15), run, pair,
                                      (around + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)]))
    mixed = (grams ^ grams >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64(BUCKETS // 2 - 1)
    return np.stack([mixed >> np.uint64(40) & mask, (mixed >> np.uint64(20) & mask) + np.uint64(BUCKETS // 2)]).astype(np.int64)


def weight(ratios: np.ndarray, f: np.ndarray) -> float:
    """Log weight of a text: of an n-gram's two ratios the one nearer to 0, so
    a rare n-gram that shares one bucket with a telling one weighs nothing."""
    a, b = ratios[f[0]], ratios[f[1]]
    return float(np.where(np.abs(a) < np.abs(b), a, b).sum(dtype=np.float64))


def bounded_labels(labels: DataFrame) -> DataFrame:
    """(label_id, good): at most ``MAX_LABELLED`` rows, one per id."""
    one = (labels.filter("doc_id is not null and quality is not null")
           .groupBy(F.col("doc_id").cast("long").alias("label_id"))
           .agg((F.min("quality") > 0).alias("fine"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    return (one.select("label_id", (F.col("fine") & (F.col("toxic") == 0)).alias("good"))
            .orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED))


def counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Document counts of every bucket, over all documents and over the
    labelled good ones.  What reaches the driver is two vectors of fixed size."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_WORDS)
        raw, target = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                f = features(text.as_py())
                raw[f] += 1
                if good:
                    target[f] += 1
        if raw.any():
            yield _parts(raw, target)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # a task's own counts are 32-bit, sums are 64-bit
                two = np.stack([np.frombuffer(r, np.int32), np.frombuffer(t, np.int32)]).astype(np.int64)
                total[part] = total[part] + two if part in total else two
        if total:
            yield _batch([(p, v[0].tobytes(), v[1].tobytes()) for p, v in total.items()])

    kind = "part int, raw binary, target binary"
    # at most MAX_LABELLED pairs of a long and a flag: a few MB
    known = (docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
             .join(F.broadcast(labels), F.col("doc_id") == F.col("label_id"), "left"))
    parts = known.select("text", "good").mapInArrow(local, kind).repartition(_PARTS, "part").mapInArrow(add, kind)
    with batches_of(docs.sparkSession, TEXTS):
        parts = parts.collect()
    raw, target = np.zeros((_PARTS, BUCKETS // _PARTS), np.int64), np.zeros((_PARTS, BUCKETS // _PARTS), np.int64)
    for r in parts:
        raw[r.part], target[r.part] = np.frombuffer(r.raw, np.int64), np.frombuffer(r.target, np.int64)
    return raw.ravel(), target.ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                      names=["part", "raw", "target"])


def _parts(raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    return _batch([(i, a.tobytes(), b.tobytes()) for i, (a, b) in enumerate(zip(np.split(raw, _PARTS), np.split(target, _PARTS), strict=True))])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target model / raw model) of every bucket."""
    seen = raw >= max(20, np.quantile(raw[raw > 0], 0.5)) if raw.any() else np.zeros(len(raw), bool)
    if not target.any() or not seen.any():
        return np.zeros(len(raw), np.float32)
    ratio, weight = target[seen] / raw[seen], raw[seen]
    order = np.argsort(ratio)
    share = ratio[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)]
    expected = share * raw
    z = (target - expected) / np.sqrt(expected + SMOOTHING)
    return np.where(np.abs(z) > Z, np.log((target + SMOOTHING) / (expected + SMOOTHING)), 0.0).astype(np.float32)


def gumbel(seed: int):
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "h"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def _scored(docs: DataFrame, labels: DataFrame, seed: int, carried: bool) -> tuple[DataFrame, DataFrame, float]:
    """(scored rows, labels, cut).  A scored row has doc_id, h (hash of the text),
    n_features, log_weight, key and row (a number of its own), and with
    ``carried`` all columns of ``docs``, as c0, c1, ..."""
    known = materialize(bounded_labels(labels), "labels")
    raw, target = counts(docs, known)
    model = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target))
    text, own = F.col("text").cast("string"), [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)] if carried else []
    given = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), *([] if carried else [text.alias("text")]))
    at = docs.columns.index("text") if carried else 2
    kept = [i for i, c in enumerate(given.columns) if carried or c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_WORDS)
        names = [given_names[i] for i in kept] + ["n_features", "log_weight"]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                f = [features(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in kept), pa.array([x.shape[1] for x in f], pa.int64()),
                     pa.array([weight(model.value, x) for x in f], pa.float64())], names=names)

    given_names = given.columns
    schema = T.StructType([given.schema.fields[i] for i in kept]).add("n_features", "long").add("log_weight", "double")
    rows = given.mapInArrow(run, schema).withColumn("key", SHARPNESS * F.col("log_weight") + gumbel(seed)).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "weights", batch=TEXTS)
    cut = best_cut(rows.select("doc_id", "log_weight").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")))
    model.unpersist()
    return rows, known, cut


def score(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, h (hash of the text), n_features, log_weight, key, kept."""
    rows, _, cut = _scored(docs, labels, seed, carried=False)
    return _top_k(rows, rows.filter(F.col("log_weight") >= F.lit(float(cut))).count()).drop("row")


def best_cut(labelled: DataFrame) -> float:
    """The cut that parts good from bad best (minus infinity if none does)."""
    per, n = CUTS
    at = F.greatest(F.floor(F.col("log_weight") * per), F.lit(-n - 2))
    count = np.zeros((2, n))
    every = np.zeros(2)
    for r in labelled.groupBy("good", F.least(at, F.lit(0)).alias("at")).count().collect():     # at most 2 * (n + 3) rows
        every[int(r.good)] += r["count"]
        # log_weight < -(i + 2) / per holds for the cuts i below -at - 2
        count[int(r.good), :max(0, min(n, -r["at"] - 2))] += r["count"]
    if not every.all():
        return -np.inf
    gain = count[0] / every[0] - CLEAN_COST * count[1] / every[1]
    return float(-(gain.argmax() + 2) / per) if gain.max() > 0 else -np.inf


def _top_k(scored: DataFrame, k: int) -> DataFrame:
    """Mark the k rows of largest key; ties go by doc_id (nulls first), h and row.
    The k-th key is closed in by counts of ``CLASSES`` classes of keys, again and
    again inside the class that holds it, until that is small enough to sort."""
    if "row" not in scored.columns:
        scored = scored.withColumn("row", F.lit(0).cast("long"))
    total, low, high = scored.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if k <= 0 or k >= total:
        return scored.withColumn("kept", F.lit(k > 0))
    inside, left = scored, k
    while low < high and inside.count() > SORTED:
        width = (high - low) / CLASSES
        cls = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(CLASSES - 1))
        sizes = dict(inside.groupBy(cls.alias("c")).count().collect())     # at most CLASSES rows
        for c in sorted(sizes, reverse=True):
            if sizes[c] >= left:
                break
            left -= sizes[c]
        inside = inside.filter(cls == c)
        was = low, high
        low, high = inside.agg(F.min("key"), F.max("key")).first()
        if (low, high) == was:
            break
    tie = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "h", "row")
    last = inside.select("key", tie.alias("tie")).orderBy(F.desc("key"), "tie").offset(left - 1).limit(1).first()
    cut = F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip(("d", "h", "row"), last.tie, strict=True)])
    key = F.lit(float(last.key))
    return scored.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & (tie <= cut)))


def keep_sampled(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, all columns as they were.
    The rows carry their key through one written table, so no text is shuffled and
    every repeated row is a row of its own."""
    rows, _, cut = _scored(docs, labels, seed, carried=True)
    marked = _top_k(rows, rows.filter(F.col("log_weight") >= F.lit(float(cut))).count())
    return marked.filter("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
