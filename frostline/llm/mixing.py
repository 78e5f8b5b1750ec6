"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words: the total budget is shared by weight,
a source takes at most ``max_epochs`` times its own size, and what is over goes
to the others by weight, until none is above.  Whole epochs of a source come
first; the rest is a weighted sample without replacement: every document draws
the exponential key ``-ln(u) / weight`` (``u`` is drawn from its id and text, so
reruns agree), the documents are taken in the order of their keys, and the
prefix sum of their sizes is cut where it comes nearest to the rest.  One more
document, the one whose size is nearest to what is still missing, tops it up.

The order is never built for a whole source: keys fall into ``BUCKETS`` classes,
class totals (aggregated before the shuffle) tell which class holds the cut, and
only that class is sorted.

Defined cases: a null text has size 0 and weight 1; documents without words are
taken by no one (taken 0); a null source is a source of its own, last in order;
repeated rows are documents of their own; an empty table gives an empty result;
other columns are ignored by ``mix`` and passed through by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import WORD_PATTERN, materialize

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MAX_EPOCHS = 2
BUCKETS = 4096
_SYMBOLS = "#*$%&|<>"


def quality_weight(text, size):
    """Sampling weight in (0, 1]: fewer symbols a word, more weight."""
    symbols = F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))
    return F.coalesce(size / (size + symbols), F.lit(1.0))


def drawn_key(seed: int, weight):
    """Exponential key of a document, from its id and text."""
    # 53 bits of the hash; never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, key, bucket, h) of every document."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.col("text").cast("string").alias("text"))
    d = d.withColumn("size", n)
    key = drawn_key(seed, quality_weight(F.col("text"), F.col("size")))
    return (d.withColumn("key", F.when(F.col("size") > 0, key).otherwise(F.lit(0.0)))
            .select("doc_id", "source", "size", "key",
                    # a class grows with the key
                    F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("bucket"),
                    F.xxhash64("text").alias("h")))


def targets(source_sizes: list[tuple[str | None, int]], weights=WEIGHTS, total_percent: int = TOTAL_PERCENT,
            max_epochs: int = MAX_EPOCHS) -> list[tuple[str | None, int, float]]:
    """(source, size, target), by filling up: sources at their ceiling leave
    their excess to the others, by weight."""
    rows = sorted(source_sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(rows))]
    total = sum(s for _, s in rows) * total_percent / 100
    full: set[int] = set()
    while True:
        rest = total - sum(max_epochs * rows[i][1] for i in full)
        free = sum(weight[i] for i in range(len(rows)) if i not in full)
        share = [float(max_epochs * rows[i][1]) if i in full else rest * weight[i] / free for i in range(len(rows))]
        above = {i for i in range(len(rows)) if i not in full and share[i] > max_epochs * rows[i][1]}
        if not above:
            return [(s, n, t) for (s, n), t in zip(rows, share, strict=True)]
        full |= above


def mix(docs: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS,
        seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, h (hash of its text), key, size, source_size,
    target and whole (target and whole epochs of its source), sampled and is_top
    (why it is in the rest), epochs (how often the mix takes it), taken."""
    spark = docs.sparkSession
    d = materialize(sizes(docs, seed), "mix-sizes")
    classes = materialize(d.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-classes")
    # one row per source: the list of sources that a mix names is short by nature
    per_source = targets([(r.source, r.size) for r in classes.groupBy("source").agg(F.sum("size").alias("size")).collect()],
                         weights, total_percent, max_epochs)
    plan = spark.createDataFrame(
        [(s, n, t, int(t // n) if n else 0, int(round(t - (t // n) * n)) if n else 0) for s, n, t in per_source],
        "source string, source_size long, target double, whole long, rest long")
    # the class that holds the cut of its source
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = classes.withColumn("end", F.sum("size").over(upto))
    cut = (running.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
           .filter((F.col("end") - F.col("size") < F.col("rest")) & (F.col("end") >= F.col("rest")))
           .select("source", F.col("bucket").alias("cut"), (F.col("end") - F.col("size")).alias("base")))
    known = (plan.join(cut.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left").drop("c")
             .fillna({"cut": -1, "base": 0}))
    known = materialize(known, "mix-plan").withColumnRenamed("source", "s")

    rows = d.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = rows.filter("bucket = cut")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "h")
    end = F.col("base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # nearest cut: a document is in when more than half of it lies below the rest
    inside = (inside.withColumn("end", end)
              .withColumn("sampled", (2 * F.col("end") - F.col("size") < 2 * F.col("rest")) & (F.col("size") > 0)))
    outside = rows.filter("bucket <> cut").withColumn("sampled", (F.col("bucket") < F.col("cut")) & (F.col("size") > 0))
    chosen = materialize(inside.drop("end").unionByName(outside).drop("base", "cut", "bucket"), "mix-chosen")

    # top up with the document whose size is nearest to what is missing
    got = (chosen.groupBy("source").agg(F.sum(F.when(F.col("sampled"), F.col("size")).otherwise(0)).alias("got"))
           .withColumnRenamed("source", "g"))
    missing = materialize(known.join(got, F.col("s").eqNullSafe(F.col("g")))
                          .select("s", (F.col("rest") - F.col("got")).alias("missing")).filter("missing > 0"), "mix-missing")
    nearest = (chosen.filter("not sampled and size > 0").join(missing, F.col("source").eqNullSafe(F.col("s")))
               .withColumn("off", F.abs(F.col("size") - F.col("missing")))
               .filter(F.col("off") < F.col("missing"))
               .groupBy("source").agg(F.min(F.struct("off", "key", "doc_id", "h")).alias("m"))
               .select(F.col("source").alias("t_source"), F.col("m.key").alias("t_key"),
                       F.col("m.doc_id").alias("t_doc"), F.col("m.h").alias("t_h")))
    out = chosen.join(materialize(nearest, "mix-top-up"), F.col("source").eqNullSafe(F.col("t_source")), "left")
    same = ((F.col("key") == F.col("t_key")) & F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("h") == F.col("t_h")))
    # of identical repeated rows just one may top up: they share an order, the first is it
    out = out.withColumn("is_top", F.coalesce(same & ~F.col("sampled"), F.lit(False)))
    tops = out.filter("is_top").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("key")))
    tops = tops.withColumn("is_top", F.col("n") == 1).drop("n")
    out = out.filter("not is_top").unionByName(tops)
    epochs = F.when(F.col("size") > 0, F.col("whole") + (F.col("sampled") | F.col("is_top")).cast("long")).otherwise(F.lit(0))
    return out.select("doc_id", "source", "h", "key", "size", "source_size", "target", "whole", "sampled", "is_top",
                      epochs.cast("long").alias("epochs"), (epochs * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they
    were.  A document's part follows from its own key and its source's cut, so
    the texts are not joined by id."""
    seed = options.get("seed", 0)
    place = F.struct("key", "doc_id", "h")
    cuts = mix(docs, **options).groupBy("source").agg(
        F.first("whole").alias("__whole"), F.max(F.when(F.col("sampled"), place)).alias("__cut"),
        F.max(F.when(F.col("is_top"), place)).alias("__top")).withColumnRenamed("source", "__source")
    cuts = materialize(cuts, "mix-cuts")
    text = F.col("text").cast("string")
    n = F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    own = docs.withColumn("__size", n)
    own = own.withColumn("__at", F.struct(
        F.when(F.col("__size") > 0, drawn_key(seed, quality_weight(text, F.col("__size")))).otherwise(F.lit(0.0)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h")))
    own = own.join(cuts, F.col("source").cast("string").eqNullSafe(F.col("__source")))
    extra = F.coalesce((F.col("__at") <= F.col("__cut")) | (F.col("__at") == F.col("__top")), F.col("__at") == F.col("__top"),
                       F.col("__at") <= F.col("__cut"), F.lit(False)).cast("long")
    times = F.when(F.col("__size") > 0, F.col("__whole") + extra).otherwise(F.lit(0))
    return (own.withColumn("__times", times.cast("int")).filter("__times > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns))
