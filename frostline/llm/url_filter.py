"""URL allow/block rules by a sort-merge range join.

A host is turned around, label by label (``www.example.com`` becomes
``com.example.www.``), so that a host and all its subdomains share a prefix
and a rule becomes an interval of keys.  URLs are dealt out by ranges of this
key, every rule goes to each range its interval meets, and one sorted sweep
per range keeps the rules whose interval is still open on a stack: the rules
on the stack are nested, and each URL asks them for the path.

The keys of URLs end in a number drawn from the row, so a host with a third of
all pages is spread over many ranges.

Defined cases: a null URL or one without ``://`` has an empty host and path
and meets no rule; repeated rows give repeated results; a null page_id is kept;
a rule with a null host or path is ignored; of rules equal in host and path
``block`` wins; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import ascii_lower

RULES = [  # (host, path, action)
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"
SAMPLE = 10_000         # keys sampled to cut the ranges, about so many
_SEP = "\x00"

_OUT = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url):
    """Columns (host, path) of a URL column."""
    rest = F.regexp_extract(url, r"^(?s).*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host):
    """``a.b.c`` -> ``c.b.a.``; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _sweep(default: str):
    """Sorted events of a range (rules before the URLs they cover) -> verdicts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []       # (key prefix, [(path, host, action)]) of open rules
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("part", "key", "is_url", "page_id", "host", "path", "action")]
            for pid, key, is_url, page_id, host, path, action in zip(*cols, strict=True):
                if pid != part:
                    part, stack = pid, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, host, action))
                    continue
                best = None
                for _, rules in stack:
                    for rule_path, rule_host, act in rules:
                        if path.startswith(rule_path):
                            rank = (len(rule_host) + len(rule_path), len(rule_host), act == "block")
                            if best is None or rank > best[0]:
                                best = (rank, rule_host + rule_path, act)
                out.append((page_id, host, path, best and best[1], best[2] if best else default))
            if out:
                kinds = [pa.int64()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["page_id", "host", "path", "rule", "verdict"])
    return run


def apply_rules(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]] = RULES,
                default: str = DEFAULT_VERDICT, ranges: int | None = None) -> DataFrame:
    """Judge ``pages(page_id, url)``; ``rules`` has (host, path, action)."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, action string")
    host, path = host_and_path(F.col("url").cast("string"))
    urls = (pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumn("key", F.concat(reversed_key(F.col("host")), F.lit(_SEP),
                                        F.hex(F.xxhash64("path", "page_id")))))
    # the cuts between the ranges: about SAMPLE keys, drawn by the row's hash,
    # however many tasks there are
    share = min(1.0, SAMPLE / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = sorted(r.key for r in urls.filter(drawn).select("key").collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    @F.udf("int", useArrow=True)
    def place(key: str) -> int:
        return bisect_right(cuts, key)

    @F.udf("array<int>", useArrow=True)
    def places(key: str) -> list[int]:
        # the interval [key, key with its last character raised by one)
        return list(range(bisect_right(cuts, key), bisect_right(cuts, key[:-1] + chr(ord(key[-1]) + 1)) + 1))

    own = urls.select(place("key").alias("part"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path",
                      F.lit(None).cast("string").alias("action"))
    opened = (rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull())
              .select(ascii_lower(F.col("host")).alias("host"), "path", "action")
              .withColumn("key", reversed_key(F.col("host")))
              .select(F.explode(places("key")).alias("part"), "key", F.lit(False).alias("is_url"),
                      F.lit(None).cast("long").alias("page_id"), "host", "path", "action"))
    events = own.unionByName(opened).repartition(ranges, "part").sortWithinPartitions("part", "key", "is_url")
    return events.mapInArrow(_sweep(default), _OUT)
