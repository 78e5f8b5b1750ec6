"""Parse raw log text into wide readings rows as Spark column expressions.

Logs are read in line mode (``spark.read.text``), so a large file is split
across tasks like any text input.  Line order inside a file is recovered from
``(_metadata.file_block_start, monotonically_increasing_id())``: a file split
is read by one task, in order.  Lines are split into CSV fields (quote aware),
parsed per file kind with built-in regex/array functions, and assembled per
``(source, timestamp)`` with one conditional ``max_by`` per column: the outer
merge of per-file frames becomes a single shuffle on ``(source_file,
ts_eastern)``; no join, no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.columns import WHITE_CLASS, lenient_float, strip
from frostline.schema import READING_COLUMNS, TS
from frostline.sources.logfiles import CHANNELS_PREFIX, MAXIGAUGE_PREFIX, SIMPLE_PREFIXES, STATUS_PREFIX, stem_kind, stem_lower

PRESSURE_COLUMNS = ["P1", "P2", "P3", "P4", "P5", "P6"]
# Key names inside the channel, status and gauge logs.
CHANNEL_KEYS = {"turbo_1": "turbo1", "scroll_1": "scroll1", "scroll_2": "scroll2", "pulse_tube": "pulsetube"}
PULSE_TUBE_FALLBACK_KEY = "compressor"
STATUS_TURBO_KEY = "tc400pumpstatn"
GAUGE_CHANNELS = {"P1": "CH1", "P2": "CH2", "P3": "CH3", "P4": "CH4", "P5": "CH5", "P6": "CH6"}
# End of fixed values.

# the keys that a line of each kind is searched for, in slots
KIND_KEYS = {"channels": [*CHANNEL_KEYS.values(), PULSE_TUBE_FALLBACK_KEY], "maxigauge": list(GAUGE_CHANNELS.values()),
             "status": [STATUS_TURBO_KEY]}
SLOTS = max(map(len, KIND_KEYS.values()))
_CSV_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
VALUE_COLUMNS = [c for c in READING_COLUMNS[1:-1] if not c.startswith("total_hours_")]


def parse_ts(d: Column, t: Column) -> Column:
    """L1: ``dd-mm-yy`` + ``HH:MM:SS`` (one-digit fields allowed) -> TIMESTAMP_NTZ.

    Invalid dates give NULL (the row is dropped).  Two-digit years pivot like
    C ``strptime``: 69-99 -> 19xx, 00-68 -> 20xx.
    """
    d, t = strip(d), strip(t)
    dparts = F.split(d, "-")
    tparts = F.split(t, ":")
    ok = d.rlike(r"^\d{1,2}-\d{1,2}-\d{1,2}$") & t.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$")
    yy = dparts.getItem(2).cast("int")
    year = F.when(yy < 69, yy + 2000).otherwise(yy + 1900)
    ts = F.try_make_timestamp_ntz(year, dparts.getItem(1).cast("int"), dparts.getItem(0).cast("int"),
                                  tparts.getItem(0).cast("int"), tparts.getItem(1).cast("int"),
                                  tparts.getItem(2).cast("int"))
    return F.when(ok, ts)


def split_csv(line: Column) -> Column:
    """Quote-aware field split; surrounding quotes removed, ``""`` -> ``"``.

    Lines without a quote (the normal case) take a plain split.  Quoted lines
    use regex rewrites only (no higher-order function, so the stage stays in
    generated code): commas outside quotes become NUL, quoted fields are
    bracketed with SOH marks, doubled quotes are unescaped inside marked fields
    only, the marks are dropped, and the line is split on NUL.
    """
    seps = F.regexp_replace(line, _CSV_SPLIT, "\u0000")
    marked = F.regexp_replace(seps, r'(^|\x00)"((?:[^"]|"")*)"(?=\x00|$)', "$1\u0001$2\u0001")
    unescaped = F.regexp_replace(marked, r'""(?=[^\x00\x01]*\x01)', '"')
    quoted = F.split(F.regexp_replace(unescaped, r"\x01", ""), "\u0000", -1)
    return F.when(F.instr(line, '"') == 0, F.split(line, ",", -1)).otherwise(quoted)


# NUL never occurs inside an accepted line (the source system's CSV reader
# rejects it), so it is a safe separator for re-joined fields.
_SEP = "\u0000"
# one match = one (key, value) pair, consumed from the start: alignment is kept
_PAIR = r"([^\x00]*)\x00([^\x00]*)(?:\x00|$)"
# one match = one gauge chunk of 4 to 6 items: channel (item 0) and value (item 3)
_CHUNK = (r"([^\x00]*)\x00[^\x00]*\x00[^\x00]*\x00([^\x00]*)"
          r"(?:\x00[^\x00]*)?(?:\x00[^\x00]*)?(?:\x00|$)")


def _first_of(keys: Column, vals: Column, key: Column) -> Column:
    """Raw value of the first occurrence of ``key``; NULL if absent."""
    pos = F.array_position(keys, key).cast("int")
    return F.when(pos > 0, F.element_at(vals, pos))


def file_lines(lines: DataFrame) -> DataFrame:
    """``(path, name, parent, kind, _blk, f)``: blank lines dropped,
    fields split (the text reader already strips a leading BOM and CR/LF)."""
    return lines.filter(F.col("line") != "").select("path", "name", "parent", "kind", "_blk",
                                                   split_csv(F.col("line")).alias("f"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """One output row per accepted line with its values in slots (which
    slot is which column depends on the kind, see ``_slot``).

    Per line, only for its own kind, the key and value arrays are extracted
    once (own projection), then each wanted key is looked up; no higher-order
    functions, and few number parsers, so the whole stage is generated code
    (a test runs it with the fall-back to interpretation switched off).
    """
    kind, simple_cols = F.col("kind"), list(SIMPLE_PREFIXES.values())
    line = ["path", "name", "parent", "kind", "_blk", "line_no"]
    is_simple, is_ch, is_st, is_ga = kind.isin(simple_cols), kind == "channels", kind == "status", kind == "maxigauge"
    # one projection per step: an expression used twice is computed once
    f, n = F.col("f"), F.col("_n")
    # the line number is drawn here: a filter is not pushed (and its inputs are
    # not computed twice) below a projection that is not deterministic
    head = lines.select(*line[:-1], F.monotonically_increasing_id().alias("line_no"), F.size("f").alias("_n"), parse_ts(F.element_at("f", 1), F.element_at("f", 2)).alias(TS), "f")
    min_width = F.when(is_simple, 3).when(is_ch | is_st, 4).when(is_ga, 8)
    items = head.filter((n >= min_width) & F.col(TS).isNotNull() & (~is_st | (n % 2 == 0))).select(
        *line, TS, F.when(is_simple, F.element_at(f, 3)).alias("_v"),
        # L4 channels: an odd payload drops its first item
        F.when(is_ch & (n % 2 == 1), F.slice(f, 4, n - 3)).when(~is_simple, F.slice(f, 3, n - 2)).alias("_items"))
    # white space around a field goes, in the few lines that have any
    joined = items.select(*line, TS, "_v", F.array_join("_items", _SEP).alias("_j"))
    j = F.col("_j")
    some = (F.octet_length(j) != F.length(j)) | j.rlike(r"[\x09-\x0d\x1c-\x20]")       # the full class is slow to look for
    tight = F.when(some, strip(F.regexp_replace(j, f"{WHITE_CLASS}*\\x00{WHITE_CLASS}*", _SEP))).otherwise(j)
    tightened = joined.select(*line, TS, "_v", tight.alias("_j"))
    texts = tightened.select(*line, TS, "_v", F.when(is_ga, F.upper("_j")).otherwise(F.lower("_j")).alias("_text"))
    part = lambda g: F.reverse(F.when(is_ga, F.regexp_extract_all("_text", F.lit(_CHUNK), g))
                               .otherwise(F.regexp_extract_all("_text", F.lit(_PAIR), g)))
    # turned around: of a key that occurs twice the last one holds
    staged = texts.select(*line, TS, "_v", part(1).alias("_k"), part(2).alias("_kv"))

    # a line has values for its own kind only: they go to shared slots as raw
    # text, so every number is parsed by one expression per slot
    raw = []
    for i in range(SLOTS):
        key = None
        for name, wanted in KIND_KEYS.items():
            if i < len(wanted):
                key = F.when(kind == name, wanted[i]) if key is None else key.when(kind == name, wanted[i])
        slot = _first_of(F.col("_k"), F.col("_kv"), key)
        raw.append((F.when(is_simple, F.col("_v")).otherwise(slot) if i == 0 else slot).alias(f"_r{i}"))
    return staged.select(*line, TS, *raw).select(*line, TS, *[lenient_float(f"_r{i}").alias(f"_s{i}") for i in range(SLOTS)])


def _slot(c: str) -> tuple[str, Column]:
    """(kind, value) of a target column in the parsed rows."""
    if c in SIMPLE_PREFIXES.values():
        return c, F.col("_s0")
    for name, wanted in (("channels", CHANNEL_KEYS), ("maxigauge", GAUGE_CHANNELS)):
        if c in wanted:
            value = F.col(f"_s{KIND_KEYS[name].index(wanted[c])}")
            if c == "pulse_tube":   # the fallback is decided on the parsed value before NaN -> NULL
                value = F.coalesce(value, F.col(f"_s{KIND_KEYS[name].index(PULSE_TUBE_FALLBACK_KEY)}"))
            return name, value
    return "status", F.col("_s0")


def assemble(parsed: DataFrame) -> DataFrame:
    """L7 + L8: per ``(source, ts)`` the last line of each file kind wins per
    column (NULL values included, files in name order, then line order);
    ``turbo_1`` falls back to the status log; NaN -> NULL; fixed column order.
    """
    order = F.struct("name", "_blk", "line_no")

    def last(c):
        kind, value = _slot(c)
        return F.max_by(value, F.when(F.col("kind") == kind, order)).alias(c)

    wide = parsed.groupBy(F.col("parent").alias("source_file"), TS) \
        .agg(*[last(c) for c in VALUE_COLUMNS], last("turbo_1_status"))

    def nn(c):
        x = F.col(c)
        return F.when(~F.isnan(x), x)

    cols = []
    for c in READING_COLUMNS:
        if c == TS or c == "source_file":
            cols.append(F.col(c))
        elif c.startswith("total_hours_"):
            cols.append(F.lit(None).cast("double").alias(c))
        elif c == "turbo_1":
            cols.append(F.coalesce(nn("turbo_1"), nn("turbo_1_status")).alias(c))
        else:
            cols.append(nn(c).alias(c))
    return wide.select(*cols)


def wanted_files() -> str:
    """Glob of the log files that are parsed: their prefixes in any case (other
    logs of a folder are not read at all)."""
    prefixes = [*SIMPLE_PREFIXES, CHANNELS_PREFIX, MAXIGAUGE_PREFIX, STATUS_PREFIX]
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in p.rstrip()) for p in prefixes]
    return "*{" + ",".join(any_case) + "}*.log"


def read_source_lines(spark: SparkSession, source_paths: list[str]) -> DataFrame:
    """Lines of the ``*.log`` files directly inside each source folder.

    ``_metadata.file_path`` is percent-encoded; ``+`` is protected before
    decoding so that it does not turn into a space.
    """
    df = spark.read.option("pathGlobFilter", wanted_files()).text(source_paths)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # one step per column: what a later one uses several times is worked out once a line
    lines = df.select(path.alias("path"), F.col("_metadata.file_block_start").alias("_blk"),
                      F.col("value").alias("line"))
    named = lines.select("*", F.substring_index("path", "/", -1).alias("name"))
    parent = F.substr("path", F.lit(1), F.length("path") - F.length("name") - 1)
    stems = named.select("path", "name", parent.alias("parent"), "_blk", "line", stem_lower(F.col("name")).alias("_stem"))
    return stems.select("path", "name", "parent", "_blk", "line", stem_kind(F.col("_stem")).alias("kind"))


def build_readings(spark: SparkSession, source_paths: list[str]) -> DataFrame:
    """L7 for many sources in one job: lines -> parsed -> wide rows."""
    lines = read_source_lines(spark, source_paths).filter(F.col("kind").isNotNull())
    return assemble(parse_lines(file_lines(lines)))
