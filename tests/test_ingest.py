"""Parser and store edge cases (FIXTURES section 2), on hand-written log folders."""

import math
import os
import tempfile
import time

import pytest

from frostline.sources import logfiles as LF
from frostline.sources import store as ST

BOM = "﻿"


def write(root, rel, text, encoding="utf-8"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return path


@pytest.fixture()
def tree():
    root = tempfile.mkdtemp(prefix="frostline-logs-")
    day = "24-09-11"
    write(root, f"{day}/CH6 T {day}.log", BOM + "\n".join([
        "11-09-24,00:00:05,0.0123",
        "11-09-24,00:00:06,",          # empty value -> NULL, row kept
        "11-09-24,00:00:07,nan",       # NaN -> NULL
        "11-09-24,00:00:08,inf",       # inf kept
        "31-02-24,00:00:09,1.0",       # bad date -> dropped
        "11-09-24,00:00:10,0.5",
        "11-09-24,00:00:10,0.7",       # repeated timestamp, last wins
        "",                            # blank line
        "11-09-24,00:00:11",           # two fields -> dropped
        "11-09-24,00:00:12,abc",       # unparsable -> NULL
    ]) + "\n")
    write(root, f"{day}/Flowmeter {day}.log", "11-09-24,00:00:05,0.4512\n11-09-24,00:00:13,1.5E-3\n")
    write(root, f"{day}/Channels {day}.log", "\n".join([
        "11-09-24,00:00:05,0,turbo1,1,scroll1,1,scroll2,0,pulsetube,1",
        "11-09-24,00:00:06,turbo1,0,scroll1,1",                       # even payload
        "11-09-24,00:00:07,0, Turbo1 ,1,turbo1,0",                    # mixed case + duplicate key (last wins)
        "11-09-24,00:00:08,0,pulsetube,x,compressor,1",               # unparsable pulsetube -> compressor
        '11-09-24,00:00:12,0,"turbo1",1,scroll1,"0"',                 # quoted fields
    ]) + "\n")
    write(root, f"{day}/Status_{day}.log", "\n".join([
        "11-09-24,00:00:06,tc400pumpstatn,1,tc400pumpstatn_2,0",       # fills turbo_1 (Channels has 0 there)
        "11-09-24,00:00:13,tc400pumpstatn,1,tc400pumpstatn_2,0",       # fills turbo_1 where Channels has none
        "11-09-24,00:00:14,x,tc400pumpstatn,1",                        # odd payload -> dropped
    ]) + "\n")
    write(root, f"{day}/maxigauge {day}.log", "\n".join([
        "11-09-24,00:00:05,CH1,P1,1,1.23e-05,0,1,CH2,P2,1,4.5e+00,0,1,",
        "11-09-24,00:00:06,CH9,P9,1,7.0,0,1,CH3,P3,1,2.0",             # unknown CH9; truncated chunk (4 items)
        "11-09-24,00:00:07,CH1,P1,1",                                  # fewer than 8 fields -> dropped
        "11-09-24,00:00:15,CH9,P9,1,7.0,0,1",                          # no known channel: timestamp kept
    ]) + "\n")
    write(root, f"{day}/Heaters {day}.log", "garbage\n")
    write(root, f"{day}/notes.log", "ignored\n")
    os.makedirs(os.path.join(root, "empty-folder"), exist_ok=True)
    write(root, "24-09-12/CH1 T 24-09-12.log", "12-09-24,00:00:01,45.0\n")
    return root


def _rows(spark, store):
    df = ST.readings(spark, store)
    return {r.ts_eastern.strftime("%d %H:%M:%S"): r.asDict() for r in df.collect()}


def test_sources_and_signature(spark, tree):
    files = LF.list_log_files(spark, tree)
    src = {r.path.rsplit("/", 1)[-1]: r for r in LF.source_folders(files, tree).collect()}
    assert set(src) == {"24-09-11", "24-09-12"}
    day = os.path.join(tree, "24-09-11")
    sizes = sum(os.path.getsize(os.path.join(day, f)) for f in os.listdir(day) if f != "notes.log")
    assert src["24-09-11"].size_bytes == sizes          # heaters counted, notes not
    assert src["24-09-11"].n_files == 6


def test_parse_and_assemble(spark, tree):
    store = tempfile.mkdtemp(prefix="frostline-store-")
    out = ST.sync_once(spark, tree, store)
    assert out["sources_seen"] == 2 and out["sources_changed"] == 2
    rows = _rows(spark, store)
    r = rows["11 00:00:05"]
    assert r["T_MXC"] == 0.0123 and r["Flow"] == 0.4512 and r["P1"] == 1.23e-05 and r["P2"] == 4.5
    assert (r["turbo_1"], r["scroll_1"], r["scroll_2"], r["pulse_tube"]) == (1.0, 1.0, 0.0, 1.0)
    assert rows["11 00:00:06"]["T_MXC"] is None and rows["11 00:00:06"]["scroll_1"] == 1.0
    assert rows["11 00:00:06"]["turbo_1"] == 0.0        # channel value wins over status
    assert rows["11 00:00:06"]["P3"] == 2.0             # truncated chunk with 4 items still parsed
    assert rows["11 00:00:07"]["T_MXC"] is None          # nan -> NULL
    assert rows["11 00:00:07"]["turbo_1"] == 0.0         # duplicate key: last wins
    assert "P1" not in rows["11 00:00:07"] or rows["11 00:00:07"]["P1"] is None
    assert math.isinf(rows["11 00:00:08"]["T_MXC"])
    assert rows["11 00:00:08"]["pulse_tube"] == 1.0      # fallback to compressor
    assert rows["11 00:00:10"]["T_MXC"] == 0.7           # repeated timestamp: last line
    assert rows["11 00:00:12"]["T_MXC"] is None          # unparsable
    assert rows["11 00:00:12"]["turbo_1"] == 1.0 and rows["11 00:00:12"]["scroll_1"] == 0.0  # quoted
    assert rows["11 00:00:13"]["Flow"] == 1.5e-3 and rows["11 00:00:13"]["turbo_1"] == 1.0  # status fill
    assert "11 00:00:14" not in rows                    # odd status payload dropped
    assert "11 00:00:15" in rows                        # gauge line without known channel
    assert "11 00:00:09" not in rows and "11 00:00:11" not in rows
    assert rows["12 00:00:01"]["T_50K"] == 45.0
    assert all(v["total_hours_pulse_tube"] is None for v in rows.values())


def test_incremental_and_idempotent(spark, tree):
    store = tempfile.mkdtemp(prefix="frostline-store-")
    ST.sync_once(spark, tree, store)
    again = ST.sync_once(spark, tree, store)
    assert again["sources_changed"] == 0
    n = again["rows_total"]
    time.sleep(1.1)
    write(tree, "24-09-12/CH1 T 24-09-12.log", "12-09-24,00:00:01,45.0\n12-09-24,00:00:02,46.0\n")  # grown
    grown = ST.sync_once(spark, tree, store)
    assert grown["sources_changed"] == 1 and grown["rows_total"] == n + 1
    time.sleep(1.1)
    write(tree, "24-09-12/CH1 T 24-09-12.log", "")                                     # rewritten empty
    emptied = ST.sync_once(spark, tree, store)
    assert emptied["sources_changed"] == 1 and emptied["rows_total"] == n - 1
    assert "12 00:00:01" not in _rows(spark, store)


def test_logs_in_root_and_missing_root(spark):
    root = tempfile.mkdtemp(prefix="frostline-rootlogs-")
    write(root, "CH6 T 24-09-11.log", "11-09-24,00:00:05,0.01\n")
    write(root, "sub/CH6 T 24-09-12.log", "12-09-24,00:00:05,0.02\n")
    src = [r.path for r in LF.source_folders(LF.list_log_files(spark, root), root).collect()]
    assert len(src) == 1 and src[0].rstrip("/").endswith(os.path.basename(root))
    chk = LF.path_check(spark, root).first()
    assert chk.logs_root_exists and chk.source_count == 1
    missing = LF.path_check(spark, root + "-nope").first()
    assert not missing.logs_root_exists and missing.source_count == 0
    with pytest.raises(FileNotFoundError):
        ST.sync_once(spark, root + "-nope", tempfile.mkdtemp())


def test_cross_source_pk_later_ingest_wins(spark):
    root = tempfile.mkdtemp(prefix="frostline-pk-")
    write(root, "a/CH6 T x.log", "11-09-24,00:00:05,0.01\n")
    write(root, "b/CH6 T x.log", "11-09-24,00:00:05,0.02\n")
    store = tempfile.mkdtemp(prefix="frostline-store-")
    ST.ingest_sources(spark, store, [(os.path.join(root, "a"), 1, 1)], batch_id="b1")
    ST.ingest_sources(spark, store, [(os.path.join(root, "b"), 1, 1)], batch_id="b2")
    rows = ST.readings(spark, store).collect()
    assert len(rows) == 1 and rows[0].T_MXC == 0.02


def test_split_csv_matches_python_csv(spark):
    import csv
    import io

    from pyspark.sql import functions as F

    from frostline.sources.logparse import split_csv
    cases = ['a,b,c', '"a,b",c', 'x,"he said ""hi""",z', 'a""b,c', '"",x', 'a,"",', '"q"', ',,',
             'a,"b""c,d",e', '11-09-24,00:00:05,0,"turbo1",1', ' a , b ']
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    got = [r.f for r in df.select(split_csv(F.col("line")).alias("f")).collect()]
    assert got == [next(csv.reader(io.StringIO(c))) for c in cases]


def test_first_pass_without_an_accepted_line(spark):
    root = tempfile.mkdtemp(prefix="frostline-none-")
    write(root, "24-09-11/Heaters 24-09-11.log", "11-09-24,00:00:05,1\n")
    store = tempfile.mkdtemp(prefix="frostline-store-")
    for _ in range(2):
        assert ST.sync_once(spark, root, store)["rows_total"] == 0
    time.sleep(1.1)
    write(root, "24-09-11/CH6 T 24-09-11.log", "11-09-24,00:00:05,0.01\n")
    assert ST.sync_once(spark, root, store)["rows_total"] == 1


def test_replaced_batches_are_not_read_and_can_be_deleted(spark):
    root, store = (tempfile.mkdtemp(prefix=f"frostline-{n}-") for n in ("grow", "store"))
    text = ""
    for i in range(3):
        text += f"11-09-24,00:00:0{i},0.0{i + 1}\n"
        write(root, "d/CH6 T x.log", text)
        assert ST.sync_once(spark, root, store, clean=i == 2)["rows_total"] == i + 1
        files = ST.readings(spark, store).inputFiles()
        assert len({f.split("batch_id=")[1].split("/")[0] for f in files if "batch_id=" in f}) == 1
        batches = [f for f in os.listdir(f"{store}/raw") if f.startswith("batch_id=")]
        assert len(batches) == (1 if i == 2 else i + 1)
        time.sleep(1.1)


def test_white_space_is_stripped_like_text(spark):
    root, store = (tempfile.mkdtemp(prefix=f"frostline-{n}-") for n in ("space", "store"))
    write(root, "d/ CH6 T x.log", "\t11-09-24 , 00:00:05 ,\t0.25 \n11-09-24,00:00:06,\x0b0x1p3\n11-09-24,00:00:07,1.5d\n")
    ST.sync_once(spark, root, store)
    assert {k: v["T_MXC"] for k, v in _rows(spark, store).items()} == {"11 00:00:05": 0.25, "11 00:00:06": None, "11 00:00:07": None}


def test_parse_stage_is_generated_code(spark, tree):
    store = tempfile.mkdtemp(prefix="frostline-store-")
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")       # a stage that does not compile is an error now
    try:
        assert ST.sync_once(spark, tree, store)["rows_total"] > 0
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_emptied_folder_and_empty_logs_are_listed(spark, tree):
    write(tree, "24-09-13/CH1 T 24-09-13.log", "")
    listed = {r.name: (r.size_bytes, r.depth) for r in LF.list_log_files(spark, tree).collect()}
    assert listed["CH1 T 24-09-13.log"] == (0, 1)
    src = {r.path.rsplit("/", 1)[-1]: r for r in LF.source_folders(LF.list_log_files(spark, tree), tree).collect()}
    assert src["24-09-13"].size_bytes == 0 and src["24-09-13"].mtime_ns == os.stat(f"{tree}/24-09-13/CH1 T 24-09-13.log").st_mtime_ns


def test_overlap_sweep_finds_exactly_the_shared_stretches(spark):
    import datetime as dt
    import random
    rng = random.Random(3)
    d = dt.date(2024, 1, 1)
    spans = [(f"s{i}", d, a, a + rng.randrange(0, 12), 1, "b") for i in range(25) for a in [rng.randrange(0, 150)]]
    spans += [("t", d, 300, 310, 1, "b"), ("u", d, 310, 320, 1, "b"), ("v", dt.date(2024, 1, 2), 300, 310, 1, "b")]
    got = {(r.day, t) for r in ST.overlaps(spark.createDataFrame(spans, ST.SPANS_SCHEMA)).collect() for t in range(r.from_us, r.to_us + 1)}
    want = {(x, t) for x in {s[1] for s in spans} for t in range(400) if sum(s[1] == x and s[2] <= t <= s[3] for s in spans) > 1}
    assert want <= got
    # at an instant that only one span covers there is never a stretch, but for the ends of one
    ends = {(s[1], t) for s in spans for t in s[2:4]}
    assert got - want <= ends


def _metrics_match(spark, store):
    from frostline.plans import queries as Q
    got = ST.store_metrics(spark, store).collect()
    want = Q.metrics(ST.readings(spark, store)).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_partials_follow_the_changed_days_alone(spark):
    root, store = (tempfile.mkdtemp(prefix=f"frostline-{n}-") for n in ("days", "store"))
    for d in (1, 2, 3, 4):
        write(root, f"24-09-0{d}/CH6 T x.log", "".join(f"0{d}-09-24,{h:02}:{m:02}:05,0.0{1 + (h + m) % 3}\n" for h in range(24) for m in (0, 20, 40)))
        write(root, f"24-09-0{d}/Channels x.log", "".join(f"0{d}-09-24,{h:02}:20:05,0,turbo1,{h % 2},scroll1,1\n" for h in range(24)))
    first = ST.sync_once(spark, root, store)
    assert first["days_refreshed"] == 4 and first["rows_total"] == 4 * 72
    _metrics_match(spark, store)
    time.sleep(1.1)
    write(root, "24-09-03/CH6 T x.log", "03-09-24,05:00:00,0.5\n03-09-24,05:30:00,0.01\n")
    files, make = [], ST._hour_partials
    ST._hour_partials = lambda rows, *a: files.append(rows.inputFiles()) or make(rows, *a)
    try:
        second = ST.sync_once(spark, root, store)
    finally:
        ST._hour_partials = make
    assert second["days_refreshed"] == 1 and second["rows_total"] == 3 * 72 + 24 + 2
    # of the raw rows only the changed day's were read, and only its current copy
    raw = [f for f in files[0] if "/raw/" in f]
    assert raw and all("day=2024-09-03" in f and second["batch_id"] in f for f in raw)
    _metrics_match(spark, store)
    assert ST.sync_once(spark, root, store)["days_refreshed"] == 0


def test_a_pass_that_died_before_its_partials_is_made_up_for(spark, tree):
    store = tempfile.mkdtemp(prefix="frostline-store-")
    ST.sync_once(spark, tree, store)
    time.sleep(1.1)
    write(tree, "24-09-12/CH1 T 24-09-12.log", "12-09-24,00:00:01,45.0\n13-09-24,00:00:02,46.0\n")
    refresh = ST.refresh_partials
    ST.refresh_partials = lambda *a: []
    try:
        ST.sync_once(spark, tree, store)        # commits the batch, makes no partials
    finally:
        ST.refresh_partials = refresh
    out = ST.sync_once(spark, tree, store)
    assert out["sources_changed"] == 0 and out["days_refreshed"] == 2
    assert out["rows_total"] == ST.readings(spark, store).count()
    _metrics_match(spark, store)


def test_vacuum_bounds_manifest_spans_and_days(spark):
    root, store = (tempfile.mkdtemp(prefix=f"frostline-{n}-") for n in ("grow", "store"))
    for i in range(4):
        write(root, "d/CH6 T x.log", "".join(f"11-09-24,00:00:0{j},0.0{j + 1}\n" for j in range(i + 1)))
        ST.sync_once(spark, root, store, clean=i == 3)
        time.sleep(1.1)
    for name in ("manifest", "spans", "partial_days"):
        rows = spark.read.parquet(f"{store}/{name}")
        assert rows.count() <= 2 and len([f for f in os.listdir(f"{store}/{name}") if f.endswith(".parquet")]) == 1
    assert len(os.listdir(f"{store}/partials")) == 1
    assert ST.sync_once(spark, root, store)["rows_total"] == 4 and ST.readings(spark, store).count() == 4
    _metrics_match(spark, store)


def test_keys_padded_with_any_white_space(spark):
    root, store = (tempfile.mkdtemp(prefix=f"frostline-{n}-") for n in ("pad", "store"))
    write(root, "d/Channels x.log", "11-09-24,00:00:05,0,\u00a0Turbo1\u2003,1, scroll1\t,\u00a01\n")
    write(root, "d/maxigauge x.log", "11-09-24,00:00:05,\u00a0ch1 ,P1,1,2.5,0,1,CH2,P2,1, 3 ,0,1,\n")
    ST.sync_once(spark, root, store)
    row = ST.readings(spark, store).first()
    assert (row.turbo_1, row.scroll_1, row.P1, row.P2) == (1.0, 1.0, 2.5, 3.0)
