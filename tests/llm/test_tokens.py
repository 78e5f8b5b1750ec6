"""Token ids, counts, packing and token files against the tokenizers library."""
import random
import zlib
from array import array
from collections import defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frostline.llm import bpe_ids, common, jaccard, packing, token_count, token_files
from frostline.llm.bpe_ids import IdEncoder
from frostline.session import scratch_path

BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENC, COUNT = IdEncoder("byte_bpe_50k.json"), token_count.TokenCounter("word_bpe_49k.json")
BATCH = bpe_ids.BatchEncoder("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  x", "a<|endoftext|>b", "<|startoftext|><|endoftext|> it's", "ΣΑΣ ΟΔΟΣ", "İx e\u0301 \u1e9b\u0323", "\x1cq\x85r\xa0s\u2003t\u3000",
       "don't DON'T 'll x'll 12345 ½ \u0660", "日本語 テキスト", "a\u0301\u0301 \U0001f600\u200d\U0001f525", "x" * 3000, " \t \n", "tab\tsep\r\n\x0b\x0c", "it 's"]


def lib_ids(text):
    return BYTE.encode(text, add_special_tokens=False).ids


def test_ids_and_counts_equal_library_on_documents(sf001_docs):
    for r in sf001_docs.select("text").collect():
        assert array("I", ENC.encode(r.text)).tolist() == lib_ids(r.text)
        assert COUNT.count(r.text) == len(WORD.encode(r.text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert array("I", ENC.encode(text)).tolist() == lib_ids(text)
    assert COUNT.count(text) == len(WORD.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stΣé<|>")), max_size=60))
def test_any_text(text):
    assert array("I", ENC.encode(text)).tolist() == lib_ids(text)
    assert COUNT.count(text) == len(WORD.encode(text, add_special_tokens=False).ids)


def test_count_tokens_edge_rows(make_docs):
    got = {r.doc_id: r for r in token_count.count_tokens(make_docs([(1, None), (2, ""), (None, "a b"), (3, "w " * 3000)])).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[2].n_tokens, got[None].n_tokens) == (0, 0, 0, 2)
    assert got[3].n_tokens == 3000 and got[3].over_limit and not got[1].over_limit
    assert token_count.count_tokens(make_docs([]).limit(0)).count() == 0


def naive_merges(symbols, ranks):
    """Scan for the lowest rank again and again."""
    done = 0
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
        if best is None:
            return done
        i = best[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        done += 1


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.permutations([("a", "b"), ("b", "c"), ("a", "a"), ("ab", "c"), ("aa", "b"), ("c", "c"), ("ab", "ab")]))
def test_heap_merging_equals_scanning(word, order):
    ranks = {p: i for i, p in enumerate(order)}
    assert token_count.merges_done(list(word), ranks) == naive_merges(list(word), ranks)


def check_packing(rows, docs, capacity=1024):
    want = {}
    for doc_id, text in docs:
        ids = [*lib_ids(text or ""), 2]
        cuts = [(0, len(ids))] if len(ids) <= capacity else []
        if not cuts:
            first = len(ids) % capacity or capacity
            cuts = [(0, first)] + [(s, capacity) for s in range(first, len(ids), capacity)]
        for piece, (s, n) in enumerate(cuts):
            want.setdefault((doc_id, piece, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())), 0)
            want[doc_id, piece, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), sum(n for b in bins.values() for _, n in b)


def test_packing_sf001(sf001_docs):
    rows = packing.pack_documents(sf001_docs).collect()
    bins, total = check_packing(rows, [(r.doc_id, r.text) for r in sf001_docs.collect()])
    assert bins <= 1.01 * total / 1024 + 1


def test_packing_edges(make_docs):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 5000), (3, "word " * 5000), (4, "x y z")]
    check_packing(packing.pack_documents(make_docs(rows)).collect(), rows)
    assert packing.pack_documents(make_docs([]).limit(0)).count() == 0


def test_worker_drops_what_other_operators_left():
    words = {"a": 1}
    common.claim(words)
    enc = bpe_ids.encoder("byte_bpe_50k.json")
    assert not words and bpe_ids.encoder("byte_bpe_50k.json") is enc
    common.claim({})
    assert not bpe_ids._ENCODERS


def test_texts_reach_tasks_in_bounded_batches(spark, make_docs, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield b.from_arrays([[b.num_rows]], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), {}
    n = [r.n for r in common.materialize(spark.range(0, 5000, numPartitions=1).mapInArrow(sizes, "n long"), "batches", batch=700).collect()]
    assert sum(n) == 5000 and max(n) == 700 and spark.conf.get(key) == before
    plain = common.materialize

    def noted(df, name, batch=None):
        seen[name] = batch
        return plain(df, name, batch)

    monkeypatch.setattr(packing, "materialize", noted)
    monkeypatch.setattr(jaccard, "materialize", noted)
    docs = make_docs([(i, f"{i} a b c d e f g") for i in range(9)])
    assert packing.pack_documents(docs).count() == jaccard.link_documents(docs).count() == 9
    assert seen["pieces"] == seen["shingle-sets"] == seen["posted-sets"] == common.TEXTS


def test_packing_of_items_that_never_fit_together(spark):
    items = spark.range(0, 3000, numPartitions=16).selectExpr("id as doc_id", "0 as piece", "0L as start", "600 as length", "0L as ids_crc32")
    assert packing.pack(items, 1024).select("sequence_id").distinct().count() == 3000


def test_packing_rounds_reach_a_good_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 200)
    items = spark.range(0, 4000, numPartitions=16).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(1 + pmod(xxhash64(id), 700) as int) as length", "0L as ids_crc32")
    out = packing.pack(items, 1024)
    bins, total = out.select("sequence_id").distinct().count(), out.agg({"length": "sum"}).first()[0]
    assert out.count() == 4000 and bins <= 1.03 * total / 1024 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_uses_every_item_once(sizes):
    bins = packing.best_fit(np.array(sizes, np.int64), 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)


def check_columns(enc, texts, kind=pa.string()):
    ids, begins = enc.encode(pa.array([None, *texts], kind)[1:])
    assert [ids[a:b].tolist() for a, b in pairwise(begins)] == [lib_ids(t or "") for t in texts]
    assert begins[0] == 0 and begins[-1] == len(ids)


def test_columns_of_texts_equal_library(sf001_docs, monkeypatch):
    enc = bpe_ids.BatchEncoder("byte_bpe_50k.json")
    check_columns(enc, [r.text for r in sf001_docs.select("text").collect()])
    monkeypatch.setattr(bpe_ids, "KNOWN", 50)       # far fewer than the texts have
    monkeypatch.setattr(bpe_ids, "JOINED", 3)
    for texts in (ODD, [], [None, ""], [*ODD, None, *ODD[::-1], "end ", " \u2003", "\u2003", "  "], [s + t for s in ODD for t in ODD]):
        check_columns(enc, texts, pa.large_string())
        assert len(enc.keys) == len(enc.starts) == len(enc.sizes) == len(enc.used) <= 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x85\xa0\u2003\u3000'stΣé<|>")), max_size=40), max_size=6))
def test_any_column_of_texts(texts):
    check_columns(BATCH, texts)


def test_library_gets_a_chunk_once_whatever_is_remembered(monkeypatch):
    """One text at a time, a chunk beyond the memory went there at every place."""
    monkeypatch.setattr(bpe_ids, "KNOWN", 0)
    enc, given_out = bpe_ids.BatchEncoder("byte_bpe_50k.json"), []
    plain = enc._library
    monkeypatch.setattr(enc, "_library", lambda texts: given_out.extend(texts) or plain(texts))
    check_columns(enc, ["some words, and some words again\n\nsome words"] * 500)
    words = [w for lines in given_out for w in lines.split("\n") if w]
    assert not len(enc.keys) and sorted(words) == [" again", " and", " some", " words", " words,", "some"]


def test_worker_encodes_token_files_by_columns():
    common.claim({})
    enc = bpe_ids.batch_encoder("byte_bpe_50k.json")
    assert bpe_ids.batch_encoder("byte_bpe_50k.json") is enc and token_files.batch_encoder is bpe_ids.batch_encoder
    common.claim({})
    assert not bpe_ids._ENCODERS


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.none() | st.integers(0, 50), max_size=12), max_size=6))
def test_text_slices_keep_rows_and_order(batches):
    sizes = [n for b in batches for n in b]
    got = list(bpe_ids.text_slices((pa.record_batch([pa.array([None if n is None else "x" * n for n in b], pa.string())], names=["text"]) for b in batches), 0, 40))
    assert [None if t is None else len(t) for b in got for t in b.column(0).to_pylist()] == sizes
    held = [[len(t or "") for t in b.column(0).to_pylist()] for b in got]
    assert all(sum(b) <= 60 + 50 for b in held) and all(sum(b) >= 20 for b in held[:-1])


def test_token_files_round_trip(spark, make_docs, sf001_docs):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc de\n") for _ in range(rng.randrange(0, 400)))) for i in range(50)]
    rows += [(None, "no id"), (60, None), (61, ""), (62, "twice"), (62, "twice"), (63, "long " * 50_000)]
    rng.shuffle(rows)
    for docs in (make_docs(rows), sf001_docs):
        folder = scratch_path(spark, "tokens")
        token_files.write_token_files(docs, folder, files=4)
        got = token_files.read_documents(spark, folder).orderBy("start").collect()
        own = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r.doc_id for r in got] == [r[0] for r in own]
        at = 0
        for r, (_, text) in zip(got, own, strict=True):
            assert r.start == at and array("I", r.ids).tolist() == [*lib_ids(text or ""), 2]
            at += r.n_tokens
        some = token_files.read_documents(spark, folder, [3, 7]).collect()
        assert {r.doc_id: r.start for r in some} == {r.doc_id: r.start for r in got if r.doc_id in (3, 7)}
        d = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.digests(token_files.read_documents(spark, folder)).collect()}
        assert d == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}


def test_token_files_empty_and_damaged(spark, make_docs, tmp_path):
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(make_docs([]).limit(0), folder)
    assert token_files.read_documents(spark, folder).count() == 0
    import zstandard
    p = tmp_path / "f"
    with open(p, "wb") as out:
        w = token_files.SeekableWriter(out)
        w.frame(b"abcd" * 10)
        w.frame(b"\0" * 9)
        w.close()
    whole = p.read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"abcd" * 10 + b"\0" * 9
    with open(p, "rb") as f:
        r = token_files.SeekableReader(f, len(whole))
        r.table = r.table.copy()
        r.table["checksum"][0] += 1
        with pytest.raises(ValueError):
            r.frame(0)
