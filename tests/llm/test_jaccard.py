"""The Jaccard join against brute force."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from frostline.llm import jaccard
from frostline.llm.common import WORD_PATTERN, materialize


def brute_sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORD_PATTERN, low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    links = [0] * len(rows)
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, n in counts.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), doc_id) if x is not None], default=None)
    return sorted(((d, len(s), least[root(i)], n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links, strict=True))), key=repr)


def result(docs, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.link_documents(docs, **options).collect()), key=repr)


def copies(rng, n, words=("alpha", "beta", "gamma", "delta", "eps", "zeta")):
    """Groups of near copies, passages that many share, short and empty texts."""
    passage = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(60))
    rows = [(None, None), (0, None), (1, ""), (2, "\n \t"), (3, "one"), (4, "ONE"), (5, "one two three four"), (6, "one two three four")]
    base = []
    for i in range(10, n):
        if base and rng.random() < 0.6:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            w = w[:len(w) - rng.randrange(0, 15)]
        else:
            w = [rng.choice(words) + str(rng.randrange(10**4)) for _ in range(rng.randrange(6, 160))]
            if rng.random() < 0.5:
                w += passage.split()
            base.append(w)
        rows.append((i, " ".join(w)))
    rows += [rows[12], (rows[13][0], "same id another text"), (None, rows[14][1]), (None, "nobody else has this text here at all")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make_docs, seed):
    rows = copies(random.Random(seed), 300)
    assert result(make_docs(rows).repartition(3)) == brute(rows)


def test_large_cluster_in_blocks(make_docs, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w[rng.randrange(0, 20):])))
    monkeypatch.setattr(jaccard, "SETS_IN_TASK", 40)
    assert result(make_docs(rows)) == brute(rows)


def test_sf001(sf001_docs):
    assert result(sf001_docs) == brute([(r.doc_id, r.text) for r in sf001_docs.collect()])


def test_order_from_a_full_filter_is_still_exact(make_docs):
    rows = copies(random.Random(9), 150)
    assert result(make_docs(rows), filter_bits=1 << 10, max_frequent=20) == brute(rows)


def test_empty_and_alone(make_docs):
    assert result(make_docs([]).limit(0)) == []
    assert result(make_docs([(7, "just one text with a few words")])) == [(7, 3, 7, 0)]


def test_keep_one(make_docs):
    rows = copies(random.Random(3), 200)
    docs = make_docs(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute(rows)
    groups = {c for d, n, c, _ in want if n and c is not None}
    alone = {d for d, n, c, _ in want if not n}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == groups | alone | {None}
    assert all(got.count(g) == 1 for g in groups)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=60))
def test_join_cluster_equals_all_pairs(sets):
    tokens = [np.array(sorted(s), np.uint64) for s in sets]
    got = {frozenset((x, int(y))) for x, ys in jaccard.join_cluster(tokens) for y in ys}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i)
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert got == want


def test_join_cluster_derives_answers_of_close_sets():
    rng = np.random.default_rng(0)
    base = np.arange(300)
    sets = [np.unique(np.concatenate([rng.choice(base, 300 - k, replace=False), rng.integers(1000, 2000, k)])).astype(np.uint64) for k in rng.integers(0, 60, 120)]
    got = {frozenset((x, int(y))) for x, ys in jaccard.join_cluster(sets) for y in ys}
    want = {frozenset((i, j)) for i in range(120) for j in range(i)
            if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - n)}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.integers(0, 2000), st.integers(0, 400)), min_size=2, max_size=8))
def test_sketches_rule_out_no_link(spec):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([pool[s:s + n], rng.integers(0, 2**63, k).astype(np.uint64)])) for n, s, k in spec), key=len)
    tied = {(x, int(y)) for x, ys in jaccard.possible_links(np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets]) for y in ys}
    for y in range(len(sets)):
        for x in range(y):
            n = len(np.intersect1d(sets[x], sets[y]))
            if 100 * n >= 75 * (len(sets[x]) + len(sets[y]) - n):
                assert (x, y) in tied


@pytest.mark.parametrize("n", [15, 21, 45, 64])
def test_lists_longer_than_the_longest_lose_no_link(monkeypatch, n):
    """Groups of near copies in one posted list, before and after the place where it overflows."""
    monkeypatch.setattr(jaccard, "LONGEST_LIST", 20)
    rng = np.random.default_rng(n)
    bases = [rng.integers(1, 2**62, 200).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([bases[i % 6][rng.integers(0, 12):], rng.integers(1, 2**62, rng.integers(0, 8)).astype(np.uint64), [np.uint64(7)]])) for i in range(n)]
    sets += [np.unique(np.concatenate([bases[0], [np.uint64(9 + i)]])) for i in range(2)]     # the next, short list
    posts = sorted([(7, len(s), i, jaccard.sketch(s)) for i, s in enumerate(sets[:n])] + [(8, len(s), n + i, jaccard.sketch(s)) for i, s in enumerate(sets[n:])])
    table = pa.table(dict(zip(("token", "size", "sig", "sketch"), zip(*posts, strict=True), strict=True)))
    forest = jaccard.Forest()
    for batch in jaccard._list_edges(table.to_batches(max_chunksize=7)):
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
    linked = [(i, j) for i in range(n) for j in range(i)
              if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - both)]
    assert linked and all(forest.root(i) == forest.root(j) for i, j in linked)
    assert forest.root(n) == forest.root(n + 1) and all(forest.root(n) != forest.root(i) for i in range(n))


def test_sets_of_texts_equal_sets_of_word_tuples(monkeypatch):
    """Texts one after the other, in runs of a few bytes: words end with their text, long words count whole."""
    texts = [None, "", " ", "a", "A", "a b", "b a", "a b c d", "a b c d e", "a b c d e f", "\x00a", "a\x00", "x" * 8, "x" * 9, "x" * 64, "x" * 65,
             "X" * 64 + "y z", "é ü b c d e f", "a b c d e " * 3, "", "a  b\t\nc\x0b\x0cd\re", "z", None, "y" * 16 + " " + "y" * 17, "no-break\xa0space stays"]
    for size in (1, 20, 10**6):
        monkeypatch.setattr(jaccard, "BYTES", size)
        got = []
        for at, values, bounds in jaccard.shingle_sets(pa.array(["before", *texts]).slice(1)):
            assert at == len(got)
            got += [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert [len(s) for s in got] == [len(brute_sets(t)) for t in texts]
        assert all(s == sorted(s) for s in got)
        for i, s in enumerate(got):
            assert [s == other for other in got] == [brute_sets(texts[i]) == brute_sets(t) for t in texts]
        assert [jaccard.shingles(t).tolist() for t in texts] == got


def test_copies_in_other_tasks_are_not_posted(make_docs, monkeypatch):
    """Copies alone make no shingle frequent: no set is posted; results are as before."""
    written = {}

    def watch(df, name, batch=None):
        out = materialize(df, name, batch)
        written[name] = out.count()
        return out
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows] + [(200 + i, t) for i, t in rows] + [(None, rows[0][1]), rows[1], (None, "of null ids alone " * 4), (None, "of null ids alone " * 4)]
    monkeypatch.setattr(jaccard, "materialize", watch)
    docs = make_docs(rows).repartition(5)
    assert result(docs) == brute(rows)
    assert written["posted-sets"] <= 2      # that of null ids, and that of a row that is there twice with its id
    monkeypatch.setattr(jaccard, "MAX_REPEATED", 7)
    assert result(docs) == brute(rows)


def test_edges_are_found_once(spark):
    found = spark.sparkContext.accumulator(0)

    def edges(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([(i, i - i % 5) for i in range(40)], "a long, b long").repartition(3)
    rows = jaccard.materialize(rows, "edges")
    roots = jaccard.connected(rows.mapInArrow(edges, "a long, b long"), "once")
    assert found.value == 40
    assert sorted(map(tuple, roots.collect())) == [(i, i - i % 5) for i in range(40)]


def test_long_sets_that_share_a_shingle_are_not_tied():
    """Neighbours of a long list are compared by their long sketches."""
    rng = np.random.default_rng(2)
    sets = sorted((np.unique(np.append(rng.integers(1, 2**62, int(n)), 7)).astype(np.uint64) for n in rng.integers(2500, 4000, 100)), key=len)
    sets.insert(50, sets[50][1:])
    table = pa.table({"token": [7] * 101, "size": [len(s) for s in sets], "sig": list(range(101)), "sketch": [jaccard.sketch(s) for s in sets]})
    edges = [(a, b) for batch in jaccard._list_edges(iter(table.to_batches(max_chunksize=30))) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
    assert edges == [(51, 50)]


@pytest.mark.parametrize("crossed", [False, True])
def test_join_cluster_of_many_sets(crossed):
    """Close sets, sets that share rare shingles only, and loose ones, with and without sides."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**62, 300) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 6], 300 - int(k), replace=False), rng.integers(0, 2**62, int(k))])).astype(np.uint64)
            for i, k in enumerate(rng.integers(0, 70, 240))]
    pairs = [rng.integers(0, 2**62, 80) for _ in range(60)]
    sets += [np.unique(np.append(p[j:], rng.integers(0, 2**62, 3))).astype(np.uint64) for p in pairs for j in (0, 4, 30)]
    side = rng.integers(0, 2, len(sets)) if crossed else None
    got = [frozenset((x, int(y))) for x, ys in jaccard.join_cluster(sets, side) for y in ys]
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if side is None or side[i] != side[j]
            if 100 * (n := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 75 * (len(sets[i]) + len(sets[j]) - n)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_filter_grows_with_what_is_in_it():
    """A slice has room for its fingerprints up to its limit; buckets without a slice say 1."""
    rng = np.random.default_rng(6)
    rows = [[rng.integers(0, 2**32, n).astype(np.uint32) for n in (10, 5000)], [rng.integers(0, 2**32, 300).astype(np.uint32) for _ in range(2)]]
    packed = [(b, np.concatenate([rows[b][0], rows[b][1], rows[b][1]])) for b in (0, 1)]
    batch = jaccard._arrow([[None] * 2] * 4 + [[2, 0], [packed[0][1].tobytes(), packed[1][1].tobytes()], [None] * 2, [None] * 2], jaccard._KINDS, jaccard._NAMES)
    out = pa.Table.from_batches(jaccard._count_prints(1 << 20)(iter([batch]))).to_pylist()
    assert [len(r["bits"]) * 8 for r in out] == [4096, 65536]
    f = jaccard.Frequencies([Row(**r) for r in out], 2, 10)
    shift = np.uint64(30)
    of = lambda bucket, p: f.of((p.astype(np.uint64) | np.uint64(bucket) << np.uint64(32)) << shift)
    assert (of(2, rows[0][1]) == 2).all() and (of(0, rows[1][1]) == 2).all()
    assert (of(2, rows[0][0]) == 1).sum() >= 7 and (of(1, rows[0][1]) == 1).all() and (of(3, rows[0][1]) == 1).all()
