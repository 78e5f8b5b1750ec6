"""Approximate nearest neighbours by NN-descent and greedy graph search.

NN-descent builds a graph of the ``k`` nearest neighbours of every vector: in
each round the neighbours of a vector (both directions, ``MEMBERS`` at most,
recent ones first) meet there, compare each other, and every one keeps the best
it has met.  A round is three joins of narrow rows and the vectors of the
members; rounds end when few entries change.  The first graph comes from sorted
random projections: neighbours in the sort order are compared in blocks.

A query starts at its own place in the graph and opens the best unopened nodes
of its beam, ``OPENED`` at a time; the nodes behind them join the beam, ranked by
products of the vectors as the table has them (no 16-bit floats).  A query ends
when its beam has no unopened node; a node is scored once and opened once a query.

Equal vectors are one node, so a vector with a third of all rows is one node; a
node stands for its ``top`` + 1 smallest ids, which is all an answer can show.
Nearness is the inner product.  The graph compares vectors that are lengthened to
one norm by a further component, which turns the largest inner product into the
smallest angle.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part; a shorter vector counts as padded with zeros; a null id takes no
part; rows with the same id are rows of their own (the query's own row is one of
its id); fewer than ``top`` candidates give them all if the graph reaches them;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import materialize

K = 32              # neighbours of a node in the graph
MEMBERS = 64        # neighbours that meet at a node in a round
BACK = 2 * MEMBERS  # nodes listing a node that the search goes to from it, beside its own neighbours
PARTNERS = 12       # the best partners that a member takes from a meeting
PROJECTIONS = 8     # sort orders for the first graph
BLOCK = 256         # vectors compared with each other in a sort order
ROUNDS = 7          # rounds at most
SETTLED = 0.02      # share of entries changing in a round at which it ends
BEAM = 96
OPENED = 32         # nodes that a query opens in a round
CHUNK = 100_000     # rows handled at a time in a task

_GRAPH = "node long, peers array<long>, scores array<float>, fresh array<boolean>"


# --- streams of sorted rows ---------------------------------------------------
def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of about ``CHUNK`` rows that hold groups of equal keys whole."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(key).to_numpy()
            cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if cut:
                yield t.slice(0, cut).combine_chunks()
                held = t.slice(cut).to_batches()
                n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _list(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    c = t.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    lengths = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return c.flatten().to_numpy(zero_copy_only=False), lengths


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float16).reshape(len(raw), -1).astype(np.float32)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


# --- the nodes -----------------------------------------------------------------
def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as arrays of doubles."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
                    & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))


def _kind(rows: DataFrame):
    """What holds the table's components without loss."""
    return np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def _nodes(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node, vec, unit), members (node, vec_id: the smallest ids of each
    node), and all usable rows (node, vec_id)."""
    v, kind = usable_vectors(rows), _kind(rows)
    dim = v.agg(F.max(F.size("vec"))).first()[0] or 0
    zero = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))
    # + 0.0 makes a negative zero the same as zero
    v = v.withColumn("vec", F.transform(F.concat("vec", zero), lambda x: x + F.lit(0.0)))
    v = v.withColumn("node", F.xxhash64("vec"))
    every = materialize(v, "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    most = every.agg(F.max(norm)).first()[0] or 1.0
    one = every.groupBy("node").agg(F.first("vec").alias("vec"))
    scale = F.transform("vec", lambda x: x / F.lit(most))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x)))
    one = one.withColumn("unit", scale).withColumn("unit", F.concat("unit", F.array(rest)))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = np.array(b.column("unit").to_pylist(), np.float16)     # for the graph; answers are scored on vec
                vec = np.array(b.column("vec").to_pylist(), np.float64).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in vec], pa.binary()),
                                                  pa.array([x.tobytes() for x in unit], pa.binary())], names=["node", "vec", "unit"])

    nodes = materialize(one.mapInArrow(packed, "node long, vec binary, unit binary"), "nodes")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    members = every.select("node", "vec_id").withColumn("n", rank).filter(F.col("n") <= top + 1).drop("n")
    return nodes, materialize(members, "members"), every.select("node", "vec_id")


# --- the graph -----------------------------------------------------------------
def _project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector once per sort order, with its signature there: the signs of
    random projections, in a row."""
    for b in batches:
        if b.num_rows:
            unit = _vectors(b.column("unit").to_pylist())
            for order in range(PROJECTIONS):
                planes = np.random.default_rng(order).standard_normal((unit.shape[1], 24)).astype(np.float32)
                code = (unit @ planes > 0) @ (1 << np.arange(23, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), order, np.int32)), pa.array(code.astype(np.int64)), b.column("node"), b.column("unit")],
                    names=["sort", "code", "node", "unit"])


def _compare_blocks(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.select(["node", "unit"]))
            n += b.num_rows
            if n >= 16 * BLOCK:
                yield from blocks(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from blocks(pa.Table.from_batches(held))

    def blocks(t):
        nodes, unit = t.column("node").to_numpy(), _vectors(t.column("unit").to_pylist())
        for at in range(0, len(nodes), BLOCK):
            if len(nodes) - at < BLOCK:
                at = max(0, len(nodes) - BLOCK)      # the last block is a full one
            ids, m = nodes[at:at + BLOCK], unit[at:at + BLOCK]
            s = m @ m.T
            np.fill_diagonal(s, -np.inf)
            yield _best(ids, s, min(k, len(ids) - 1), np.full(len(ids), -np.inf, np.float32))
    return run


def _best(ids: np.ndarray, scores: np.ndarray, n: int, least: np.ndarray) -> pa.RecordBatch:
    """For each row of a matrix of scores its best n columns above ``least``."""
    if n < 1:
        pick = np.zeros((len(ids), 0), np.int64)
    elif n < scores.shape[1]:
        pick = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    else:
        pick = np.tile(np.arange(scores.shape[1]), (len(ids), 1))
    got = np.take_along_axis(scores, pick, axis=1)
    good = (got > least[:, None]) & np.isfinite(got)
    counts = good.sum(axis=1)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), _lists(ids[pick[good]], counts, pa.int64()), _lists(got[good].astype(np.float32), counts, pa.float32()),
         _lists(np.ones(int(counts.sum()), bool), counts, pa.bool_())], names=["node", "peers", "scores", "fresh"])


def _merge(k: int):
    """Sorted graph rows -> one row per node with its best k; an entry stays
    fresh only if no row had it before."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            peers, n = _list(t, "peers")
            scores, fresh = _list(t, "scores")[0], _list(t, "fresh")[0].astype(bool)
            node = np.repeat(t.column("node").to_numpy(), n)
            order = np.lexsort((fresh, peers, node))
            node, peers, scores, fresh = node[order], peers[order], scores[order], fresh[order]
            keep = np.ones(len(node), bool)
            keep[1:] = (node[1:] != node[:-1]) | (peers[1:] != peers[:-1])
            node, peers, scores, fresh = node[keep], peers[keep], scores[keep], fresh[keep]
            order = np.lexsort((peers, -scores, node))
            node, peers, scores, fresh = node[order], peers[order], scores[order], fresh[order]
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(node)]]))
            rank = np.arange(len(node)) - np.repeat(start, size)
            best = rank < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[start]), _lists(peers[best], np.minimum(size, k), pa.int64()),
                 _lists(scores[best], np.minimum(size, k), pa.float32()), _lists(fresh[best], np.minimum(size, k), pa.bool_())],
                names=["node", "peers", "scores", "fresh"])
    return run


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that meet at a node compare each other."""
    for t in whole_groups(batches, "center"):
        center, ids = t.column("center").to_numpy(), t.column("member").to_numpy()
        least = t.column("least").to_numpy().astype(np.float32)
        fresh = t.column("fresh").to_numpy().astype(bool)
        unit = _vectors(t.column("unit").to_pylist())
        start = np.flatnonzero(np.concatenate([[True], center[1:] != center[:-1]]))
        for a, b in zip(start, [*start[1:], len(center)], strict=True):
            if b - a < 2 or not fresh[a:b].any():
                continue
            s = unit[a:b] @ unit[a:b].T
            f = fresh[a:b]
            s[~(f[:, None] | f[None, :])] = -np.inf          # those two met before
            np.fill_diagonal(s, -np.inf)
            yield _best(ids[a:b], s, min(PARTNERS, b - a - 1), least[a:b])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 20_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def both_ways(graph: DataFrame) -> DataFrame:
    """(center, member, fresh): the neighbours of every node in both directions."""
    e = graph.select("node", F.explode(F.arrays_zip("peers", "fresh")).alias("e")).select("node", "e.peers", "e.fresh")
    pairs = e.select(F.col("node").alias("center"), F.col("peers").alias("member"), "fresh").union(
        e.select(F.col("peers").alias("center"), F.col("node").alias("member"), "fresh"))
    return pairs.groupBy("center", "member").agg(F.max("fresh").alias("fresh"))


def build_graph(nodes: DataFrame, k: int = K) -> DataFrame:
    """(node, peers, scores, fresh): about the k nearest nodes of every node."""
    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], _GRAPH)
    joined = lambda f: lambda batches: _joined(f(batches))
    # blocks are cut inside a partition: partitions should be several blocks large
    parts = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * PROJECTIONS // (4 * BLOCK)))
    sorts = nodes.select("node", "unit").mapInArrow(_project, "sort int, code long, node long, unit binary")
    first = (sorts.repartitionByRange(parts, "sort", "code", "node").sortWithinPartitions("sort", "code", "node")
             .mapInArrow(joined(_compare_blocks(k)), _GRAPH))
    merged = lambda g: g.repartition("node").sortWithinPartitions("node").mapInArrow(_merge(k), _GRAPH)
    graph = materialize(merged(first), "graph-0")
    for i in range(1, ROUNDS + 1):
        rank = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("center", "member")))
        pairs = both_ways(graph).withColumn("n", rank).filter(F.col("n") <= MEMBERS)
        # where nobody is new nobody has to meet; the first by rank is new if any is
        pairs = pairs.withColumn("any", F.first("fresh").over(Window.partitionBy("center").orderBy("n"))).filter("any").drop("n", "any")
        # a member takes along its vector and the score that a new neighbour must beat
        known = nodes.select("node", "unit").join(graph.select(
            "node", F.when(F.size("scores") >= k, F.array_min("scores")).otherwise(F.lit(float("-inf"))).cast("float").alias("least")),
            "node", "left").select(F.col("node").alias("member"), "unit", F.coalesce("least", F.lit(float("-inf"))).cast("float").alias("least"))
        met = (pairs.join(known, "member").select("center", "member", "fresh", "least", "unit")
               .repartition("center").sortWithinPartitions("center").mapInArrow(joined(_meet), _GRAPH))
        aged = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
        graph = materialize(merged(aged.union(met)), f"graph-{i}")
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0]
        if changed <= SETTLED * n * k:
            break
    return graph


# --- the search ----------------------------------------------------------------
_STATE = "query long, vec binary, peers array<long>, scores array<double>, opened array<boolean>, seen array<long>"


def _into_beam(kind):
    """Rows of a query, its state first, then the nodes met -> its new state.
    Scores are inner products of the vectors themselves, of the given kind."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "query"):
            query, node = t.column("query").to_numpy(), t.column("node").to_pylist()
            start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            states, vecs = t.column("state").to_pylist(), t.column("vec").to_pylist()
            out = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(query)], strict=True):
                state = states[a]
                beam, seen = np.array(state["peers"], np.int64), state["seen"]
                score, opened = np.array(state["scores"], np.float64), np.array(state["opened"], bool)
                if b > a + 1:
                    new = np.array(node[a + 1:b], np.int64)
                    m = np.frombuffer(b"".join(vecs[a + 1:b]), kind).reshape(len(new), -1).astype(np.float64)
                    beam, seen = np.concatenate([beam, new]), seen + new.tolist()
                    score = np.concatenate([score, m @ np.frombuffer(vecs[a], kind).astype(np.float64)])
                    opened = np.concatenate([opened, np.zeros(len(new), bool)])
                    best = np.lexsort((beam, -score))[:BEAM]
                    beam, score, opened = beam[best], score[best], opened[best]
                out.append((int(query[a]), vecs[a], beam.tolist(), score.tolist(), opened.tolist(), seen))
            kinds = [pa.int64(), pa.binary(), *map(pa.list_, (pa.int64(), pa.float64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=["query", "vec", "peers", "scores", "opened", "seen"])
    return run


def search_ways(graph: DataFrame) -> DataFrame:
    """(center, member): what opening a node leads to.  All neighbours that it
    lists itself, and of the nodes that list it the ``BACK`` closest."""
    e = graph.select("node", F.explode(F.arrays_zip("peers", "scores")).alias("e")).select("node", "e.peers", "e.scores")
    # ties are dealt by hash: many equal scores lead to different nodes
    rank = F.row_number().over(Window.partitionBy("peers").orderBy(F.desc("scores"), F.xxhash64("peers", "node")))
    back = e.withColumn("n", rank).filter(F.col("n") <= BACK)
    return (e.select(F.col("node").alias("center"), F.col("peers").alias("member"))
            .union(back.select(F.col("peers").alias("center"), F.col("node").alias("member"))).distinct())


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, kind=np.float64) -> DataFrame:
    """Greedy search for the query nodes: (query, peer) for every node of the
    final beams.  ``kind`` is what the nodes' ``vec`` holds."""
    ways = materialize(search_ways(graph), "ways")
    vecs = nodes.select(F.col("node").alias("member"), F.col("vec").alias("member_vec"))
    empty = lambda kind: F.lit([]).cast(f"array<{kind}>")
    state = queries.join(nodes, "node").select(F.col("node").alias("query"), "vec", empty("long").alias("peers"), empty("double").alias("scores"),
                                               empty("boolean").alias("opened"), F.array("node").alias("seen"))
    state = materialize(state, "beam-0")
    unopened = F.exists("opened", lambda x: ~x)
    ended, i = [], 0
    while True:
        if i == 0:      # a query's own node is the first to open
            marked = state.withColumn("todo", F.array("query"))
        else:
            ended.append(state.filter(~unopened).select("query", "peers"))
            # the beam is sorted: the first unopened ones are the best
            marked = state.filter(unopened).withColumn("todo", F.slice(F.transform(F.filter(
                F.arrays_zip("peers", "opened"), lambda x: ~x["opened"]), lambda x: x["peers"]), 1, OPENED))
        rest = marked.withColumn("opened", F.transform(F.arrays_zip("peers", "opened"), lambda x: x["opened"] | F.array_contains("todo", x["peers"])))
        met = (marked.select("query", F.explode("todo").alias("center")).join(ways, "center").groupBy("query")
               .agg(F.collect_set("member").alias("met")).join(marked.select("query", "seen"), "query")
               .select("query", F.explode(F.array_except("met", "seen")).alias("member")))
        met = met.join(vecs, "member").select("query", F.lit(1).alias("kind"), F.col("member").alias("node"), F.col("member_vec").alias("vec"),
                                              F.lit(None).cast("struct<peers:array<long>,scores:array<double>,opened:array<boolean>,seen:array<long>>").alias("state"))
        own = rest.select("query", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"), "vec",
                          F.struct("peers", "scores", "opened", "seen").alias("state"))
        i += 1
        state = materialize(own.union(met).repartition("query").sortWithinPartitions("query", "kind")
                            .mapInArrow(_into_beam(kind), _STATE), f"beam-{i}")
        if not state.filter(unopened).limit(1).count():
            break
    every = state.select("query", "peers")
    for e in ended:
        every = every.union(e)
    return every.select("query", F.explode("peers").alias("peer"))


def nearest(rows: DataFrame, is_query, top: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows found for every
    row where ``is_query`` (a condition on vec_id) holds."""
    nodes, members, every = _nodes(rows, top)
    graph = build_graph(nodes, k)
    asked = materialize(every.filter(is_query).withColumnRenamed("vec_id", "query_id"), "queries")
    queries = asked.select("node").distinct()
    kind = _kind(rows)
    beams = search(queries, nodes, graph, kind)
    # the node itself is a candidate too: its other rows are
    found = beams.union(queries.select(F.col("node").alias("query"), F.col("node").alias("peer")))
    vec = nodes.select("node", "vec")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, p = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, -1).astype(np.float64) for c in ("q_vec", "p_vec"))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("peer"), pa.array(np.einsum("ij,ij->i", q, p))],
                                                 names=["query", "peer", "score"])

    scored = (found.join(vec.select(F.col("node").alias("peer"), F.col("vec").alias("p_vec")), "peer")
              .join(vec.select(F.col("node").alias("query"), F.col("vec").alias("q_vec")), "query")
              .mapInArrow(exact, "query long, peer long, score double"))
    # the top + 1 rows of a query node, its own row among them if it is that near
    hits = scored.join(members.withColumnRenamed("node", "peer"), "peer").select("query", "vec_id", "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1)
    lists = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    lists = materialize(lists, "answers")
    answers = asked.join(lists.withColumnRenamed("query", "node"), "node")
    # take one row of the query's id out; what is left is numbered anew
    own = F.array_position(F.transform("hits", lambda h: h["vec_id"]), F.col("query_id"))
    left = F.filter("hits", lambda h: h["n"] != F.when(own > 0, own).otherwise(F.lit(top + 1)))
    one = answers.select("query_id", F.posexplode(F.slice(left, 1, top)).alias("at", "h"))
    return one.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))
