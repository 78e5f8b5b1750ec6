"""URL rules, chat formatting, quality rules, mixing and importance resampling."""
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frostline.llm import chat, importance, mixing, quality_rules, url_filter
from frostline.llm.common import WORD_PATTERN, materialize


# --- url rules -------------------------------------------------------------
def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


URLS = [None, "", "nourl", "http://", "https://EXAMPLE.com/en/x?y", "ftp://www.example.com/en/", "http://www.example.com/enx", "http://x.com",
        "http://com/", "http://.com/a", "http://example-com/en/", "http://a.example.com/en/#z", "x://b.net/fr/1", "x://net/es/", "x://net/es", "http://a..net/fr/?q",
        "a://b://c.com/", "http://İ.com/é", "http://example.com.evil.org/en/", "http://example.com:80/en/", "line\nhttp://x.com/a\nb", "http://q.com?x=/en/"]


def test_url_rules(spark):
    rows = [(i if i % 7 else None, u, "h") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    for ranges in (1, 5):
        got = Counter(map(tuple, url_filter.apply_rules(pages, ranges=ranges).collect()))
        assert got == Counter((i, *brute_url(u, url_filter.RULES)) for i, u, _ in rows)
    assert url_filter.apply_rules(pages.limit(0)).count() == 0


def test_url_rules_many_nested_rules(spark):
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "x-a.com", "a-b.com"]
    rules = [(h, p, "block" if (len(h) + len(p)) % 2 else "allow") for h in hosts for p in ("/", "/e", "/en/")]
    urls = [f"http://{s}{h}{p}" for h in hosts for s in ("", "w.", "w.v.") for p in ("", "/", "/e", "/en/1", "/f?g")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rule_rows = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, action string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.apply_rules(pages, rule_rows, default="block", ranges=4).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u, rules, "block")
        assert got[i][:2] == (host, path) and got[i][3] == verdict and (got[i][2] is None) == (rule is None)
        assert rule is None or len(got[i][2]) == len(rule)


# --- chat ------------------------------------------------------------------
def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <nice> & [kind]"), (1, 1, "user", "</s>[INST] &lt; &amp;lt;"), (1, 2, "assistant", "<s>ok</s>"), (1, 4, "user", None),
            (1, 5, "assistant", ""), (1, 5, "assistant", ""), (2, None, None, "lost"), (2, 3, "to[ol]", "x[=]y[/ROLE]"), (None, 0, "assistant", "n"), (3, 0, "user", "only é😀")]
    rows += [(9, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1500)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, block string")
    formatted = chat.format_conversations(df.repartition(7))
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(own), len(loss))
        assert g.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    stream = {}
    for r in sorted(formatted.collect(), key=lambda r: r.char_start):
        assert len(stream.get(r.conv_id, "")) == r.char_start
        stream[r.conv_id] = stream.get(r.conv_id, "") + r.formatted
        assert r.char_end == len(stream[r.conv_id])
    examples = chat.expand_examples(formatted.filter("conv_id = 1 or conv_id is null")).collect()
    assert len(examples) == 4
    for e in examples:
        s = stream[e.conv_id]
        assert e.context == s[:e.context_end] and s[e.context_end:].startswith(e.target)
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.conversation_digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# rows (conv_id, turn, role, text): many turns, trailing turns, no assistant, repeated rows, nulls, one text longer than several parts
CHATS = [(1, i, ("user", "assistant", "system", "to[ol]")[i % 4], f"<s>{i}</s> & [{'é😀' * (i % 7)}\n]") for i in range(60)] + [
    (2, 0, "user", None), (2, 1, None, "lost"), (None, 0, "assistant", "n"), (None, 0, "assistant", "n"), (None, None, "user", "first"),
    (3, 0, "assistant", ""), (4, 0, "user", "x" * 1000), (4, 1, "assistant", "y" * 500), (4, 2, "assistant", "z"), (4, 3, "user", "last")]


@pytest.mark.parametrize("chars", [1 << 18, 100])
def test_chat_examples_are_written_out(spark, monkeypatch, chars):
    monkeypatch.setattr(chat, "CHARS_IN_PART", chars)
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    formatted = materialize(chat.format_conversations(df.repartition(5)), "test-chat")
    stream, ends, masks = {}, {}, {}
    for r in sorted(formatted.collect(), key=lambda r: r.char_start):
        stream[r.conv_id] = stream.get(r.conv_id, "") + r.formatted
        if r.context_end is not None:
            ends[r.conv_id, r.context_end], masks[r.conv_id, r.context_end] = r.char_end, (r.loss_start, r.loss_end)
    for conv, s in stream.items():      # what follows the last reply is an example without a target
        if all(e != len(s) for (c, _), e in ends.items() if c == conv):
            ends[conv, len(s)], masks[conv, len(s)] = len(s), None
    assert len(ends) == sum(r[2] == "assistant" for r in CHATS) + 3     # 1, 2 and 4 go on after it
    got = {}
    for r in sorted(chat.expand(formatted).collect(), key=lambda r: r.part):
        got.setdefault((r.conv_id, r.context_end), []).append(r)
    assert set(got) == set(ends)
    for key, parts in got.items():
        assert "".join(p.text for p in parts) == stream[key[0]][:ends[key]]
        assert {p.whole for p in parts} == {ends[key] == len(stream[key[0]])}
        assert all(p.loss_start is None for p in parts[:-1])
        before, last = sum(len(p.text) for p in parts[:-1]), parts[-1]
        assert masks[key] == (None if last.loss_start is None else (before + last.loss_start, before + last.loss_end))
    assert chars > 100 or max(map(len, got.values())) > 5
    for r in chat.conversation_digests(formatted).collect():
        own = sorted([c for c in CHATS if c[0] == r.conv_id], key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or ""))
        assert (r.n_turns, r.formatted_chars) == (len(own), len(stream[r.conv_id]))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{c[2] or ''}\n{c[3] or ''}\n" for c in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(c[3] or "" for c in own if c[2] == "assistant").encode()).hexdigest()


def test_chat_query_writes_examples_and_reads_them_back(spark, monkeypatch):
    """Every assistant turn of the table is the target of a written example, and
    the digests come from these."""
    from frostline.llm import queries
    seen = []
    digests = chat.example_digests
    monkeypatch.setattr(chat, "example_digests", lambda e: seen.append(e) or digests(e))
    sf = "/root/testdata/sf0.001"
    answer = queries.op4_chat_format(spark, sf)
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    examples = seen[0].collect()
    assert sum(r.loss_start is not None for r in examples) == rows.filter("role = 'assistant'").count() + 1
    longest = {}
    for r in examples:
        longest[r.conv_id] = max(longest.get(r.conv_id, ""), r.text, key=len)
    assert all(longest[r.conv_id].startswith(r.text) for r in examples)
    assert {r.conv_id: r.formatted_chars for r in answer.collect()} == {c: len(t) for c, t in longest.items()}


# --- quality rules ---------------------------------------------------------
def brute_base(text):
    words = re.findall(WORD_PATTERN, text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines, dup = [], 0
    for x in (text or "").split("\n"):
        if re.search(WORD_PATTERN, x):
            dup += x in lines
            lines.append(x)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


TEXTS = [None, "", " \n ", "a b c d e f g h a b c d e f g h i", "x\xa0y z\n" * 5, "same line\nsame line\nsame line \n" + "w " * 30, "#*$ %&|<>", " ".join(map(str, range(50))),
         " ".join(map(str, range(12))) + " q " + " ".join(map(str, range(12))), "é" * 10_000, "word " * 20_000]


def test_base_figures(make_docs, sf001_docs):
    for docs in (make_docs(list(enumerate(TEXTS)) + [(None, "a b")]), sf001_docs):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        for r in quality_rules.judge(docs).collect():
            assert tuple(r)[1:7] == brute_base(texts[r.doc_id])
            assert r.kept <= (not r.base_failed)


def test_line_rules(make_docs):
    prose = "This is an ordinary sentence about the weather in the valley, and it goes on for a while."
    nav = "Home | News | Sports | Weather | Contact | About | Login | More"
    good = "\n".join([*(" ".join(f"plain{i}x{j}" for j in range(15)) + "." for i in range(4)), "Accept cookies", nav])
    bad = "\n".join([nav + f" {i}" for i in range(6)] + [prose])
    junk = " ".join(f"w{i}%%%" for i in range(60))
    shout = " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(60))
    docs = make_docs([(1, good), (2, bad), (3, junk), (4, shout)])
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == {1: True, 2: False, 3: False, 4: False}
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema and [r.doc_id for r in kept.collect()] == [1]
    assert quality_rules.clean_text(good).count("\n") == 3
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_failing_lines_are_removed(make_docs, spark):
    nav = "Home | News | Sports | Weather | Contact | About | Login | More"
    prose = [" ".join(f"plain{i}x{j}" for j in range(15)) + " é." for i in range(4)]
    docs = make_docs([(1, "\n".join([nav, *prose[:2], "", "Accept cookies", *prose[2:], "Share | Mail | Print"])), (2, "\n".join(prose)), (3, nav), (4, None)])
    want = {1: "\n".join([*prose[:2], "", *prose[2:]]), 2: "\n".join(prose)}
    kept = quality_rules.keep_good(docs).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.key) for r in kept} == {i: (t, len(t), "en", "y") for i, t in want.items()}
    assert [r.text for r in quality_rules.keep_good(docs.select("text")).sort("text").collect()] == sorted(want.values())
    judged = quality_rules.judge(docs, cleaned=True)
    assert judged.drop("cleaned_text").schema == quality_rules.judge(docs).schema
    assert {r.doc_id: r.cleaned_text for r in judged.collect()} == {**want, 3: "", 4: ""}


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    j = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r for r in j if r.quality == 1 and not r.base_failed]
    junk = [r for r in j if r.quality == 0]
    assert all(r.kept for r in clean) and sum(r.kept for r in junk) <= 0.05 * len(junk)


# --- mixing ----------------------------------------------------------------
def test_targets():
    got = mixing.targets([("b", 100), (None, 1000), ("a", 10)])
    assert [g[0] for g in got] == ["a", "b", None]
    assert got[0][2] == 20 and got[1][2] == 200 and got[2][2] == pytest.approx(1665 - 220)
    assert mixing.targets([]) == []
    assert mixing.targets([("a", 0)])[0][2] == 0


def check_mix(rows, n_docs):
    assert len(rows) == n_docs
    by = {}
    for r in rows:
        assert r.taken == r.epochs * r.size <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    want = {s: (n, t) for s, n, t in mixing.targets([(s, sum(r.size for r in v)) for s, v in by.items()])}
    for s, v in by.items():
        assert all(r.source_size == want[s][0] and abs(r.target - want[s][1]) < 1e-6 for r in v)
        smallest = min([r.size for r in v if r.size], default=0)
        assert abs(sum(r.taken for r in v) - want[s][1]) <= max(smallest, 0.05 * want[s][1]) + 1


def test_mix(make_docs, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mix(docs).collect()
    check_mix(first, 1000)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)
    # whole epochs come before the sample, and keys decide the sample
    for s in {r.source for r in first}:
        v = [r for r in first if r.source == s and r.size]
        assert {r.epochs for r in v} <= {v[0].whole, v[0].whole + 1}
        inside, out = [r.key for r in v if r.sampled], [r.key for r in v if not r.sampled]
        assert not inside or not out or max(inside) < min(out)
    out = mixing.mixed_documents(docs)
    times = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert out.columns == docs.columns and times == Counter({r.doc_id: r.epochs for r in first if r.epochs})


def test_mix_edges(make_docs):
    rows = [(i, f"w{i} " * (i % 9 + 1), None if i % 3 == 0 else "é" if i % 3 == 1 else "z") for i in range(90)]
    rows += [(500, None, "z"), (501, "", None), (None, "no id here", "z"), (7, "same row", "z"), (7, "same row", "z")]
    check_mix(mixing.mix(make_docs(rows)).collect(), len(rows))
    assert mixing.mix(make_docs([]).limit(0)).count() == 0
    assert mixing.mixed_documents(make_docs([]).limit(0)).count() == 0
    only = mixing.mix(make_docs([(1, None, "a")])).collect()
    assert [(r.size, r.taken) for r in only] == [(0, 0)]


# --- importance resampling --------------------------------------------------
def test_importance_held_out(spark):
    """Fit on half of the labels, judge the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    half = labels.filter("pmod(xxhash64(doc_id), 2) = 0")
    scored = importance.score(docs, half)
    assert scored.count() == docs.count()
    held = scored.join(labels.filter("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").collect()
    clean = [r for r in held if r.quality == 1 and not r.toxic and r.n_features > 20]
    junk = [r for r in held if r.quality == 0]
    toxic = [r for r in held if r.toxic]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)
    # some labels are wrong by design of the data; the words themselves are not
    words = set("trash pathetic idiot disgusting worthless stupid clown scum loser moron".split())
    texts = {r.doc_id: set(re.findall(r"\w+", r.text.lower())) for r in docs.select("doc_id", "text").collect()}
    rude = [r for r in toxic if len(words & texts[r.doc_id]) > 1]
    assert rude and sum(not r.kept for r in rude) >= 0.95 * len(rude)


def test_importance_top_k_is_exact(spark):
    scored = spark.range(1000).selectExpr("id as doc_id", "xxhash64(id) as h", "cast(pmod(xxhash64(id), 5000) as double) / 5000 as key")
    for k in (0, 1, 137, 1000, 2000):
        got = importance._top_k(scored, k).collect()
        want = {r.doc_id for r in sorted(got, key=lambda r: (-r.key, r.doc_id, r.h))[:k]}
        assert len(got) == 1000 and {r.doc_id for r in got if r.kept} == want


def test_importance_top_k_of_repeated_rows_and_many_rounds(spark, monkeypatch):
    """Of rows that are alike in everything exactly as many are kept as the cut leaves."""
    alike = spark.range(600).selectExpr("cast(7 as long) as doc_id", "cast(9 as long) as h", "0.5 as key", "id as row")
    others = spark.range(600, 1000).selectExpr("case when id % 7 > 0 then id end as doc_id", "xxhash64(id) as h",
                                               "cast(pmod(xxhash64(id), 9973) as double) / 9973 as key", "id as row")
    scored = alike.unionByName(others).withColumn("key", F.col("key").cast("double"))
    monkeypatch.setattr(importance, "SORTED", 40)
    monkeypatch.setattr(importance, "CLASSES", 4)
    order = [(r.key, r.doc_id, r.h, r.row) for r in scored.collect()]
    order.sort(key=lambda t: (-t[0], t[1] is not None, t[1] or 0, t[2], t[3]))
    for k in (1, 150, 201, 500, 799, 999):
        got = {r.row for r in importance._top_k(scored, k).filter("kept").collect()}
        assert got == {t[3] for t in order[:k]}


def test_sampled_rows_keep_their_columns_and_repeats(spark, make_docs):
    docs = make_docs([(1, "good words here"), (1, "good words here"), (2, None), (None, "x " * 50_000), (3, "")])
    docs = docs.withColumn("row", F.lit(5)).withColumn("h", F.lit("mine")).withColumn("c1", F.lit(2.5)).withColumn("key", F.array(F.lit(1)))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = importance.keep_sampled(docs, labels)
    assert kept.schema.names == docs.schema.names and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_importance_edges(spark, make_docs):
    docs = make_docs([(1, "good words here"), (1, "good words here"), (2, None), (None, "x"), (3, "")])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, None), (1, 1, 0), (2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        got = importance.score(docs, labels).collect()
        assert len(got) == 5 and all(r.kept for r in got)
        assert importance.keep_sampled(docs, labels).columns == docs.columns
        assert importance.score(docs.limit(0), labels).count() == 0
