"""Small cases: ties, nulls, empty tables and orders that SQL can't express."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkivist.functions import chunkers
from sparkivist.functions import text as T
from sparkivist.operators import evaluate, facts, gates, ledger, ranking, recall, sessions, vectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "abcab", 9), (2, "", 9), (3, None, 9), (4, "xyz", 9), (5, "AB!", 9)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in ranking.bm25_scores(docs, "ab").collect()}
    n, df, avgdl = 5, 2, (4 + 2 + 1) / 5
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    assert set(got) == {1, 5}
    assert got[1]["score"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / avgdl)))
    assert got[1]["admitted"]
    assert ranking.bm25_scores(docs.limit(0), "ab").count() == 0 and ranking.bm25_scores(docs, "a").count() == 0


def test_ngrams_outside_the_basic_plane(spark):
    df = spark.createDataFrame([("𠮷野家ab",), (None,), ("a",)], "text string").select(T.ngrams("text").alias("t"))
    assert [r[0] for r in df.collect()] == [["𠮷野", "野家", "家a", "ab"], [], []]


def test_global_rank_and_balance(spark):
    df = spark.createDataFrame([(i, float(i % 7), "timeline" if i < 90 else "index") for i in range(100)], "doc_id long, score double, layer string")
    r = ranking.global_rank(df, F.desc("score"), F.asc("doc_id"))
    want = [x[0] for x in sorted(((i, float(i % 7)) for i in range(100)), key=lambda x: (-x[1], x[0]))]
    assert [x["doc_id"] for x in r.orderBy("rank0").collect()] == want
    assert {x["layer"] for x in ranking.layer_balanced(r, 5).collect()} == {"timeline", "index"}
    assert ranking.layer_balanced(r, 5).count() == 5 and ranking.layer_balanced(r, 1).count() == 1


def test_two_queries_bring_in_graph_rows_and_layers(spark):
    data = [(i, f"alpha beta {i:03}" + "x" * i, "timeline") for i in range(30)] + [(90, "alpha zzqqzz", "timeline"), (91, "zzqqzz only", "index")] + [(100 + i, f"unrelated {i} words", "timeline") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, layer string")
    got = {r["doc_id"]: r["rank"] for r in ranking.retrieve_queries(docs, ["alpha beta", "alpha zz"], 5).collect()}
    assert 91 in got and sorted(got.values()) == [1, 2, 3, 4, 5]
    assert rows(ranking.retrieve_queries(docs, ["alpha beta", " alpha beta "], 5)) == rows(ranking.hybrid_retrieve(docs, "alpha beta", 5))
    with pytest.raises(ValueError):
        ranking.retrieve_queries(docs, ["a", "b", "c"])


def test_vectors_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    monkeypatch.setattr(vectors, "PASS_BYTES", 8 * 8 * 2)  # two queries a pass
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 100 = 0"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    def unit(v):
        n = math.sqrt(sum(x * x for x in v)) or 1
        return [x / n for x in v]
    unit_by = {i: unit(v) for i, v in data if v}
    for q in (0, 100, 200):
        best = sorted(((-round(sum(a * b for a, b in zip(unit_by[q], v)), 6), i) for i, v in unit_by.items() if i != q))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == [i for _, i in best]


def test_recency_bounds(spark):
    now = 1_000_000.0
    df = spark.createDataFrame([(1, now, 1.0, "x"), (2, now + 86400, 1.0, "x"), (3, now + 86401, 1.0, "x"), (4, None, 1.0, "x"), (5, now, 5.0, "mtime"), (6, now - 7 * 86400, None, "x")], "id long, ts double, weight double, source string")
    got = {r["id"]: r["score"] for r in recall.recall_recent(df, now, 10).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.5}


def test_chains_with_cycles_and_ties(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s"), ("p", None), ("z", "x")]
    df = spark.createDataFrame([(h, r) for h, r in links], "hash string, replaced_by string")
    assert rows(ledger.supersession_chains(df)) == [("a", "d", 3), ("b", "d", 2), ("c", "d", 1)]
    codes = rows(ledger.chain_violations(df, spark.createDataFrame([("b",), ("c",), ("x",), ("y",), ("s",)], "record_id string")))
    assert ("c", "dangling") in codes and ("s", "self_link") in codes and ("z", "shared_target") in codes
    assert ledger.supersession_chains(df.limit(0)).count() == 0


def test_sized_blocks(spark):
    data = [("c", 1, 700, 0.0), ("c", 2, 200, 10.0), ("c", 3, 50, None), ("c", 4, 10, 1811.0), ("c", 5, 10, 3612.0), ("d", 6, 5000, 1.0), ("d", 7, 1, 2.0)]
    df = spark.createDataFrame(data, "g string, o int, n int, t double")
    got = {(r[0], r[1]): r[2] for r in sessions.sized_blocks(df, "g", "o", "n", "t").collect()}
    assert got[("d", 6)] == 0 and got[("d", 7)] == 1
    assert got[("c", 4)] != got[("c", 5)]


def greedy_collapse(items, floor):
    def grams(s):
        return {s[i : i + 2] for i in range(len(s) - 1)}
    days = sorted({d for _, _, ds in items for d in ds})
    gone = set()
    for day in days:
        bucket = sorted((x for x in items if day in x[2]), key=lambda x: (-len(x[1]), x[0]))
        for i, (fid, t, _) in enumerate(bucket):
            if fid in gone:
                continue
            for other, u, _ in bucket[i + 1 :]:
                a, b = grams(t), grams(u)
                if a and b and len(a & b) / min(len(a), len(b)) >= floor:
                    gone.add(other)
    return {x[0] for x in items} - gone


def test_collapse_against_brute_force(spark):
    rnd = random.Random(5)
    items = []
    for i in range(60):
        s = "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9)))
        ds = {rnd.choice(["2024-01-01", "2024-01-02", "2024-01-03"]) for _ in range(2)}
        items.append((f"f{i:02}", s, ds))
    data = [(f, s, min(ds), max(ds)) for f, s, ds in items] + [("n", None, None, None)]
    df = spark.createDataFrame(data, "fact_id string, fact string, written string, event_date string")
    got = {r[0] for r in facts.collapse_near_dups(df, 0.6).collect()}
    assert got == greedy_collapse(items, 0.6) | {"n"}


def test_siblings_cut_before_cooling(spark):
    f = [("q", 1, "x", 1, 400, True, True), ("q", 2, "y", 2, 300, True, False), ("q", 3, "y", 3, 800, True, False), ("q", 4, "y", 4, 200, True, False), ("q", 5, "x", 5, 10, True, False), ("q", 6, "y", 6, 10, False, False)]
    df = spark.createDataFrame(f, "query_id string, fact_id long, block string, rank int, bytes int, above boolean, cooling boolean")
    assert [(r["fact_id"], r["role"]) for r in facts.attach_siblings(df).orderBy("at").collect()] == [(2, "kept"), (4, "sibling")]


def test_auc_with_one_class_and_ties(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.5, False), (None, True)], "s double, l boolean")
    assert rows(evaluate.auc(df, "s", "l")) == [(0.875, 2, 2)]
    assert evaluate.auc(df.where("l"), "s", "l").first()["auc"] is None
    assert tuple(evaluate.auc(df.limit(0), "s", "l").first()) == (None, 0, 0)


def test_input_gate(spark):
    texts = [(None, "low_information"), ("  ", "low_information"), ("/reset now", "control_command"), ("```\nx\n```", "quoted_or_code_only"), ("> a\n> b", "quoted_or_code_only"), ("嗯", "licensed_short_trigger"), ("ok!", "low_information"), ("what about the trip", "specific_user_signal")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "text string").select(gates.input_gate("text", ("嗯",)).alias("g"))
    assert [r["g"]["reason"] for r in df.collect()] == [x for _, x in texts]


def test_chunkers():
    assert chunkers.chunk_heading(None) == [] and chunkers.chunk_heading(" \n") == []
    assert chunkers.chunk_heading("## a\n## b\nbody") == ["## a\n## b\nbody"]
    long = "## h\n\n" + "\n\n".join("x" * 700 for _ in range(4))
    got = chunkers.chunk_heading(long)
    assert got[0].startswith("## h\n\nx") and all(len(c) <= 1520 for c in got) and "".join(got).count("x") == 2800
    assert chunkers.chunk_semantic("一。二。") == ["一。二。"]
    assert "".join(chunkers.chunk_semantic("甲乙丙丁。" * 500)) == "甲乙丙丁。" * 500


def test_exports(spark, tmp_path):
    import json

    from sparkivist.sources import exports

    tree = {"current_node": "c", "mapping": {"a": {"parent": None, "message": None}, "b": {"parent": "a", "message": {"author": {"role": "user"}, "create_time": 1.5, "content": {"parts": ["hi"]}}}, "c": {"parent": "b", "message": {"author": {"role": "assistant"}, "content": {"parts": ["yo"]}}}, "x": {"parent": "b", "message": {"author": {"role": "assistant"}, "content": {"parts": ["abandoned"]}}}}}
    (tmp_path / "t.json").write_text(json.dumps([tree, {"chat_messages": [{"sender": "human", "text": "q", "created_at": "2024"}]}]))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "odd.json").write_text('{"x": 1}')
    (tmp_path / "chat.txt").write_text("2024-01-01 10:00 Ann\nhello\nthere\n2024-01-01 10:05 Bo\nhey\n")
    got = exports.read_exports(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["source"], r["entry_no"] or 0)):
        by.setdefault(r["source"], []).append((r["text"], r["speaker"], r["problem"]))
    assert by["t.json"] == [("hi", "user", None), ("yo", "assistant", None), ("q", "user", None)]
    assert by["bad.json"] == [(None, None, "not JSON")] and by["odd.json"] == [(None, None, "unknown structure")]
    assert by["chat.txt"] == [("hello\nthere", "Ann", None), ("hey", "Bo", None)]
    (tmp_path / "m.jsonl").write_text('{"id":"k","ts":"1700000000000","role":"user","text":"a"}\nnot json\n{"ts":"2024-01-01T00:00:00Z","role":"assistant","text":"b"}\n{"ts":"1","role":"tool","text":"c"}\n')
    m = {r["text"]: r for r in exports.read_messages(spark, str(tmp_path / "m.jsonl")).collect()}
    assert set(m) == {"a", "b"} and m["a"]["epoch"] == 1.7e9 and m["b"]["epoch"] == 1704067200.0


def test_line_chat_forms():
    from sparkivist.sources import exports

    chat = "2026.07.15 21:03 Anna\nhi\n2026/7/15 21:04:05\nno name\n2026-07-15 21:05 Bo\nbye: now\n"
    assert exports.line_chat_entries(chat) == [("hi", "Anna", "2026.07.15 21:03", "line_chat"), ("no name", None, "2026/7/15 21:04:05", "line_chat"), ("bye: now", "Bo", "2026-07-15 21:05", "line_chat")]
    long = "A speaker with a name of more than thirty-one characters"
    assert exports.line_chat_entries(f"Anna: hello\n{long}: at 9:30\nBo：x: y\nempty:\nplain\n") == [("hello", "Anna", None, "line_chat"), ("at 9:30", long, None, "line_chat"), ("x: y", "Bo", None, "line_chat")]


def test_timelines_keep_and_date_every_part(spark, tmp_path):
    from sparkivist.sources import exports

    text = "# Log 2026-07-01\nbefore\n\n## 2026.07.03 one\na\n\n## two\n> 7/22/2026 12:54\nb\n\n## three\nc\n"
    got = [(e[0].split("\n")[-1], e[2]) for e in exports.timeline_entries(text)]
    assert got == [("before", "2026-07-01"), ("a", "2026-07-03"), ("b", "2026-07-22"), ("c", "2026-07-01")]
    assert exports.timeline_entries("## 7.29 x\ny", year=2025)[0][2] == "2025-07-29"
    assert exports.chunk_date("2026-01-02.md", "<!-- 写于 2026-01-03T00:10:00+08:00 -->\nx") == ("2026-01-03", "2026-01-03T00:10:00+08:00")
    assert exports.chunk_date("a.md", "3/5/2026") is None and exports.chunk_date("a.md", "a paragraph that speaks of something on 2026-01-02") is None
    assert exports.parse_export("notes.md", "only prose\n")[0] == [("only prose", None, None, "timeline")]
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "window_1.md").write_text("a summary")
    (tmp_path / "window_1.md").write_text("> 3/5/2026 10:00\nhello\n\n## later\n> 3/9/2026\nyo")
    (tmp_path / "window_2.md").write_text("> 7/22/2026 10:00\nproof of the order")
    rows_ = {(r["layer"], r["window_no"], r["chunk_no"]): r["local_date"] for r in exports.read_corpus(spark, str(tmp_path)).collect()}
    assert rows_ == {("index", 1, 0): "2026-03-05", ("timeline", 1, 0): "2026-03-05", ("timeline", 1, 1): "2026-03-09", ("timeline", 2, 0): "2026-07-22"}


def test_odd_items_leave_the_rest_of_an_export(spark, tmp_path):
    import json

    from sparkivist.sources import exports

    said = [{"chat_messages": [{"sender": "human", "text": t}]} for t in ("a", "b", "c")]
    (tmp_path / "e.json").write_text(json.dumps([said[0], 7, said[1], {"x": 1}, said[2]]))
    got = exports.read_exports(spark, str(tmp_path)).collect()
    assert [r["text"] for r in got if not r["problem"]] == ["a", "b", "c"]
    assert [r["problem"] for r in got if r["problem"]] == ["item 1: unknown structure", "item 3: unknown structure"]


def test_streams(spark, tmp_path):
    from sparkivist.streaming import flows

    src = str(tmp_path / "in")
    spark.createDataFrame([("r", 0.0), ("r", 100.0), ("r", 43200.0), ("s", 5.0)], "record_id string, at double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("record_id string, at double").parquet(src)
    q = flows.cooled_deliveries(stream).writeStream.format("memory").queryName("cool").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("cool")) == [("r", 0.0, True), ("r", 100.0, False), ("r", 43200.0, True), ("s", 5.0, True)]
    src2 = str(tmp_path / "in2")
    spark.createDataFrame([("a", 1.0, 20000), ("a", 2.0, 15000), ("a", 3.0, 29999), ("b", 1.0, 10)], "session string, at double, chars long").coalesce(1).write.parquet(src2)
    stream = spark.readStream.schema("session string, at double, chars long").parquet(src2)
    q = flows.recall_triggers(stream).writeStream.format("memory").queryName("trig").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("trig")) == [("a", 2.0, 35000)]


def test_core_runs_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("sparkivist.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "sparkivist.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "bm25_topk" in entry.queries() and not any(k.startswith("p1_") for k in entry.queries())


def test_one_scan_gives_the_query_and_the_graph(spark):
    from sparkivist.operators import index

    docs = spark.createDataFrame([(i, t, "ab"[i % 2], i % 5 > 0) for i, t in enumerate(["The Winter Trip", "winter trips and tea", None, "", "tea for the trip", "Trip 冬天", "a winter far away", "trip trip trip"])], "doc_id long, text string, layer string, live boolean")
    built, scanned = index.build(docs), index.scan(docs, "winter trip", grams=True)
    assert rows(scanned.select("doc_id", "grams")) == rows(built.select("doc_id", "grams"))
    assert rows(scanned.drop("grams")) == rows(index.scan(docs, "winter trip")) == rows(index.hits(built, "winter trip"))
    stored = index.build(docs.withColumn("_visible", F.col("live")), keep=("layer", "_visible"))
    assert rows(ranking.hybrid_retrieve(docs, "winter trip", visible=F.col("live"))) == rows(ranking.retrieve_indexed(stored, "winter trip"))
