"""Small cases of the index, span, chain, evidence and state operators: ties, nulls, cycles and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkivist.functions import bigrams
from sparkivist.operators import chains, evidence, index, ledger, ranking, sessions, spans, state, vectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


TEXTS = [(1, "Abcab", "x"), (2, None, "x"), (3, "", "x"), (4, "龍龍龍 a_b", None), (5, "zz-zz!", "y"), (6, "𠮷野家", "y")]


def test_index_by_hand(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, dl string")
    got = {r["doc_id"]: r for r in index.build(docs.drop("dl")).collect()}
    want = {}
    for g in ("ab", "bc", "ca"):
        want[ord(g[0]) << 21 | ord(g[1])] = g
    assert [want[g] for g in index.unpacked(got[1]["grams"]).tolist()] == ["ab", "bc", "ca"]
    assert np.frombuffer(got[1]["counts"], dtype=np.int32).tolist() == [2, 1, 1] and got[1]["dl"] == 4
    assert got[1]["cased"] is not None and got[4]["cased"] is None and got[2]["dl"] == got[3]["dl"] == 0
    assert got[4]["dl"] == 5 and got[6]["dl"] == 2
    assert index.build(docs.drop("dl").limit(0)).count() == 0


def test_hits_equal_the_scan_of_the_texts(spark):
    docs = spark.createDataFrame(TEXTS + [(7, "ab Ab AB aB " * 50, "z")], "doc_id long, text string, source string")
    for q in ("abc AB", "龍龍", "a", ""):
        a = rows(index.scan(docs, q, keep=("source",)))
        assert a == rows(index.hits(index.build(docs, keep=("source",)), q, keep=("source",)))
    assert rows(index.document_frequencies(index.build(docs), 2)) == [((97 << 21) | 98, 2)]


def test_replaced_index_equals_a_new_one(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string").drop("source")
    changed = spark.createDataFrame([(1, "new text"), (9, "more")], "doc_id long, text string")
    new = index.replace(index.build(docs), changed, spark.createDataFrame([(5,)], "doc_id long"))
    want = docs.where("doc_id NOT IN (1, 5)").unionByName(changed)
    assert rows(new) == rows(index.build(want))


def test_index_table_on_disk(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string").drop("source")
    index.write(docs, str(tmp_path / "i"))
    assert rows(index.read(spark, str(tmp_path / "i"))) == rows(index.build(docs))


def test_edges_against_brute_force(spark):
    texts = {i: t for i, t in enumerate(["alpha beta", "beta gamma", "gamma delta", "", None, "alpha", "quite else", "delta force", "force majeure"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    grams = {i: set(bigrams.query_bigrams(t or "")) for i, t in texts.items()}
    n, df = len(texts), {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    want = {}
    for i in grams:
        best = sorted((-round(sum(np.log((n - df[x] + 0.5) / (df[x] + 0.5) + 1) for x in grams[i] & grams[j] if 2 <= df[x] <= 3), 6), j) for j in grams if j != i)
        want |= {(i, j, k + 1): -s for k, (s, j) in enumerate([x for x in best if x[0] < 0][:5])}
    got = {(r["src"], r["dst"], r["rank"]): r["strength"] for r in ranking.graph_edges(docs).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    strings = ranking.graph_edges(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert {(int(r["src"][1:]), int(r["dst"][1:]), r["rank"]) for r in strings.collect()} == set(want)
    assert ranking.graph_edges(docs.limit(0)).count() == 0


def test_retrieval_hides_and_admits(spark):
    data = [(i, "common words here " + "x" * i, "timeline", True, 0.1) for i in range(20)] + [(50, "zebra crossing", "timeline", True, 0.1), (51, "zebra crossing now", "index", False, 0.9), (52, "qqwwqq", "index", True, 0.95)]
    docs = spark.createDataFrame(data, "doc_id long, text string, layer string, live boolean, s double")
    plain = {r["doc_id"] for r in ranking.hybrid_retrieve(docs, "zebra").collect()}
    shown = {r["doc_id"] for r in ranking.hybrid_retrieve(docs, "zebra", visible=F.col("live")).collect()}
    assert {50, 51} <= plain and 50 in shown and 51 not in shown
    scores = docs.select("doc_id", F.col("s").alias("score"))
    with_floor = {r["doc_id"] for r in ranking.hybrid_retrieve(docs, "zebra", visible=F.col("live"), vectors=scores, floor=0.8).collect()}
    without = {r["doc_id"] for r in ranking.hybrid_retrieve(docs, "zebra", visible=F.col("live"), vectors=scores).collect()}
    assert 52 in with_floor and 51 not in with_floor and 52 not in without
    assert ranking.hybrid_retrieve(docs, "jjjj").count() == 0 and ranking.hybrid_retrieve(docs.limit(0), "zebra").count() == 0


def test_running_total_over_ranges(spark):
    df = spark.createDataFrame([(i % 7, i, i) for i in range(200)], "g int, v int, c int").repartition(5)
    got = [r["running"] for r in ranking.running_total(df, "c", F.asc("g"), F.asc("v")).orderBy("g", "v").collect()]
    assert got == np.cumsum([i for g in range(7) for i in range(200) if i % 7 == g]).tolist()


def test_moves_are_split_from_the_rest(spark):
    old = spark.createDataFrame([("p", "t"), ("q", "u"), ("q", "u")], "place string, hash string")
    new = spark.createDataFrame([("r", "t"), ("r", "t"), ("r", "t"), ("q", "u"), ("s", "u")], "place string, hash string")
    assert rows(ledger.file_difference(old, new)) == [("p", "t", "moved_out", 1), ("q", "u", "moved_out", 1), ("r", "t", "added", 2), ("r", "t", "moved_in", 1), ("s", "u", "moved_in", 1)]


def test_an_empty_line_holds_a_block_open(spark):
    df = spark.createDataFrame([("c", 1, 0, 0.0), ("c", 2, 5, 4000.0), ("c", 3, 900, 4001.0)], "g string, o int, n int, t double")
    assert [r["block_no"] for r in sessions.sized_blocks(df, "g", "o", "n", "t").orderBy("o").collect()] == [0, 1, 2]


def test_vectors_of_two_widths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="different widths"):
        vectors.nearest(df, df, 1).collect()


def test_spans(spark):
    docs = spark.createDataFrame([(1, "aaa b"), (2, None), (3, ""), (4, "x\n\n# h\nbody\n\n\ntail"), (5, "\n\nlate\n")], "doc_id long, text string")
    assert rows(docs.select("doc_id", spans.occurrences_of("text", "aa"))) == [(1, [0, 1]), (2, []), (3, []), (4, []), (5, [])]
    assert rows(spans.covered_share(docs, ["aa", "a b"])) == [(1, 5, 1.0)]
    assert rows(docs.select("doc_id", spans.common_substring("text", "zaab"))) == [(1, 2), (2, 0), (3, 0), (4, 1), (5, 1)]
    got = rows(spans.anchors(docs))
    assert [r for r in got if r[0] == 4] == [(4, 1, 0, 3), (4, 2, 3, 7), (4, 3, 7, 14), (4, 4, 14, 18)]
    assert [r for r in got if r[0] == 5] == [(5, 1, 0, 7)] and not [r for r in got if r[0] in (2, 3)]
    assert rows(spans.locate_quotes(docs, ["a a", "body"])) == [(1, "a a", 2, None, None), (4, "body", 1, 7, 11)]
    with pytest.raises(ValueError):
        spans.locate_quotes(docs, ["x"])
    fenced = spark.createDataFrame([(1, "p\n\n```\na\n\nb\n```\nq\nr\n\n```\nopen\n\nend")], "doc_id long, text string")
    assert [(r["start"], r["end"], r["fenced"]) for r in spans.blocks(fenced).orderBy("block_no").collect()] == [(0, 1, False), (3, 15, True), (16, 19, False), (21, 34, True)]
    long = spark.createDataFrame([(1, "One. Two with a term. Three. Four.")], "doc_id long, text string")
    assert spans.excerpt(long, "term", 25).first()["excerpt"] == "Two with a term. Three."
    assert spans.excerpt(long, "term", 5).first()["excerpt"] == "Two with a term."
    for f in (spans.anchors, lambda d: spans.blocks(d), lambda d: spans.excerpt(d, "x", 9)):
        assert f(docs.limit(0)).count() == 0


def test_chain_operations(spark):
    led = spark.createDataFrame([("a" * 16, "b" * 16), ("b" * 16, "c" * 16), ("d" * 16, None), ("e" * 16, "f" * 16), ("f" * 16, "e" * 16)], "hash string, replaced_by string")
    rec = spark.createDataFrame([(x * 16, f"text of {x}") for x in "abcdg"] + [("g" * 16, "text of g"), (None, "nobody")], "record_id string, text string")
    assert len(rows(chains.chain_members(led))) == 3
    assert rows(chains.hit_chains(led, spark.createDataFrame([("a" * 16,), ("c" * 16,), ("c" * 16,)], "record_id string"))) == [("c" * 16, 2)]
    plan = {r["quote"]: (r["verdict"], r["record_id"]) for r in chains.retraction_plan(rec, led, [("text of g", None), ("text of", None), ("of c", None), ("of a", None), ("text of", "c" * 16)]).collect() if r["quote"] != "text of"}
    assert plan == {"text of g": ("retract", "g" * 16), "of c": ("retract", "c" * 16), "of a": ("none", None)}
    wish = spark.createDataFrame([("c" * 16, "g" * 16), ("c" * 16, "a" * 16), ("a" * 16, "g" * 16), ("c" * 16, "c" * 16), ("c" * 16, "d" * 16), ("c" * 16, "9" * 16), ("no", "c" * 16), ("g" * 16, "b" * 16)], "old string, new string")
    verdicts = {(r[0][0], r[1][0]): r[2] for r in rows(chains.supersession_plan(rec.withColumn("record_id", F.translate("record_id", "g", "8")), led, wish.select(F.translate("old", "g", "8").alias("old"), F.translate("new", "g", "8").alias("new"))))}
    assert verdicts == {("c", "8"): "ok", ("c", "a"): "cycle", ("a", "8"): "already_superseded", ("c", "c"): "self_link", ("c", "d"): "retracted_new", ("c", "9"): "unknown_new", ("n", "c"): "malformed", ("8", "b"): "taken"}
    two = spark.createDataFrame([("a", "superseded", None, "b"), ("b", "current", "a", None), ("c", "superseded", None, None), ("d", "current", None, "z"), ("p", "superseded", "q", "q"), ("q", "superseded", "p", "p"), ("o", "current", "a", None)], "rid string, status string, supersedes string, superseded_by string")
    assert rows(chains.integrity_codes(two)) == [("c", "status_mismatch"), ("d", "dangling"), ("d", "status_mismatch"), ("o", "one_way"), ("p", "cycle"), ("q", "cycle")]
    assert chains.integrity_codes(two.limit(0)).count() == 0 and chains.chain_members(led.limit(0)).count() == 0


def test_cursor_and_firing(spark):
    m = spark.createDataFrame([("l", "a", 1.0, "user", 10), ("l", "b", 2.0, "assistant", 10), ("l", "c", 2.0, "user", 10), ("l", "d", 3.0, "user", 10), ("l", "e", None, "user", 10), ("n", "x", 1.0, "user", 99)], "source_id string, key string, at double, role string, chars int")
    cur = state.advanced_cursor(m.where("at <= 2 AND key <> 'c' AND source_id = 'l'"))
    assert rows(cur) == [("l", 2.0, ["b"])]
    assert rows(state.after_cursor(m, cur).select("source_id", "key")) == [("l", "c"), ("l", "d"), ("n", "x")]
    day = F.lit("2024-01-02")
    assert rows(state.fire(m, day, "2024-01-02", 4.0, 25, 99, 60.0)) == [("l", "2024-01-02", 2, 2, False, True), ("n", "2024-01-02", 1, 0, False, False)]
    assert rows(state.fire(m, day, "2024-01-03", 4.0, 25, 99, 60.0))[1][-1] is True
    assert state.fire(m.limit(0), day, "2024-01-02", 4.0, 25, 99, 60.0).count() == 0


def test_folds_of_operations_and_requests(spark):
    ops = spark.createDataFrame([("i", 1, 1, "update"), ("i", 2, 2, "open"), ("i", 3, 3, "update"), ("j", 1, 4, "open"), ("j", 2, 5, "close"), ("j", 3, 6, "update"), ("k", 1, 7, "close"), ("k", 1, 8, "open"), (None, 1, 9, "open")], "item string, at long, seq long, action string")
    assert rows(state.open_items(ops)) == [("i", 2, 3, 1), ("k", 1, None, 0)]
    req = spark.createDataFrame([("s", "1", "a"), ("s", "1", "a"), ("s", "2", "a"), ("s", "2", None), ("s", "3", None), (None, "4", "a")], "s string, k string, t string")
    assert rows(state.idempotent(req, ["s", "k"], ["t"], [])) == [("s", "1", 2, "repeat"), ("s", "2", 2, "conflict"), ("s", "3", 1, "single")]


def test_evidence_on_edges(spark):
    docs = spark.createDataFrame([(1, "the trip was marked wrong", "s", "timeline"), (2, "wrong " + "x" * 40 + " trip", "s", "timeline"), (3, "wrong and sorry, no more", "s", "index"), (4, None, None, None)], "doc_id long, text string, source string, layer string")
    assert [r[0] for r in docs.orderBy("doc_id").select(evidence.demoted("text", "trip", ["wrong", "sorry"])).collect()] == [True, False, True, False]
    assert rows(evidence.vector_gate(docs.select(F.lit(None).cast("double").alias("score")), 0.3)) == [("absent", 0, 0), ("calibrated", 0, 0), ("uncalibrated", 0, 0)]
    assert {r["admitted"] for r in evidence.gate_variants(docs.limit(0), "trip", ["x"]).collect()} == {0}
    one = spark.createDataFrame([(1, 1, 0.5, True), (2, 1, 0.4, None), (2, 2, 0.4, False)], "query_id long, rank long, score double, relevant boolean")
    assert [(r["kept"], r["relevant"], r["surfaced"]) for r in evidence.margin_sweep(one, 0.1, [0.0, 1.0]).orderBy("margin").collect()] == [(2, 1, 2), (1, 1, 1)]
    votes = spark.createDataFrame([("a", "她她她她她他"), ("b", "她"), ("c", None), (None, "她她她她她她")], "who string, text string")
    assert rows(evidence.pronoun_vote(votes, "who", ["他", "她"])) == [("a", "她", 6), ("b", None, 1), ("c", None, 0)]
