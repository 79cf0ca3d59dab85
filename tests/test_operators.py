"""Operators: golden values, properties and boundaries."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import boundary as B
from lexmill.operators import graph as G
from lexmill.operators import kge as K
from lexmill.operators import metrics as M
from lexmill.operators import qa as QA
from lexmill.operators import sampling as P
from lexmill.operators.order import global_index
from lexmill.sources import html as H
from lexmill.sources import readers as R
from lexmill.sources import writers as W
from lexmill.streaming import jobs as J


def test_confusion_golden(spark):
    rows = spark.createDataFrame([("m", "yes", "yes"), ("m", "yes", "no"), ("m", "no", "no"), ("m", "no", "no")], "model string, y_true string, y_pred string")
    r = M.confusion_metrics(rows, ["model"]).first()
    assert (r["accuracy"], r["balanced_accuracy"], r["precision"], r["recall"], r["f1_macro"], r["f1_micro"], r["mcc"]) == (0.75, 0.75, 0.833333, 0.75, 0.733333, 0.75, 0.57735)


def test_threshold_sweep_golden(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.2), (False, 0.4)], "label boolean, score double")
    r = M.threshold_sweep(rows).first()
    assert r["best_youden"] == 1 and r["youden_threshold"] == 0.401


def test_paired_t_against_published_values(spark):
    # Differences of mean 2 and sample deviation 1 over 4 pairs: t is 4.
    rows = spark.createDataFrame([("g", 3.0, 0.0), ("g", 1.0, 0.0), ("g", 3.0, 1.0), ("g", 2.0, 0.0)], "g string, a double, b double")
    r = M.paired_t(rows, ["g"]).first()
    assert r["n"] == 4 and r["mean_diff"] == 2 and r["t"] == pytest.approx(2 / (0.816496580927726 / 2))
    p = spark.range(1).select(M.t_probability(F.lit(4.35), F.lit(8.0)).alias("p"), M.t_probability(F.lit(1.76), F.lit(8.0)).alias("q")).first()
    assert p["p"] < 0.01 and p["q"] == pytest.approx(0.1164, abs=1e-3)


def test_text_similarity(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c", "x y"), (3, "", "")], "k int, r string, c string")
    got = {r["k"]: r for r in M.bleu(rows, "k", "r", "c").join(rows.select("k", M.rouge_l("r", "c").alias("rouge"), M.word_error_rate("r", "c").alias("wer")), "k").collect()}
    assert got[1]["bleu"] == 1 and got[1]["rouge"] == 1 and got[1]["wer"] == 0
    assert got[2]["bleu"] == 0 and got[2]["rouge"] == 0 and got[2]["wer"] == 1
    assert got[3]["bleu"] == 0 and got[3]["wer"] == 0


def test_global_index_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = global_index(rows, [F.col("k")], "i").collect()
    assert sorted((r["k"], r["i"]) for r in got) == [(i, i) for i in range(1000)]


def test_global_index_of_many_rows_in_many_partitions(spark):
    rows = spark.range(0, 300_000, 1, 7).select((F.col("id") * 7919 % 300_007).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = global_index(rows, [F.col("k")], "i").agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(got) == (300_000, 300_000, 0, 299_999)
    pairs = global_index(rows, [F.col("k")], "i")
    assert pairs.alias("a").join(pairs.alias("b"), F.expr("a.i + 1 = b.i")).filter("a.k >= b.k").count() == 0


def test_splits_are_disjoint_and_whole(spark):
    rows = spark.range(500).select("id", (F.col("id") % 23).cast("string").alias("g"))
    got = P.group_split(rows, "g", 42, 0.16).collect()
    assert len(got) == 500
    train, test = ({r["g"] for r in got if r["split"] == s} for s in ("train", "test"))
    assert not train & test and len(train) == int(23 * 0.84)
    again = P.group_split(rows, "g", 42, 0.16).collect()
    assert {(r["id"], r["split"]) for r in got} == {(r["id"], r["split"]) for r in again}


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "h"), (2, "h"), (3, "i")], "ord int, qa_hash string")
    once = QA.first_of_each(rows)
    assert sorted(r["ord"] for r in once.collect()) == [1, 3] == sorted(r["ord"] for r in QA.first_of_each(once).collect())


def test_near_duplicates_are_greedy(spark):
    rows = spark.createDataFrame(
        [(1, "May a driver turn here?", "No, turning is not allowed here.", "p"), (2, "May a driver turn there?", "No, turning is not allowed there.", "p"), (3, "May a driver turn here?", "No, turning is not allowed here.", "q")],
        "ord int, question string, answer string, paragraph_id string",
    )
    assert sorted(r["ord"] for r in QA.near_duplicates_removed(rows).collect()) == [1, 3]


def test_paths_and_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    paths = [r["path"] for r in G.simple_paths(edges, 3).collect()]
    assert all(len(set(p.split(">"))) == len(p.split(">")) for p in paths) and len(paths) == 6
    assert {(r["id"], r["depth"]) for r in G.reachable(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_graphs_that_share_nodes_are_an_error(spark):
    a = spark.createDataFrame([("1", "k", "l", 0)], "id string, kind string, label string, ord long")
    with pytest.raises(Exception, match="share nodes"):
        G.disjoint_union(a, a).collect()


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("1", "sign", "old", 1), ("1", "sign", "new", 2)], "id string, kind string, label string, ord long")
    assert [r["label"] for r in G.upserted(rows).collect()] == ["new"]


def test_link_ranks(spark):
    entities = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(7, 2, [1.9]), (8, 0, [1.9])], "qid long, t long, target array<double>")
    assert {r["qid"]: r["rank"] for r in K.link_ranks(queries, entities).collect()} == {7: 1, 8: 3}


def test_model_sees_each_text_once(spark, tmp_path):
    rows = spark.createDataFrame([("x",), ("x",), (None,)], "t string")
    got = B.memoised_apply(rows, "t", lambda texts: [f"{len(texts)}" for _ in texts], "n").collect()
    assert [r["n"] for r in got if r["t"]] == ["1", "1"] and len(got) == 3
    assert B.value_of("v/2 + 1", {"v": 4}) == 3 and B.value_of("__import__('os')") is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q", "answer": "a"}\n\n{"question": "bro\n')
    assert [r["question"] for r in R.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == ["q"]
    (tmp_path / "cut.jsonl").write_text('{"question": "q", "label": "yes"}, {"question": "cu\n')
    assert [r["label"] for r in R.read_jsonl_repaired(spark, str(tmp_path / "cut.jsonl")).collect()] == ["yes"]
    (tmp_path / "exam.json").write_text(json.dumps([{"id": "1", "category": "multiple_choice", "question": "Q", "options": ["x", "y"], "answers": ["y"]}, {"id": "2", "image": "i.png"}]))
    assert [(r["id"], r["expected"]) for r in R.read_german(spark, str(tmp_path / "exam.json")).collect()] == [("1", ["y"])]
    (tmp_path / "at").mkdir()
    (tmp_path / "at/1.json").write_text(json.dumps({"FRAGEID": "9", "FrageText": {"de": "F"}, "AntwortText": {"de": [{"Text": "a"}, {"Text": "b"}, {"Text": "c"}]}, "AntwortRichtig": [True, False]}))
    assert [(r["id"], r["options"], r["expected"]) for r in R.read_austrian(spark, str(tmp_path / "at")).collect()] == [("9", ["a", "b"], ["a"])]
    (tmp_path / "t.txt").write_text("a <tr> r <tr> b\n# note\na <tr> b\n")
    assert [tuple(r) for r in R.read_triples(spark, str(tmp_path / "t.txt")).collect()] == [("a", "r", "b")]
    (tmp_path / "e.json").write_text('{"x": [1.0, 2.0]}')
    assert [(r["id"], r["v"]) for r in R.read_embeddings(spark, str(tmp_path / "e.json")).collect()] == [("x", [1.0, 2.0])]
    (tmp_path / "nsp.json").write_text('[{"text_a": "a", "label": 1}]')
    assert R.read_json_or_jsonl(spark, str(tmp_path / "nsp.json"), "text_a string, label int").first()["next_sentence_labels"] == 1


def test_writers(spark, tmp_path):
    W.write_jsonl(spark.createDataFrame([("q", "h")], "question string, qa_hash string"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).columns == ["question"]
    for x in (1, 2):
        W.append_ledger(spark.createDataFrame([(x,)], "f1 int"), str(tmp_path / "l"))
    W.append_ledger(spark.createDataFrame([(0.5, 3)], "loss double, f1 int"), str(tmp_path / "l"))
    assert sorted((r["f1"], r["loss"]) for r in R.read_ledger(spark, str(tmp_path / "l")).collect() if r["loss"] is None) == [(1, None), (2, None)]
    assert [(r["f1"], r["loss"]) for r in R.read_ledger(spark, str(tmp_path / "l")).filter("loss IS NOT NULL").collect()] == [(3, 0.5)]
    assert "- **total**: 3" in W.markdown_report("r", {"total": 3})


def test_a_malformed_line_stops_the_strict_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q"}\n{"question": "bro\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_jsonl_strict(spark, str(tmp_path / "a.jsonl")).collect()


def test_missing_entries_and_candidates_are_errors(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert [tuple(r) for r in G.required(rows.filter("k = 1"), table, "k").collect()] == [(1, "a")]
    with pytest.raises(Exception, match="no entry for 2"):
        G.required(rows, table, "k").collect()
    with pytest.raises(Exception, match="no other candidate"):
        P.hash_pick(rows, spark.createDataFrame([("x",)], "candidate string"), "k", "candidate", F.lit(True), 1).collect()


def test_pairs_in_blocks_are_all_pairs(spark):
    from lexmill.operators.order import pairs

    many, few = spark.range(57).withColumnRenamed("id", "a"), spark.range(23).withColumnRenamed("id", "b")
    got = sorted(map(tuple, pairs(many, few, 5).collect()))
    assert got == [(a, b) for a in range(57) for b in range(23)] == sorted(map(tuple, pairs(many, few).select("a", "b").collect()))


def test_batches_of_a_stream_are_appended_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    act = J.append_once(str(tmp_path / "ledger"))
    J.for_each_batch(J.stream_table(spark, str(tmp_path / "in")), act, str(tmp_path / "cp")).awaitTermination()
    act(spark.range(5), 0)  # the batch runs again
    assert R.read_ledger(spark, str(tmp_path / "ledger")).count() == 5


def test_statute_tree(spark):
    html = "<h2>Teil</h2><h3>§ 1 Ziel</h3><div>(1) Erster.</div><div>weiter</div><div>(2) Zweiter.<img src='p/b.png'></div><script>var t='</p>';</script><h3>Anlage 1</h3><div>weg</div>"
    rows = H.statute_rows(H.page_events(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("ord").collect()
    assert [(r["category"], r["paragraph_id"], r["sen_id"], r["text"]) for r in rows] == [("Teil", "§ 1", "1", "(1) Erster. weiter"), ("Teil", "§ 1", "2", "(2) Zweiter. <img>b.png</img>")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"question {i % 3}?", f"answer number {i % 3}", "yes", "p", 0.9) for i in range(9)], "question string, answer string, label string, paragraph_id string, quality_score double")
    rows.withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = J.first_wins(J.accepted(J.stream_table(spark, str(tmp_path / "in"))))
    J.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = []
    J.for_each_batch(J.stream_table(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 9


def test_labels_replace_ids(spark):
    texts = spark.createDataFrame([(1, "a <par>§ 1</par> b <par>§ 9</par>"), (2, "plain"), (3, "")], "k int, text string")
    nodes = spark.createDataFrame([("§ 1", "Ziel")], "id string, label string")
    assert {r["k"]: r["text"] for r in G.substituted(texts, ["k"], "text", "par", nodes).collect()} == {1: "a <par>Ziel</par> b <par>§ 9</par>", 2: "plain", 3: ""}
    assert {r["k"]: r["text"] for r in G.substituted(texts, ["k"], "text", "par", nodes, True).collect()}[1] == "a Ziel b <par>§ 9</par>"


def test_balanced_takes_the_first_of_each(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, "no").otherwise("yes").alias("label"))
    got = sorted((r["label"], r["id"]) for r in P.balanced(rows, "label", "id").collect())
    assert [i for lab, i in got if lab == "no"] == list(range(0, 100, 10)) and [i for lab, i in got if lab == "yes"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
