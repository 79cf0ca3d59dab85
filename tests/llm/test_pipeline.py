"""The pipeline against its stages' brute-force forms, and every stage on odd and empty tables."""

import random
import re
import string
from collections import defaultdict

import corpus_pipeline
import __spark_entry__
from lexmill.llm import secret_scan

from .test_dedup import alike, slow_set
from .test_text import check_packing


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", "op1_simhash", "op2_packing", "op10_warc"} <= names and set(__spark_entry__.oracle_sql()) <= names
    assert all(isinstance(v, str) for v in __spark_entry__.oracle_sql().values())


def test_run(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [r for r in rows if any(map(str.isalpha, r[1]))]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    roots = alike([slow_set(r[1]) for r in rows])
    best = {}
    for r, root in zip(rows, roots):
        best[root] = min(best.get(root, r), r)
    net = secret_scan.fit(spark.createDataFrame(list(best.values()), spark.read.parquet(f"{sf_dir}/documents.parquet").schema))
    want = [(r[0], secret_scan.redacted(r[1], net)) for r in best.values()]
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), want)


def test_stages_on_odd_and_empty_tables(spark, docs, empty, sf_dir):
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns and out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() >= table.count()


def test_very_long_texts(spark, docs, tmp_path):
    """Long white space, a long run of key characters, a long text and its near copy."""
    words = [f"w{i % 700}x{i // 700}" for i in range(120_000)]
    rows = [
        (100, " " * 1_000_000 + "the end", "en", "s", 1), (101, "a " + "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=1_200_000)), "en", "s", 1), (102, " ".join(words), "en", "s", 1), (103, " ".join(words[:-900]) + " other end", "en", "s", 1),
    ]
    table = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    assert {100, 101, 102} <= kept and 103 not in kept
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert sum(r["length"] for r in got if r["doc_id"] == 102) == tokens[102] > 120_000 and tokens[101] < 100
