"""Queries read texts whole: small tables whose rows differ only beyond an opening."""

import random

import numpy as np
import pytest

from lexmill.operators import metrics as M
from lexmill.operators import qa as QA
from lexmill.plans.catalog import QUERIES


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over documents of the given texts, all of one source and with labels."""

    def rows(name, texts, **tables):
        docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        tables = {
            "documents": spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
            "labels": spark.createDataFrame([(i, 1, 0) for i, _ in enumerate(texts)], "doc_id bigint, quality int, toxic int"),
        } | tables
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return QUERIES[name](spark, str(tmp_path)).collect()

    return rows


def test_near_duplicates_compare_whole_texts(run):
    opening = "The driver must stop at the line. " * 8
    tails = ["0123456789" * 60, "abcdefghij" * 60]
    assert len(opening) > 200
    assert sorted(r["ord"] for r in run("j14_near_duplicates", [f"May I?\n{opening}{t}" for t in tails])) == [0, 1]


def test_near_duplicates_equal_plain_comparison(spark):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        if i % 2 and rows:
            _, q, a, _ = draw.choice(rows)
            at = draw.randrange(len(a))
            rows.append((i, q.upper(), a[:at] + "§" * draw.randrange(80) + a[at:], "p"))
        else:
            rows.append((i, "".join(draw.choices("abcdeİ ", k=draw.randrange(1, 30))), "".join(draw.choices("abcdefghijklmnop qrstuvwxyz§ß", k=draw.randrange(1, 400))), "p"))
    kept = []
    for row in rows:
        if not any(QA.ratio(row[1], k[1]) >= 0.85 and QA.ratio(row[2], k[2]) >= 0.85 for k in kept):
            kept.append(row)
    got = QA.near_duplicates_removed(spark.createDataFrame(rows, "ord int, question string, answer string, paragraph_id string")).collect()
    assert sorted(r["ord"] for r in got) == [k[0] for k in kept] and 30 <= len(kept) < 60


def test_bounds_of_the_ratio_leave_no_pair_out():
    draw = random.Random(8)
    near = 0
    for n in range(600):
        words = ["".join(draw.choices("etaoinsrhzqx"[: draw.choice((3, 8, 12))], k=draw.randrange(1, 9))) for _ in range(draw.choice((5, 20, 90)))]
        b = " ".join(words)
        for _ in range(draw.randrange(len(words) // 3 + 1)):
            words[draw.randrange(len(words))] = draw.choice(words + ["", "Q", "etaoin zqx"])
        a = " ".join(words)[draw.choice((0, 0, 1, 7)) :]
        kept, text, at = QA._Kept(True), QA._Text(a), np.array([0])
        kept.add(QA._Text(b))
        for threshold in (0.85, 0.6):
            want = QA.ratio(a, b) >= threshold
            passed = len(kept.by_runs(kept.by_counts(kept.by_size(None, text, threshold), text, threshold), text, threshold)) and kept.room(0, text, threshold)
            assert QA._reaches(text.low, b.lower(), threshold) == want and bool(passed and kept.alike(0, text, threshold)) == want
            near += want
    assert 300 < near < 1100


def test_far_pairs_are_not_compared(monkeypatch):
    # Texts of one length and like letters: the bounds settle them without SequenceMatcher.
    draw = random.Random(2)
    syllables = ["th", "er", "ou", "ing", "an", "on", "re", "ed", "ly", "st"]
    texts = [" ".join("".join(draw.choices(syllables, k=draw.randrange(1, 5))) for _ in range(120)) for _ in range(40)]
    monkeypatch.setattr(QA.difflib, "SequenceMatcher", None)
    kept = QA._Kept(True)
    for t in map(QA._Text, texts):
        at = kept.by_counts(kept.by_size(None, t, 0.85), t, 0.85)
        assert not any(kept.room(k, t, 0.85) and kept.alike(k, t, 0.85) for k in at.tolist())
        kept.add(t)


def test_similarity_reads_whole_texts(run):
    opening = "The driver must stop.\nSame opening of both."
    texts = [opening, opening + " " + " ".join(f"tail{i}" for i in range(50))]
    for name in ("a07_bleu_rouge", "a09_word_error_rate", "s10_ratcliff_ratio", "a08_whole_texts"):
        short, long = (r.asDict() for r in sorted(run(name, texts), key=lambda r: r["ord"]))
        assert {k: v for k, v in short.items() if k != "ord"} != {k: v for k, v in long.items() if k != "ord"}, name
    # Only the sentence, of four words, is beyond question and answer.
    assert [r["wer"] for r in sorted(run("a09_word_error_rate", texts), key=lambda r: r["ord"])] == [round(4 / 12, 9), round(4 / 62, 9)]
    assert {r["n"]: r["total"] for r in run("a06_answer_diversity", texts)}[1] == 4 + 54


def test_cosine_of_a_text_without_words(run):
    # As in the SQL: 0 / 0 if only the sentence or only the question has words, 0 if neither has.
    got = {r["ord"]: r["cosine"] for r in run("a08_tfidf_cosine", ["? !\nThe driver stops", ".\n!", "Driver stops.\nYes", ". driver stops\nYes"])}
    assert [str(got[i]) for i in range(4)] == ["nan", "0.0", "1.0", "nan"]


def test_bit_vectors_equal_tables():
    draw = random.Random(9)
    for _ in range(300):
        a, b = (draw.choices("abcde", k=draw.randrange(90)) for _ in "ab")
        common, edits = {}, {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                same = i and j and a[i - 1] == b[j - 1]
                common[i, j] = 0 if not (i and j) else common[i - 1, j - 1] + 1 if same else max(common[i - 1, j], common[i, j - 1])
                edits[i, j] = i + j if not (i and j) else min(edits[i - 1, j - 1] + (not same), edits[i - 1, j] + 1, edits[i, j - 1] + 1)
        assert M._lcs(a, b) == common[len(a), len(b)] and M._edits(a, b) == edits[len(a), len(b)]


def test_validator_reads_whole_answers(run):
    opening = "The driver must stop at the line before the sign. "
    texts = [f"Where does a driver stop?\n{opening * 8}{end}" for end in ("", opening * 4, "xxx")]
    assert [r["reject_reason"] for r in sorted(run("f02_six_stage_validator", texts), key=lambda r: r["ord"])][1:] == ["answer too long", "placeholder"]


def test_whole_html_is_quoted(spark, run):
    pages = spark.createDataFrame([(1, "http://a.example", "x" * 90 + '<a href="b">')], "page_id bigint, url string, html string")
    assert run("s29_dot_quote", ["one"], pages=pages)[0]["quoted"] == '"' + "x" * 90 + '<a href=\\"b\\">"'


def test_segments_of_the_reference_sizes(run):
    lines = [f"line {i} has five words" for i in range(12)]
    got = run("g02_padded_segments", ["\n".join(lines)])[0]
    assert (got["segments"], got["width"], got["mask_sum"]) == (64, 128, 60) and got["id_sum"] == sum(len(w) for s in lines for w in s.split())
    assert run("f13_segments", ["\n".join(lines)])[0]["segments"] == "|".join(lines[:10])


def test_distinct_parts_carry_no_summaries(spark, sf_dir):
    # A row for each part must not hold a summary of quantities.
    plan = QUERIES["a35_approximate_distinct"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and not any("percentile_approx" in s for s in plan.split("\n") if "l_partkey" in s.split("functions=")[0] and "Aggregate" in s)


def test_distinct_parts_of_a_null_flag(spark, run):
    rows = [(flag, part, 1.0 + part % 50) for part in range(1500) for flag in ("A", None)] + [("A", None, 20.0)]
    got = run("a35_approximate_distinct", ["one"], lineitem=spark.createDataFrame(rows, "l_returnflag string, l_partkey bigint, l_quantity double"))
    assert {tuple(r) for r in got} == {("A", 1500, True, True), (None, 1500, True, True)} and len(got) == 2
