"""Hand-derived cases of tagging, segmentation, labels and scores."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import citations as C
from lexmill.functions import quality as Q
from lexmill.functions import text as X
from lexmill.functions import vectors as V
from lexmill.operators import sequences as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,tagged",
    [
        ("Zeichen 250 bis 252", "Zeichen <sign>250</sign>, <sign>251</sign>, <sign>252</sign>"),
        ("Zeichen 205 und 206", "Zeichen <sign>205</sign>, <sign>206</sign>"),
        ("ohne", "ohne"),
        ("", ""),
    ],
)
def test_signs(spark, text, tagged):
    assert value(spark, C.tag_signs(F.lit(text))) == tagged


def test_long_sign_numbers_stay_whole(spark):
    assert value(spark, C.tag_signs(F.lit("Zeichen 1000048 bis 1000049 und 12345678.9"))) == "Zeichen <sign>1000048</sign>, <sign>1000049</sign>, <sign>12345678.9</sign>"


def test_a_range_over_decimals_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(spark, C.tag_signs(F.concat(F.lit("Zeichen 1040.1 bis "), (F.col("id") + 1042).cast("string"))))


@pytest.mark.parametrize(
    "text,tagged",
    [
        ("§ 5 Absatz 2", "<par>§ 5</par>  Absatz <sen>2</sen>"),
        ("nach Absatz 2", "nach <par>§ 3</par> Absatz <sen>2</sen>"),
        ("§§ 36 bis 37", "<par><par>§ 36</par>, <par>§ 37</par></par>"),
        ("§§ 2 und 3", "§<par>§ 2</par> und 3"),
        ("Absatz 1 bis 3", "Absatz <sen>1</sen>, <sen>2</sen>, <sen>3</sen>"),
    ],
)
def test_paragraphs(spark, text, tagged):
    assert value(spark, C.tag_paragraphs(F.lit(text), F.lit("§ 3"))) == tagged


def test_tables(spark):
    assert value(spark, C.tag_tables(F.lit("Anlagen 1 bis 2 Abschnitt 4"))) == "Anlage <tab>1</tab>, Anlage <tab>2</tab> Abschnitt <sec>4</sec>"


def test_naming_a_paragraph_again_drops_its_sentences(spark):
    text = F.lit("<par>§ 5</par> <sen>1</sen> <par>§ 6</par> <par>§ 5</par> <sen>3</sen>")
    assert [tuple(p) for p in value(spark, C.reset_pairs(text, "par", "sen"))] == [("§ 5", "3")]
    assert value(spark, C.standalone(text, "par", "sen")) == ["§ 6"]
    assert value(spark, C.standalone(F.lit("<par>§ 5a</par>"), "par", "sen")) == []


@pytest.mark.parametrize("text,said", [("Incorrect, yes", "no"), ("maybe", "no"), ("not true", "yes")])
def test_polarity(spark, text, said):
    assert value(spark, X.polarity(F.lit(text))) == said


@pytest.mark.parametrize("a,b,same", [("abc", "xyz", "yes"), ("50 m", "50.0 meters", "yes"), ("1", "2", "no")])
def test_same_numbers(spark, a, b, same):
    assert value(spark, X.same_numbers(F.lit(a), F.lit(b))) == same


def test_an_answer_of_over_five_words_loses_a_fifth(spark):
    answer = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    sentence = answer + " " + " ".join(f"word{i}" for i in range(28))
    score = Q.quality_score(F.lit("q" * 60), F.lit(answer), F.lit(sentence), F.lit("yes"), F.lit("en"))
    assert value(spark, score) == pytest.approx(0.8)


def test_spans_lose_what_stands_before_the_first_marker(spark):
    text = F.lit("Intro § 1 foo § 2 bar")
    assert value(spark, S.marked_spans(text, S.PARAGRAPH)) == ["§ 1 foo", "§ 2 bar"]
    assert value(spark, S.marked_spans(text, S.PARAGRAPH, True)) == ["Intro", "§ 1 foo", "§ 2 bar"]


def test_greedy_chunks(spark):
    parts = F.array(*[F.lit(x) for x in ("a b", "c d e", "f", "g h i j k l")])
    assert value(spark, S.greedy_chunks(parts, 4)) == ["a b", "c d e f", "g h i j k l"]
    assert value(spark, S.greedy_chunks(F.array().cast("array<string>"), 4)) == []


@pytest.mark.parametrize(
    "name,base,numbers",
    [
        ("bert-base-uncased-eurlex_m2m100_418M_clm_nsp_0.4_clu_0.1_cls_0.5", "bert-base-uncased-eurlex", (0.4, 0.1, 0.5)),
        ("bert-base-uncased-eurlex_m2m100_418M_clm_nsp_0.4_clu_0.1_cls_0.5.pt", "bert-base-uncased-eurlex", (None, None, None)),
        ("nlpaueb_bert-base-uncased-echr", "bert-base-uncased-echr", (None, None, None)),
    ],
)
def test_model_names(spark, name, base, numbers):
    found = value(spark, X.parse_model_config(F.lit(name)))
    assert found["base"] == base and (found["clm"], found["clu"], found["cls"]) == numbers
    assert value(spark, X.checkpoint_config(F.lit("x_m2m100_y_clm_nsp_0.4_clu_0.1_cls_0.5.pt")))["cls"] == 0.5


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, V.norm(a)) == 5 and value(spark, V.cosine(a, b)) == 0 and value(spark, V.cosine(a, a)) == pytest.approx(1)
