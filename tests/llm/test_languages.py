"""Every labelled language is learned, however many there are."""

import math
import zlib

import numpy as np

from lexmill.llm import language_id

from .conftest import DOCS


def test_rare_languages_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[k // 26] * 3 + letters[k % 26] * 3 for _ in range(8)), f"l{k:03d}", "s", 1) for i, k in enumerate(k for k in range(230) for _ in range(3 if k < 229 else 1))]
    table = spark.createDataFrame([(i * 7 + 1, *r) for i, *r in rows], DOCS)
    known = {r["lang"] for r in table.filter(~language_id.held_out(table["doc_id"])).collect()}
    model = language_id.fit(table)
    assert len(known) > 200 and set(model.languages) == known


def test_repeated_ids_and_null_texts_lose_no_language(spark):
    """Rows whose ids repeat, and a language most of whose texts are null."""
    learned = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(learned[i % 2], f"der und die das ein {i}", "de", "s", 1) for i in range(5000)]
    rows += [(i, f"the and of to a {i}", "en", "s", 1) for i in range(3000)]
    rows += [(i, None if i % 50 else f"le la les une et {i}", "fr", "s", 1) for i in range(4000)]
    table = spark.createDataFrame(rows, DOCS)
    counts = {r["lang"]: r["count"] for r in language_id._sample(table).groupBy("lang").count().collect()}
    left = {r["lang"]: min(language_id.PER_LANGUAGE, r["count"]) for r in table.filter(~language_id.held_out(table["doc_id"]) & table["text"].isNotNull()).groupBy("lang").count().collect()}
    assert counts == left and set(counts) == {"de", "en", "fr"} and 20 < counts["fr"] < 100
    again = {tuple(r) for r in language_id._sample(table.repartition(7)).collect()}
    assert again == {tuple(r) for r in language_id._sample(table.coalesce(1)).collect()}
    model = language_id.fit(table)
    assert model.predict("die und das der ein")[0] == "de" and model.predict("les une et la le")[0] == "fr"


def slow_predict(model, text):
    """Decoding by its definition, without arrays."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    folded = []
    for b in text.encode():
        c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or not folded or folded[-1] != 32:
            folded.append(c)
    count = [0] * language_id.DIMENSIONS
    for size, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        for k in range(len(folded) - size + 1):
            gram = 0
            for c in folded[k : k + size]:
                gram = gram << 8 | c
            count[((gram + 1) * salt & 0xFFFFFFFF) >> 20] += 1
    norm = math.sqrt(sum(count)) or 1e-6
    margins = [sum(math.sqrt(n) / norm * float(model.weights[d, k]) for d, n in enumerate(count) if n) + float(model.bias[k]) for k in range(len(model.bias))]
    losses = [sum(math.log1p(math.exp(-float(c) * m)) * float(w) for c, m, w in zip(code, margins, model.bit_weight)) for code in model.code]
    best = min(range(len(losses)), key=lambda k: (losses[k], k))
    return model.languages[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_decoding_equals_brute_force(spark, sf_dir, docs, texts):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(table)
    for text in [r["text"] for r in table.limit(40).collect()] + texts:
        lang, score, _ = model.predict(text)
        want, likely = slow_predict(model, text)
        assert lang == want and abs(score - likely) < 1e-3


def test_closest_equals_all_pairs():
    for n in (1, 2, 5, 40):
        code = language_id.codewords(n)
        assert language_id.closest(code) == min((int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)), default=1)
    assert np.array_equal(np.abs(language_id.codewords(7)), np.ones((7, 30)))
