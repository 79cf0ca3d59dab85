"""Scoring, validation and extraction of generated question-answer pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

L = F.lit
MIN_QUESTION, MAX_QUESTION, MIN_ANSWER, MAX_ANSWER, MIN_SCORE = 15, 200, 20, 500, 0.6

# Word lists and patterns of the validator.
LEGAL_TERMS = {
    "de": (
        "regulation", "anforderung", "law", "muss", "soll", "verboten", "erlaubt", "erlaubnis", "lizenz", "einhaltung", "verstoß", "strafe",
        "ausnahme", "bedingung", "vorschrift", "artikel", "abschnitt", "fahrer", "fahrzeug", "straße", "verkehr", "geschwindigkeit", "entfernung",
        "signal", "zeichen", "verkehrssicherheit", "verhalten", "vorsicht", "rücksicht", "fahrbahn", "fußgänger", "radfahrer", "kraftfahrzeug",
        "kraftrad", "lkw", "pkw", "haltlinie", "überholverbot", "rechtsabbiegeverbot", "vorfahrt", "fahrspurwechsel", "parkplatz", "halteverbot",
        "einbahnstraße",
    ),
    "en": (
        "regulation", "requirement", "law", "must", "shall", "prohibited", "allowed", "permission", "license", "comply", "violation", "penalty",
        "exception", "condition", "provision", "article", "section", "driver", "vehicle", "road", "traffic", "speed", "distance", "signal", "sign",
        "traffic safety", "behavior", "caution", "consideration", "roadway", "pedestrian", "cyclist", "motor vehicle", "motorcycle", "truck", "car",
        "stop line", "no overtaking", "no right turn", "right of way", "lane change", "parking lot", "no parking", "one-way street",
    ),
}
YES_NO = {
    "de": r"^(ist|sind|war|waren|darf|dürfen|durfte|kann|könnte|wird|würde|soll|sollte|muss|musste|hat|haben|hatte|hatten)\s",
    "en": r"^(is|are|was|were|do|does|did|can|could|will|would|should|has|have|had|must|may)\s",
}
GENERIC = {
    "de": r"^\s*was\s+ist\s+|^\s*wie\s+kann\s+ich\s+|^\s*warum\s+ist\s+",
    "en": r"^\s*what\s+is\s+|^\s*how\s+do\s+i\s+|^\s*why\s+is\s+",
}
ENGLISH = ("the", "is", "and", "of", "to", "a", "in", "that", "it", "on")
PLACEHOLDERS = ("xxx", "example", "placeholder", "[...]", "...", "beispiel", "platzhalter")
BARE_ANSWERS = ("yes", "no", "true", "false", "ja", "nein", "wahr", "falsch")


def matches_by_language(c: Column, patterns: dict[str, str], language: Column) -> Column:
    return F.when(language == "de", c.rlike(patterns["de"])).otherwise(c.rlike(patterns["en"]))


def contains_any(c: Column, parts: list[str] | tuple[str, ...]) -> Column:
    return F.exists(F.array(*[L(p) for p in parts]), lambda p: F.contains(c, p))


def quality_score(question: Column, answer: Column, sentence: Column, label: Column, language: Column) -> Column:
    """1 less penalties, within 0 and 1; an answer of over five words always loses 0.2 for repetition, as a ratio of at least 1 is over 0.4."""
    q, a = F.lower(question), F.lower(answer)
    overlap = X.overlap_of_source(sentence, answer)
    lose = lambda condition, points: F.when(condition, L(points)).otherwise(L(0.0))
    score = (
        L(1.0)
        - F.when(F.length(question) < MIN_QUESTION, 0.3).when(F.length(question) > MAX_QUESTION, 0.2).otherwise(0.0)
        - lose(matches_by_language(q, GENERIC, language), 0.1)
        - F.when(F.length(answer) < MIN_ANSWER, 0.4).when(F.length(answer) > MAX_ANSWER, 0.2).otherwise(0.0)
        - lose((overlap < 0.1) & label.isin("ja", "yes"), 0.3)
        - lose(overlap > 0.8, 0.15)
        - lose(F.endswith(q, L("?")) & a.isin("ja", "nein", "yes", "no", "true", "false"), 0.4)
        - lose(F.startswith(a, L("i don't know")) | F.startswith(a, L("ich weiß nicht")), 0.5)
        - lose(F.size(X.words(a)) > 5, 0.2)
    )
    return F.least(L(1.0), F.greatest(L(0.0), score))


def generated_label(label: Column, language: Column) -> Column:
    """The label in its language's words; null if it is none."""
    low = F.lower(F.trim(label))
    return (
        F.when((language == "de") & low.isin("yes", "ja"), "ja")
        .when((language == "de") & low.isin("no", "nein"), "nein")
        .when((language == "en") & low.isin("yes", "ja"), "yes")
        .when((language == "en") & low.isin("no", "nein"), "no")
        .when(~language.isin("de", "en") & low.isin("yes", "no"), low)
    )


def reject_reason(question: Column, answer: Column, label: Column, sentence: Column, language: Column) -> Column:
    """The first stage of the validator that a pair fails; null if it passes."""
    question, answer = F.trim(question), F.trim(answer)
    q, a = F.lower(question), F.lower(answer)
    known = generated_label(label, language)
    both = F.concat(q, L(" "), a)
    clean_q, clean_a = F.regexp_replace(question, r"\s+", " "), F.regexp_replace(answer, r"\s+", " ")
    return (
        F.when(question.isNull() | answer.isNull() | label.isNull(), "missing key")
        .when((language == "de") & (contains_any(q, ENGLISH) | contains_any(a, ENGLISH)), "language")
        .when(F.length(question) < MIN_QUESTION, "question too short")
        .when(F.length(question) > MAX_QUESTION, "question too long")
        .when(F.length(answer) < MIN_ANSWER, "answer too short")
        .when(F.length(answer) > MAX_ANSWER, "answer too long")
        .when(known.isNull(), "label")
        .when(q == a, "identical")
        .when(matches_by_language(q, YES_NO, language) & a.isin(*BARE_ANSWERS), "bare answer")
        .when(contains_any(q, PLACEHOLDERS) | contains_any(a, PLACEHOLDERS), "placeholder")
        .when(X.jaccard(q, a) > 0.7, "repeats question")
        .when(~F.when(language == "de", contains_any(both, LEGAL_TERMS["de"])).otherwise(contains_any(both, LEGAL_TERMS["en"])), "no legal term")
        .when(quality_score(clean_q, clean_a, sentence, known, language) < MIN_SCORE, "score")
    )


def record_reject_reason(record: dict[str, Column], min_score: float = MIN_SCORE, min_length: int = 10) -> Column:
    """The first fault of a curated record: a required field, its type or length, the label, the score."""
    score = record["quality_score"]
    return (
        F.when(record["question"].isNull() | record["answer"].isNull() | record["label"].isNull() | record["paragraph_id"].isNull() | score.isNull(), "missing field")
        .when(F.length(F.trim(record["question"])) < min_length, "question too short")
        .when(F.length(F.trim(record["answer"])) < min_length, "answer too short")
        .when(X.normalize_label(record["label"]).isNull(), "label")
        .when(score < min_score, "score")
    )


PAIRS = "array<struct<question:string,answer:string,label:string>>"
_ALIASES = "array<struct<frage:string,antwort:string,question:string,answer:string,label:string>>"


def _named(parsed: Column) -> Column:
    first = lambda *c: F.coalesce(*[F.nullif(x, L("")) for x in c], L(""))
    named = F.transform(parsed, lambda p: F.struct(first(p["frage"], p["question"]).alias("question"), first(p["antwort"], p["answer"]).alias("answer"), F.coalesce(p["label"], L("")).alias("label")))
    return F.filter(named, lambda p: (p["question"] != "") & (p["answer"] != ""))


def extract_pairs(response: Column, k: int, language: Column) -> Column:
    """Pairs from a model's answer: a JSON array, else k single objects, else fields one by one; empty if none works.

    As published, a missing or invalid label is `ja` in German; in English it is yes for the first pair and no for others.
    """
    none = F.array().cast(PAIRS)
    filled = lambda c: F.when(F.size(F.coalesce(c, none)) > 0, c)
    array = F.regexp_extract(response, r"(?is)\[\s*\{.*?\}\s*\]", 0)
    one = filled(_named(F.slice(F.from_json(array, _ALIASES), 1, k)))
    objects = F.regexp_extract_all(response, L(r'(?is)\{[^{}]*?"(?:frage|question)"[^{}]*?"(?:antwort|answer)"[^{}]*?"label"[^{}]*?\}'), L(0))
    joined = F.concat(L("["), F.array_join(F.slice(objects, 1, k), ","), L("]"))
    two = F.when(F.size(objects) >= k, filled(_named(F.from_json(joined, _ALIASES))))
    fields = lambda names: F.regexp_extract_all(response, L(rf'(?i)"(?:{names})"\s*:\s*"([^"]*)"'), L(1))
    questions, answers = fields("frage|question"), fields("antwort|answer")
    labels = F.transform(F.regexp_extract_all(response, L(r'(?i)"label"\s*:\s*(?:"[^"]*"|[a-z]+)'), L(0)), lambda x: F.lower(F.trim(F.regexp_extract(x, r'(?i):\s*"?([^"]*)"?$', 1))))

    def pair(i: Column) -> Column:
        said = F.get(labels, i)
        default = F.when((language == "de") | (i == 0), F.when(language == "de", "ja").otherwise("yes")).otherwise("no")
        valid = F.when(language == "de", said.isin("ja", "nein")).otherwise(said.isin("yes", "no"))
        return F.struct(F.get(questions, i).alias("question"), F.get(answers, i).alias("answer"), F.when(F.coalesce(valid, L(False)), said).otherwise(default).alias("label"))

    three = F.when((F.size(questions) >= k) & (F.size(answers) >= k), F.transform(F.sequence(L(0), L(k - 1)), pair))
    return F.coalesce(one, two, three, none)
