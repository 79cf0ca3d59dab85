"""String expressions: cleaning, labels, model names, answers, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import prompts

L = F.lit


def collapse_spaces(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """The words between white space; none for an empty text."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def pair_hash(question: Column, answer: Column) -> Column:
    return F.md5(F.concat(F.lower(F.trim(question)), L("|"), F.lower(F.trim(answer))).cast("binary"))


def normalize_label(c: Column) -> Column:
    """yes or no from the spellings that curation accepts; null for others."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("yes", "y", "true", "1", "correct"), "yes").when(low.isin("no", "n", "false", "0", "incorrect"), "no")


def to_correctness(label: Column) -> Column:
    return F.when(label == "yes", "correct").when(label == "no", "incorrect")


#: Prefixes of organisations in model names, in the order of removal.
ORGANISATIONS = ("nlpaueb_", "google-bert_", "casehold_", "dlicari_", "avichr_")


def normalize_model_name(c: Column) -> Column:
    for prefix in ORGANISATIONS:
        c = F.replace(c, L(prefix), L(""))
    return F.lower(F.replace(c, L("_"), L("-")))


def parse_model_config(name: Column) -> Column:
    """base, clm, clu and cls of a model name: numbers behind `_clm_nsp_` at places 0, 2 and 4; null if one is none."""
    tuned = F.contains(name, L("_clm_nsp_"))
    parts = F.split(F.get(F.split(name, "_clm_nsp_"), L(1)), "_")
    numbers = [F.get(parts, L(i)).try_cast("double") for i in (0, 2, 4)]
    whole = tuned & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    base = normalize_model_name(F.when(tuned, F.split_part(name, L("_m2m100"), L(1))).otherwise(name))
    return F.struct(base.alias("base"), *[F.when(whole, n).alias(k) for n, k in zip(numbers, ("clm", "clu", "cls"))])


def checkpoint_config(name: Column) -> Column:
    """The dialect of saved checkpoints: a trailing `.pt` goes before the numbers are read."""
    return parse_model_config(F.regexp_replace(name, r"\.pt$", ""))


def tagged_config(name: Column) -> Column:
    """The dialect `_mlm_a_…_clu_b_cls_c`, with mlm or clm."""
    number = lambda key: F.regexp_extract(name, rf"_{key}_([0-9.]+)", 1).try_cast("double")
    return F.struct(number("(?:clm|mlm)").alias("clm"), number("clu").alias("clu"), number("cls").alias("cls"))


def sliced_config(name: Column) -> Column:
    """The dialect that cuts a name between its marks: `_clm_nsp_a_clu_b_cls_c`."""
    between = lambda left, right: F.substring_index(F.substring_index(name, left, -1), right, 1).try_cast("double")
    marks = (("clm", "_clm_nsp_", "_clu_"), ("clu", "_clu_", "_cls_"), ("cls", "_cls_", "_"))
    return F.struct(*[F.when(F.contains(name, L(left)), between(left, right)).alias(k) for k, left, right in marks])


#: What a name contains and the group it then belongs to; the first that holds counts.
BASE_GROUPS = (
    ("eurlex", "EURLEX"),
    ("contracts", "CONTRACTS"),
    ("echr", "ECHR"),
    ("custom-legalbert", "CUSTOM-LEGALBERT"),
    ("casehold", "CUSTOM-LEGALBERT"),
    ("italian", "ITALIAN"),
    ("legal-bert-base", "LEGAL-BERT-BASE"),
    ("legal-bert-small", "LEGAL-BERT-SMALL"),
    ("hebert", "LEGAL-HEBERT"),
)


def base_group(name: Column) -> Column:
    low = F.lower(name)
    found = F.when(F.contains(low, L("google-bert")) | F.startswith(low, L("google_bert-")), "GOOGLE-BERT")
    for part, group in BASE_GROUPS:
        found = found.when(F.contains(low, L(part)), group)
    return found.otherwise("OTHER")


def polarity(response: Column) -> Column:
    """yes or no by the first whole word that says so; no if none does."""
    first = F.regexp_extract(F.lower(F.trim(response)), r"\b(yes|correct|true|no|incorrect|wrong|false)\b", 1)
    return F.when(first.isin("yes", "correct", "true"), "yes").otherwise("no")


def numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, L(r"\b\d+(?:\.\d+)?\b"), L(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def same_numbers(reference: Column, generated: Column) -> Column:
    """yes if both texts have the same set of numbers, two empty sets included."""
    return F.when(numbers(reference) == numbers(generated), "yes").otherwise("no")


def qa_text(question: Column, answer: Column, paragraph: Column | None = None) -> Column:
    text = F.concat(L("Question: "), question, L(" [SEP] Answer: "), answer)
    return text if paragraph is None else F.concat(paragraph, L(" "), text)


#: Prompts by version; q, a and d stand for question, answer and the name of the test.
PROMPTS = {
    1: "Given the question: '{q}', determine if the answer '{a}' is correct.Please Respond only with 'yes' if the answer is correct , or 'no' if the answer is not correct; without any additional explanation.",
    2: "Question: '{q}' Is the answer '{a}' correct? Respond with 'yes' or 'no' only.",
    3: "Analyze the following question: '{q}' with the proposed answer '{a}'. Is this answer correct? Please reply with 'yes' or 'no' only.",
    4: "Regarding the question: '{q}', evaluate the correctness of the answer '{a}'. Kindly limit your response to 'yes' for correct answer and 'no' for incorrect answer.",
    5: "Check this statement: '{q}' Answer: '{a}'. Correct? Reply 'yes' or 'no'.",
    6: "Given the question '{q}', can you confirm if the corresponding answer '{a}' is accurate? Please respond simply with 'yes' if it is accurate, or 'no' if it is not.",
    7: "question: '{q}' Is the answer '{a}' true?. Respond only with 'yes' if true or 'no' if false.",
    8: "Question: {q}\n                   Answer: {a}\n                   Is this answer correct? Respond with 'yes' or 'no' only.",
    10: """You are an expert evaluator. Your task is to determine the correctness of a given answer to a question for the {d} driving theory test.
                ---
                Question: "In which instances do you have to approach a pedestrian crossing with particular care?"
                Answer: "If the view of the pedestrian crossing is restricted"
                Response: yes

                Question: "How can you tell while driving that an indicator lamp is not working?"
                Answer: "You cannot detect a defective indicator lamp while driving"
                Response: no

                Question: "When may a tram be overtaken on the left?"
                Answer: "When the rails run too far to the right"
                Response: yes

                Question: "{q}"
                Answer: "{a}"
                Response:""",
}


def prompt(version: Column, question: Column, answer: Column, test: str = "") -> Column:
    """The prompt of a version; unknown versions are version 1."""
    values = {"{q}": question, "{a}": answer, "{d}": L(test)}
    fill = lambda text: F.concat(*[values[p] if p in values else L(p) for p in prompt_parts(text)])
    chosen = F.when(version == 1, fill(PROMPTS[1]))
    for number, text in PROMPTS.items():
        chosen = chosen.when(version == number, fill(text))
    return chosen.otherwise(fill(PROMPTS[1]))


def prompt_parts(text: str) -> list[str]:
    """Literal texts and marks of a template in order."""
    return [p for p in re.split(r"(\{[qad]\})", text) if p]


#: Fixed value: the prompt for questions without options, around the question.
DIRECT = ("For the question: '", "', please provide a numeric answer or a mathematical expression or sign names, as required.")


def direct_prompt(version: Column, question: Column) -> Column:
    """The prompt of version 1; other versions have none."""
    return F.when(version == 1, F.concat(L(DIRECT[0]), question, L(DIRECT[1]))).otherwise("")


def instruction_prompt(sentence: Column, paragraph: Column, pairs: Column, domain: Column, language: Column, templates: dict[tuple[str, str], str] | None = None) -> Column:
    """An instruction from templates by (domain, language): half of the pairs positive, the odd one too.

    Languages other than `de` get the English one, unknown domains and null that of traffic law. A template may hold {sentence}, {paragraph},
    {pairs}, {positive} and {negative}; the published ones are the default.
    """
    templates = prompts.templates() if templates is None else templates
    values = {"{sentence}": sentence, "{paragraph}": paragraph, "{pairs}": pairs, "{positive}": F.ceil(pairs / 2), "{negative}": F.floor(pairs / 2)}
    fill = lambda text: F.concat(*[values[p].cast("string") if p in values else L(p) for p in re.split("(" + "|".join(map(re.escape, values)) + ")", text) if p])
    spoken = F.when(language == "de", "de").otherwise("en")
    known = F.when(domain.isin(*sorted({of for of, _ in templates})), domain).otherwise(prompts.DEFAULT_DOMAIN)
    chosen = F
    for (of, tongue), text in templates.items():
        chosen = chosen.when((known == of) & (spoken == tongue), fill(text))
    return chosen


def title_parts(title: Column) -> Column:
    """The paragraph sign with its number, and the rest that is to be translated."""
    pattern = r"(?s)^(§\s*\d+)\s*(.*)$"
    found = title.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(title, pattern, 1)).alias("marker"), F.when(found, F.regexp_extract(title, pattern, 2)).otherwise(title).alias("rest"))


def protect(c: Column) -> Column:
    """Symbols as marks that survive translation."""
    return F.replace(F.replace(F.replace(c, L("§"), L("__PARAGRAPH_SIGN__")), L("<sign>"), L("⟨SIGN⟩")), L("</sign>"), L("⟨/SIGN⟩"))


def restore(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, L("__PARAGRAPH_SIGN__"), L("§")), L("⟨SIGN⟩"), L("<sign>")), L("⟨/SIGN⟩"), L("</sign>"))


def sentences(c: Column) -> Column:
    """Split behind full stop, exclamation or question mark; the mark stays."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


#: Fixed value: statutory references in decisions.
STATUTE = r"§{1,2}\s?[0-9]+[a-z]*(?:\s*Abs\.\s*\d+)?(?:\s*S\.\s*\d+)?(?:\s*Nr\.\s*\d+)?(?:\s*[a-z])?(?:\s*[A-Z]+)?"


def statutory_references(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, L(STATUTE), L(0)), lambda r: F.trim(r)), lambda r: r != "")


def file_stem(c: Column) -> Column:
    return F.split_part(F.element_at(F.split(c, "/"), -1), L("."), L(1))


def file_extension(c: Column) -> Column:
    return F.regexp_extract(c, r"\.([^./]+)$", 1)


def node_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def dot_quote(c: Column) -> Column:
    return F.concat(L('"'), F.replace(c, L('"'), L('\\"')), L('"'))


def odd_tag_strip(c: Column) -> Column:
    """The pattern as published: its stars make `<` and `/` optional, so real tags stay."""
    return F.regexp_replace(c, r"<*>.*</*>", "")


def fixed_width(c: Column, width: int) -> Column:
    return F.rpad(F.coalesce(c.cast("string"), L("")), width, " ")


def checkpoint_name(base: Column, corpus: Column, clm: Column, clu: Column, cls: Column) -> Column:
    return F.concat(base, L("_"), corpus, L("_clm_nsp_"), clm.cast("string"), L("_clu_"), clu.cast("string"), L("_cls_"), cls.cast("string"))


def first_mark(c: Column, pattern: str) -> Column:
    """The first match and the text with all matches removed."""
    first = F.regexp_extract(c, pattern, 0)
    return F.struct(F.when(first != "", first).alias("found"), F.trim(F.regexp_replace(c, pattern, "")).alias("rest"))


def overlap_of_source(source: Column, other: Column) -> Column:
    """Share of the source's words that the other text has."""
    return F.size(F.array_intersect(word_set(source), word_set(other))) / F.greatest(F.size(word_set(source)), L(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(word_set(a), word_set(b))) / F.greatest(F.size(F.array_union(word_set(a), word_set(b))), L(1))
