"""Citation tagging and tag reading. Replacement by a function of the match is made of split, extract and interleave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.binding import let

L = F.lit
#: Word characters, umlauts included.
W = "[0-9A-Za-zÄÖÜäöüß_]"


def replace_matches(text: Column, pattern: str, render: Callable[[Column, Column], Column]) -> Column:
    """text with every match replaced by render(match, the literal text before it)."""

    def interleaved(bound: Column) -> Column:
        literals = F.split(bound, pattern)
        matches = F.regexp_extract_all(bound, L(pattern), L(0))
        rendered = F.zip_with(literals, matches, lambda before, m: F.concat(before, F.when(m.isNull(), "").otherwise(render(m, before))))
        return F.array_join(rendered, "")

    return let(text, interleaved)


def _each(start: Column, end: Column, before: str, after: str) -> Column:
    """before + i + after for all i from start to end, none if the range is empty."""

    def listed(ends: Column) -> Column:
        values = F.when(ends["a"] <= ends["b"], F.sequence(ends["a"], ends["b"])).otherwise(F.array().cast("array<bigint>"))
        return F.array_join(F.transform(values, lambda i: F.concat(L(before), i.cast("string"), L(after))), ", ")

    return let(F.struct(start.alias("a"), end.alias("b")), listed)


# The published patterns of citations; only that a sign's number ends at six digits there, which would tear longer ones in two.
SIGN_NUMBER = r"\d+(?:\.\d)?"
SIGNS = rf"(?i)\bZeichen\s+{SIGN_NUMBER}(?:\s*(?:bis|und|oder|,)\s*{SIGN_NUMBER})*"
PARAGRAPH_RANGE = r"§§\s*\d+\s*bis\s*\d+"
PARAGRAPH = rf"§\s*(\d+{W}*)"
PARAGRAPH_PAIR = r"§§\s*(\d+)\s*und\s*(\d+)"
ABSATZ = rf"\bAbsatz\s*\d+{W}*(?:\s*bis\s*\d+{W}*)?"
ANNEX = r"\bAnlagen?\s+\d+(?:\s*bis\s*\d+)?"
SECTION = r"\bAbschnitt\s+(\d+)"
#: What stands between the items of a list of signs; between the ends of a range.
SIGN_BREAK, SIGN_RANGE = " und | oder |,", " bis "


def tag_signs(text: Column) -> Column:
    """A list of signs behind `Zeichen`: each item a number or a range, every number of it in a sign tag. A range over decimals is an error."""

    def item(ends: Column) -> Column:
        ranged = _each(F.get(ends, L(0)).cast("bigint"), F.get(ends, L(1)).cast("bigint"), "<sign>", "</sign>")
        return F.when(F.size(ends) == 2, ranged).otherwise(F.concat(L("<sign>"), ends[0], L("</sign>")))

    def render(match: Column, _: Column) -> Column:
        items = F.split(F.regexp_replace(match, r"(?i)^Zeichen\s+", ""), SIGN_BREAK)
        numbers = F.transform(items, lambda i: F.transform(F.split(i, SIGN_RANGE), lambda n: F.trim(n)))
        return F.concat(L("Zeichen "), F.array_join(F.transform(numbers, item), ", "))

    return replace_matches(text, SIGNS, render)


def tag_paragraphs(text: Column, current: Column | None = None) -> Column:
    """Paragraphs and sentences: ranges of §§, single §, Absatz with its paragraph, and the rule for `§§ a und b`, in this order."""
    number = lambda m, k: F.regexp_extract_all(m, L(r"\d+"), L(0))[k].cast("bigint")
    text = replace_matches(text, PARAGRAPH_RANGE, lambda m, _: F.concat(L("<par>"), _each(number(m, 0), number(m, 1), "§ ", ""), L("</par>")))
    text = F.regexp_replace(text, PARAGRAPH, "<par>§ $1</par>")
    current = L(None).cast("string") if current is None else current

    def absatz(match: Column, before: Column) -> Column:
        listed = F.regexp_replace(match, r"^Absatz\s*", "")
        tagged = F.concat(L(" Absatz <sen>"), listed, L("</sen>"))
        return (
            F.when(F.contains(listed, L("bis")), F.concat(L("Absatz "), _each(number(listed, 0), number(listed, 1), "<sen>", "</sen>")))
            .when(before.rlike(r"<par>[^<]+</par>\s*$") | current.isNull() | (current == ""), tagged)
            .otherwise(F.concat(L("<par>"), current, L("</par>"), tagged))
        )

    text = replace_matches(text, ABSATZ, absatz)
    return F.regexp_replace(text, PARAGRAPH_PAIR, "<par>§ $1</par> und <par>§ $2</par>")


def tag_tables(text: Column) -> Column:
    """Anlage a [bis b] and Abschnitt n."""
    number = lambda m, k: F.get(F.regexp_extract_all(m, L(r"\d+"), L(0)), L(k)).cast("bigint")
    text = replace_matches(text, ANNEX, lambda m, _: _each(number(m, 0), F.coalesce(number(m, 1), number(m, 0)), "Anlage <tab>", "</tab>"))
    return F.regexp_replace(text, SECTION, "Abschnitt <sec>$1</sec>")


def tag_all(text: Column, current: Column | None = None) -> Column:
    return tag_tables(tag_paragraphs(tag_signs(text), current))


def tag_values(text: Column, kind: str) -> Column:
    pattern = r"<par>(§\s*\d+)</par>" if kind == "par" else rf"<{kind}>(.*?)</{kind}>"
    return F.regexp_extract_all(text, L(pattern), L(1))


def image_names(text: Column) -> Column:
    return F.regexp_extract_all(text, L(r"<img>(.*?)</img>"), L(1))


def strip_images(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<img>.*?</img>", ""))


def tag_tokens(text: Column) -> Column:
    """Tags in order as structs of kind and value; paragraphs whose number has a letter are no tokens."""
    raw = F.regexp_extract_all(text, L(r"<par>§\s*\d+</par>|<sen>.*?</sen>|<tab>.*?</tab>|<sec>.*?</sec>"), L(0))
    return F.transform(raw, lambda x: F.struct(F.substring(x, 2, 3).alias("kind"), F.regexp_extract(x, r"^<...>(.*)</...>$", 1).alias("value")))


def reset_pairs(text: Column, parent: str, child: str) -> Column:
    """(parent, child) pairs of the forward scan: naming a parent again drops the children it had, so those after its last naming stay."""
    tokens = F.filter(tag_tokens(text), lambda t: t["kind"].isin(parent, child))
    start = F.struct(L(None).cast("string").alias("current"), F.array().cast("array<struct<parent:string,child:string>>").alias("pairs"))

    def step(acc: Column, token: Column) -> Column:
        value = token["value"]
        dropped = F.filter(acc["pairs"], lambda p: p["parent"] != value)
        added = F.concat(acc["pairs"], F.array(F.struct(acc["current"].alias("parent"), value.alias("child"))))
        as_parent = F.struct(value.alias("current"), dropped.alias("pairs"))
        as_child = F.struct(acc["current"].alias("current"), F.when(acc["current"].isNull(), acc["pairs"]).otherwise(added).alias("pairs"))
        return F.when(token["kind"] == parent, as_parent).otherwise(as_child)

    return F.aggregate(tokens, start, step)["pairs"]


def standalone(text: Column, parent: str, child: str) -> Column:
    """Parents without surviving children, in order, repeats included."""
    return let(text, lambda x: without_children(tag_values(x, parent), reset_pairs(x, parent, child)))


def without_children(parents: Column, pairs: Column) -> Column:
    linked = F.transform(pairs, lambda p: p["parent"])
    return let(linked, lambda known: F.filter(parents, lambda p: ~F.array_contains(known, p)))


def tag_report(text: Column) -> Column:
    """All that a tagged text names: signs, (paragraph, sentence) and (table, section) pairs, and those that stand alone."""

    def of(x: Column) -> Column:
        def with_pairs(found: Column) -> Column:
            return F.struct(
                tag_values(x, "sign").alias("signs"), found["sentences"].alias("sentence_pairs"), found["sections"].alias("section_pairs"),
                without_children(tag_values(x, "par"), found["sentences"]).alias("paragraphs"), without_children(tag_values(x, "tab"), found["sections"]).alias("tables"),
            )

        return let(F.struct(reset_pairs(x, "par", "sen").alias("sentences"), reset_pairs(x, "tab", "sec").alias("sections")), with_pairs)

    return let(text, of)


def substitute(text: Column, kind: str, labels: Column, bare: bool = False) -> Column:
    """Each <kind>id</kind> whose id the map has gets the label in place of the id; bare drops the tags."""
    return F.aggregate(
        F.map_entries(labels),
        text,
        lambda t, e: F.replace(t, F.concat(L(f"<{kind}>"), e["key"], L(f"</{kind}>")), e["value"] if bare else F.concat(L(f"<{kind}>"), e["value"], L(f"</{kind}>"))),
    )
