"""Readable explanations of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import place_text
from vellum.operators.score import ERA, YEAR

NONE = "array<string>"
#: What the explanations call the knowledge graph.
GRAPH = "KG"


def sentence(parts: Column) -> Column:
    """Clauses as one sentence: `a.`, `a as b.`, `a as b, c, and z.`"""
    n = F.size(parts)
    head, tail = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    middle = F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.concat(head, F.lit("."))).when(
        n == 2, F.concat(head, F.lit(" as "), tail, F.lit("."))
    ).otherwise(
        F.concat(head, F.lit(" as "), middle, F.lit(", and "), tail, F.lit("."))
    )


def opening(name: Column, score: Column) -> Column:
    return F.format_string("%s scores %.3f", name, score)


def _all(*clauses: Column) -> Column:
    return sentence(F.array_compact(F.array(*clauses)))


def _text(*parts) -> Column:
    """Parts joined; a missing one reads as nothing."""
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _neural(score: Column, strong: str, moderate: str, weak: str) -> Column:
    return F.when(score >= 0.75, strong).when(score >= 0.6, moderate).when(score.isNotNull(), weak)


def explain_person(
    name: Column, score: Column, f: dict[str, Column], c: dict[str, Column], locations: Column, era: str = ERA, year: int = YEAR,
    graph: str = GRAPH
) -> Column:
    """f: name, era, residence, floruit, neural; c: eras, residencesLabels, ancestorLabels, floruitEarliest, floruitLatest."""
    here = F.transform(F.coalesce(locations, F.array().cast(NONE)), place_text)
    among = lambda xs: F.try_element_at(F.filter(F.coalesce(xs, F.array().cast(NONE)), lambda x: F.array_contains(here, place_text(x))), F.lit(1))
    home, above = among(c["residencesLabels"]), among(c["ancestorLabels"])
    period = _text("their floruit period (", c["floruitEarliest"], " to ", c["floruitLatest"], ") ")
    lacks = lambda x: F.coalesce(x, F.lit("")) == ""
    return _all(
        opening(name, score),
        F.when(f["name"] >= 0.85, "their name closely matches the mention").when(
            f["name"] >= 0.6, "their name partially matches the mention"
        ).when(
            f["name"].isNotNull(), "their name has a weak match to the mention"
        ),
        F.when(f["era"] == 1, _text(f"their {graph} era (", c["eras"], f") aligns with the document era ({era})")).when(
            f["era"] == 0, _text(f"their {graph} era (", c["eras"], f") does not match the document era ({era})")
        ).otherwise("their era information is incomplete"),
        F.when(f["residence"] == 1, F.when(home.isNotNull(), _text("they reside in ", home, ", which is mentioned in the document")))
        .when(
            f["residence"] == 0.75,
            F.when(
                above.isNotNull(),
                _text(
                    "they reside in ", F.coalesce(F.try_element_at(c["residencesLabels"], F.lit(1)), F.lit("a recorded residence")),
                    ", whose parent geography includes ", above, ", which is mentioned in the document"
                )
            )
        )
        .when(f["residence"] == 0.3, "no residence information is available").when(
            f["residence"] == 0, "their known residences are not mentioned in the document"
        ),
        F.when(f["floruit"] == 1, _text(period, f"encompasses the document year ({year})")).when(
            f["floruit"] == 0.8, _text(period, f"is very close to the document year ({year})")
        )
        .when(
            f["floruit"] == 0.6, _text(period, f"is within 20 years of the document year ({year})")
        ).when(f["floruit"] == 0.1, _text(period, f"is distant from the document year ({year})"))
        .when(lacks(c["floruitEarliest"]) | lacks(c["floruitLatest"]), "their floruit dates are incomplete"),
        _neural(
            f["neural"], "the semantic context strongly matches this candidate profile",
            "the semantic context moderately matches this candidate profile",
            "the semantic context provides limited support for this candidate"
        ),
    )


def explain_place(
    name: Column, score: Column, f: dict[str, Column], c: dict[str, Column], locations: Column, near: Column, graph: str = GRAPH
) -> Column:
    """f: name, hierarchy, type_match, historical, neural; c: types, parentLabels, childLabels; near: text around the place's label."""
    types, none = F.coalesce(c["types"], F.array().cast(NONE)), F.array().cast(NONE)
    found = F.try_element_at(F.filter(F.array(*[F.lit(k) for k in L.TYPE_KEYWORDS]), lambda k: F.contains(near, k)), F.lit(1))
    plain = F.when(found == "citty", "city").when(found == "towne", "town").when(found == "prouince", "province").otherwise(found)
    kinds = F.when(F.size(types) > 0, F.array_join(types, ", "))
    named = F.coalesce(locations, none)
    said = lambda xs: F.filter(F.coalesce(xs, none), lambda x: F.array_contains(named, F.lower(x)))
    parent, children = F.try_element_at(said(c["parentLabels"]), F.lit(1)), said(c["childLabels"])
    high = (f["hierarchy"] >= 0.75) & (f["hierarchy"] < 1)
    return _all(
        opening(name, score),
        F.when(
            f["name"] >= 0.95, "its name is an exact match to the mention"
        ).when(
            f["name"] >= 0.75, "its name is a close match to the mention"
        ).when(f["name"] >= 0.5, "its name partially matches the mention").when(
            f["name"].isNotNull(), "its name is a weak match to the mention"
        ),
        F.when(
            f["type_match"] == 1,
            F.when(
                found.isNotNull() & kinds.isNotNull(),
                _text("its type (", kinds, ") aligns with the document context mentioning '", plain, "'")
            )
        )
        .when(
            f["type_match"] < 0.5, _text("its type (", F.coalesce(kinds, F.lit("unknown")), ") does not match the document context")
        ).when(f["type_match"] == 0.5, "no specific location type is mentioned in the nearby context"),
        F.when(f["hierarchy"] == 1, "it is directly mentioned elsewhere in the document").when(
            high & parent.isNotNull(), _text("its parent place (", parent, ") is mentioned in the document")
        ).when(
            f["hierarchy"] == 0, "it has no geographic overlap with other locations mentioned in the document"
        ),
        F.when(
            high & (F.size(children) > 0),
            _text("its child places include ", F.array_join(F.slice(children, 1, 3), ", "), ", which are mentioned in the document")
        ),
        F.when(
            high & parent.isNull() & (F.size(children) == 0), "it has geographic overlap with other locations mentioned in the document"
        ),
        F.when(
            f["historical"] == 1, f"it has an early-modern historical approximation in {graph}"
        ).when(
            f["historical"] >= 0.7, f"it has historical approximation links in {graph}"
        ).when(f["historical"].isNotNull(), "it has no historical approximation link"),
        _neural(
            f["neural"], "its contextual semantic match to the mention is strong",
            "its contextual semantic match to the mention is moderate", "its contextual semantic match to the mention is weak"
        ),
    )
