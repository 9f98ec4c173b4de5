"""Texts for people and masked records, as column expressions (RM-8 to RM-10, RM-21, RM-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from vigilspark.functions import fixed as X
from vigilspark.functions.text import mask_pii

BULLET = "  • "


def _texts(values: list) -> Column:
    return F.array_compact(F.array(*values)) if values else F.array().cast("array<string>")


def keyword_indicators(text: Column, category: Column) -> Column:
    """What in a text speaks for its category, at most ten sentences: the first five English keywords of the category,
    Hindi ones up to eight in all, then contacts, handles and amounts.  Null texts and unknown categories have none."""
    low = F.lower(text)
    by_category = []
    for cid, *_, english, hindi in X.CATEGORIES:
        in_english = _texts([F.when(low.contains(w.lower()), F.lit(f"Contains '{w}' (English keyword match)")) for w in english])
        in_hindi = _texts([F.when(text.contains(w), F.lit(f"Contains '{w}' (Hindi keyword match)")) for w in hindi])
        by_category.append((cid, F.slice(F.concat(F.slice(in_english, 1, 5), in_hindi), 1, 8)))
    found = None
    for cid, words in by_category:
        found = F.when(category == cid, words) if found is None else found.when(category == cid, words)
    general = _texts([F.when(text.rlike(pattern), F.lit(sentence)) for pattern, sentence in X.GENERAL_INDICATORS])
    return F.coalesce(F.slice(F.concat(found, general), 1, 10), F.array().cast("array<string>"))


def explanation(category: Column, indicators: Column, secondary: Column, n_phones: Column, n_upis: Column) -> Column:
    """Explanation of a classified text for an officer (RM-9); ``secondary`` is the label of a second category or empty."""
    of = {c[0]: c for c in X.CATEGORIES}

    def table(pick) -> Column:
        return F.create_map(*[F.lit(x) for cid, c in of.items() for x in (cid, str(pick(c)))])[category]

    listed = F.concat(F.lit("\n\nKey indicators found ("), F.size(indicators).cast("string"), F.lit("):\n"), F.array_join(F.transform(F.slice(indicators, 1, 5), lambda x: F.concat(F.lit(BULLET), x)), "\n"))
    lines = [
        F.concat(F.lit("This content has been classified as **"), table(lambda c: c[1]), F.lit("** under the "), table(lambda c: c[2].replace("_", " ")), F.lit(" category.")),
        F.when(F.size(indicators) > 0, listed),
        F.when(secondary != "", F.concat(F.lit("\n\nAlso related to: "), secondary)),
        F.concat(F.lit("\n\nApplicable law: "), table(lambda c: c[5])),
        F.concat(F.lit("Severity: "), table(lambda c: c[3])),
        F.concat(F.lit("Blocking priority: "), table(lambda c: c[4]), F.lit("/5")),
        F.when((n_phones > 0) | (n_upis > 0), F.concat(F.lit("\n\nEntities detected: "), n_phones.cast("string"), F.lit(" phone(s), "), n_upis.cast("string"), F.lit(" UPI ID(s)"))),
    ]
    return F.when(category.isin(list(of)), F.concat_ws("\n", *lines)).otherwise("Unable to classify content.")


def category_label(category: Column) -> Column:
    """Label of a category, empty for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for c in X.CATEGORIES for x in (c[0], c[1])])[category], F.lit(""))


def section_strings(primary: Column, additional: Column) -> Column:
    """``act section`` of a primary section and the additional ones (RM-10): structs (act, section); nulls are left out."""
    every = F.concat(F.array(primary), F.coalesce(additional, F.array()))
    return F.transform(F.filter(every, lambda s: s.isNotNull()), lambda s: F.concat_ws(" ", s["act"], s["section"]))


def percent(share: Column) -> Column:
    """A share as whole per cent."""
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def identity_summary(probability: Column, operator: Column, platforms: Column, evidence: Column) -> Column:
    """Summary of an identity cluster (RM-21); an empty or null operator is unknown."""
    return F.concat(
        F.lit("Identity Cluster — "), percent(probability), F.lit(" probability\nOperator: "), F.coalesce(F.when(operator != "", operator), F.lit("Unknown")),
        F.lit("\nPlatforms: "), F.array_join(platforms, ", "), F.lit("\nEvidence:\n"), F.array_join(F.transform(evidence, lambda e: F.concat(F.lit(BULLET), e)), "\n"),
    )


def role_line(user: Column, role: Column, confidence: Column, evidence: Column) -> Column:
    """A person's line of the role summary with their first three pieces of evidence (RM-21)."""
    head = F.concat(F.lit("  @"), user, F.lit(": "), role, F.lit(" (confidence="), percent(confidence), F.lit(")"))
    return F.array_join(F.concat(F.array(head), F.transform(F.slice(evidence, 1, 3), lambda e: F.concat(F.lit("    • "), e))), "\n")


def masked(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records with numbers, addresses and accounts masked in every string, at any depth (RM-28); columns in ``keep`` stay.

    Keys of maps and values that are not strings stay as they are, nulls too.
    """

    def walk(value: Column, kind: K.DataType) -> Column:
        if isinstance(kind, K.StringType):
            return mask_pii(value)
        if isinstance(kind, K.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, K.MapType):
            return F.transform_values(value, lambda _, x: walk(x, kind.valueType))
        if isinstance(kind, K.StructType) and kind.fields:
            return F.when(value.isNotNull(), F.struct(*[walk(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
        return value

    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return df.select(*[quoted(f.name) if f.name in keep else walk(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
