"""Label and code mapping expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_values(c: Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup as a map literal; keys missing from it give ``default``."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def map_contains(c: Column, ordered: Sequence[tuple[str, str]], exact: tuple[str, str],
                 default: str, trim: bool = True) -> Column:
    """``struct<label: int, category: string>`` from free-text labels.

    The text equal to ``exact[0]`` is class 0; otherwise the first listed key
    that occurs inside the text names the category; otherwise ``default``.
    """
    text = F.coalesce(F.trim(c) if trim else c, F.lit(""))
    chosen = F.when(text == exact[0], F.lit(exact[1]))
    for key, category in ordered:
        if key != exact[0]:
            chosen = chosen.when(text.contains(key), F.lit(category))
    chosen = chosen.otherwise(F.lit(default))
    return F.struct(
        F.when(text == exact[0], F.lit(0)).otherwise(F.lit(1)).alias("label"),
        chosen.alias("category"),
    )


def tcp_flag_state(c: Column) -> Column:
    """Connection state from a TCP flag word written in hexadecimal text."""
    text = F.coalesce(c.cast("string"), F.lit("0"))
    # Flag words and the states they stand for; the first match wins.
    words = (("0x00000010", "SF"), ("0x00000018", "S1"), ("0x00000014", "S2"))
    state = F.when(text == "0", F.lit("SF"))
    for word, name in words:
        state = state.when(text.contains(word), F.lit(name))
    return state.otherwise(F.lit("SF"))


def flag_indicator(c: Column, value: str) -> Column:
    """1 where the column equals ``value``, else 0 (also for null)."""
    return F.coalesce((c == F.lit(value)).cast("int"), F.lit(0))


_RULES = {
    "normal": lambda c: F.lower(F.trim(c)) != "normal",
    "benign": lambda c: F.upper(F.trim(c)) != "BENIGN",
    "attack": lambda c: F.lower(F.trim(c)) == "attack",
    "numeric": lambda c: c.try_cast("double") == 1.0,
}


def binary_label(c: Column, rule: str = "normal") -> Column:
    """0/1 label under a named rule; ``first:<value>`` makes ``value`` the class 0."""
    text = c.cast("string")
    if rule.startswith("first:"):
        test = text != rule[len("first:"):]
    else:
        test = _RULES[rule](text)
    return F.coalesce(test.cast("int"), F.lit(1 if rule in ("normal", "benign") else 0))


def detect_label_rule(df: DataFrame, label: str, key: str | None = None) -> str:
    """Pick the rule for :func:`binary_label` from the label values.

    One aggregate decides, whatever the number of distinct labels.  When nothing
    is recognised, the label of the smallest ``key`` (or the smallest label)
    becomes class 0.
    """
    text = F.col(label).cast("string")
    number = text.try_cast("double")
    first = F.min_by(text, F.col(key)) if key else F.min(text)
    row = df.where(F.col(label).isNotNull()).agg(
        F.coalesce(F.bool_and(F.coalesce(number.isin(0.0, 1.0), F.lit(False))), F.lit(False)).alias("binary"),
        F.coalesce(F.bool_or(F.lower(text) == "normal"), F.lit(False)).alias("normal"),
        F.coalesce(F.bool_or(F.upper(text) == "BENIGN"), F.lit(False)).alias("benign"),
        F.coalesce(F.bool_or(F.lower(text) == "attack"), F.lit(False)).alias("attack"),
        first.alias("first"),
    ).first()
    if row["binary"]:
        return "numeric"
    for rule in ("normal", "benign", "attack"):
        if row[rule]:
            return rule
    return f"first:{row['first']}"
