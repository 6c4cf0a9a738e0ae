"""Counts, summaries and reports.

Per-column statistics are computed as one wide aggregate and turned into rows
afterwards, so the data is read once and never multiplied by its column count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.labels import map_values
from netweave.functions.numeric import finite_or_null
from netweave.operators.quantiles import SMALL, quantiles
from netweave.plans.mapping import column
from netweave.session import small_table

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def _stack(row: DataFrame, keys: Sequence[str], names: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Unpivot the wide aggregate ``<field><i>`` into one row per name."""
    items = F.array(*[
        F.struct(F.lit(n).alias("feature"), *[F.col(f"{prefix}{i}").alias(f) for f, prefix in fields.items()])
        for i, n in enumerate(names)
    ])
    return row.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, most frequent first."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Class counts with their percentage of all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # The window runs over one row per class.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", (F.lit(100.0) * F.col("n") / total).alias("percent")).orderBy(F.desc("n"), label)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null (or NaN) count per column."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    missing = [
        F.count_if(column(c).isNull() | (F.isnan(column(c)) if types[c] in ("float", "double") else F.lit(False)))
        for c in cols
    ]
    row = df.agg(*[m.alias(f"n{i}") for i, m in enumerate(missing)])
    return _stack(row, [], cols, {"nulls": "n"})


def describe(df: DataFrame, cols: Sequence[str] | None = None, small: int = SMALL) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    cols = list(cols or numeric_columns(df))
    quart = quantiles(df, cols, [0.25, 0.5, 0.75], small=small)
    aggs = []
    for i, c in enumerate(cols):
        v = column(c).cast("double")
        aggs += [F.count(v).alias(f"count{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                 F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        aggs += [F.lit(q).cast("double").alias(f"{name}{i}") for name, q in zip(("lower", "median", "upper"), quart[c])]
    # Literals next to aggregates are constants of the single result row.
    fields = ("count", "mean", "std", "min", "lower", "median", "upper", "max")
    return _stack(df.agg(*aggs), [], cols, {f: f for f in fields})


def distinct_counts(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct non-null values per column."""
    count = F.count_distinct if exact else F.approx_count_distinct
    row = df.agg(*[count(column(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    return _stack(row, [], list(cols), {"distinct": "n"})


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max], empty ones too: count and density; the last bin is closed.

    With ``by`` every group gets all bins of the common range, and its own densities add up to
    one over it.  Nulls and undefined values are left out, and so are infinite ones.
    """
    v = finite_or_null(column(col).cast("double"))
    v = F.when(F.abs(v) < F.lit(float("inf")), v)
    row = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n")).first()
    by = list(by)
    if not row["n"]:
        kinds = dict(df.dtypes)
        head = "".join(f"`{c}` {kinds[c]}, " for c in by)
        return small_table(df.sparkSession, [], head + "bin int, low double, high double, n bigint, density double")
    low = row["low"]
    width = (row["high"] - low) / bins or 1.0
    bin_ = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    # One row per group: its counts as a map, opened again into all bins.
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_held"),
                                   F.sum("n").alias("_total"))
    every = held.select(*by, "_held", "_total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.try_element_at("_held", F.col("bin")), F.lit(0).cast("long"))
    return every.select(
        *by, "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        n.alias("n"), (n / F.col("_total") / F.lit(width)).alias("density"),
    )


def class_summary(df: DataFrame, label: str, source: str, families: Mapping[str, str], other: str = "other",
                  test: str = "test") -> DataFrame:
    """Test, train and total rows per class with share and family."""
    counts = df.groupBy(label).agg(
        F.count_if(F.col(source) == test).alias("test_rows"),
        F.count_if(F.col(source) != test).alias("train_rows"),
        F.count("*").alias("rows"),
    )
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    percent = F.lit(100.0) * F.col("rows") / total
    return counts.select(
        label, "test_rows", "train_rows", "rows", percent.alias("percent"),
        F.format_string("%.2f%%", percent).alias("percent_text"),
        map_values(F.col(label), families, other).alias("family"),
    )


def attack_family(df: DataFrame, label: str, families: Mapping[str, str], other: str = "other",
                  name: str = "family") -> DataFrame:
    """Add the attack family of each row."""
    return df.withColumn(name, map_values(F.col(label), families, other))


def label_lookup(df: DataFrame, label: str, mapping: Mapping[str, str], default: str, name: str) -> DataFrame:
    """The same lookup as a join to the mapping table, whose size is the mapping's."""
    table = small_table(df.sparkSession, list(mapping.items()), f"_key string, {name} string")
    joined = df.join(F.broadcast(table), df[label] == table["_key"], "left").drop("_key")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def fallback_rows(df: DataFrame, label: str, source: str, first: str = "test") -> DataFrame:
    """Rows of the first source, and of the others only for classes it lacks."""
    present = df.where(F.col(source) == first).select(label).distinct()
    others = df.where(F.col(source) != first).join(present, label, "left_anti")
    return df.where(F.col(source) == first).unionByName(others)


def profile_by_class(df: DataFrame, label: str, groups: Mapping[str, Sequence[str]], text_as: str = "values",
                     text: Sequence[str] = (), source: str | None = None, fallback: str | None = None,
                     max_chars: int | None = None) -> DataFrame:
    """One row per (class, feature): share of non-zero rows, min, max and mean.

    Text features, and numeric ones named in ``text``, report their distinct values
    instead: the sorted list (``text_as="values"``), cut to ``max_chars`` characters if
    given, or how many there are (``"count"``).
    """
    if fallback is not None:
        df = fallback_rows(df, label, source, fallback)
    have = set(df.columns)
    group_of = {f: g for g, fs in groups.items() for f in fs if f in have}
    types = dict(df.dtypes)
    numeric = [f for f in group_of if (types[f] in NUMERIC_TYPES) and f not in text]
    words = [f for f in group_of if f not in numeric]
    parts = []
    if numeric:
        aggs = [F.count("*").alias("rows")]
        for i, f in enumerate(numeric):
            v = column(f).cast("double")
            # A missing value differs from zero, so it counts as used.
            aggs += [F.count_if(v.isNull() | (v != 0)).alias(f"used{i}"), F.min(v).alias(f"min{i}"),
                     F.max(v).alias(f"max{i}"), F.avg(v).alias(f"mean{i}")]
        wide = df.groupBy(label).agg(*aggs)
        rows = _stack(wide, [label, "rows"], numeric, {"used": "used", "min": "min", "max": "max", "mean": "mean"})
        usage = F.lit(100.0) * F.col("used") / F.col("rows")
        blank = F.col("used") == 0

        def shown(name):
            return F.when(blank, F.lit(0.0)).otherwise(F.col(name)).alias(name)

        parts.append(rows.select(
            label, "rows", "feature", usage.alias("usage"), shown("min"), shown("max"), shown("mean"),
            F.when(blank, F.lit("unused")).otherwise(F.lit("used")).alias("note"),
        ))
    if words:
        parts.append(_text_profile(df, label, words, text_as, max_chars))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("category", map_values(F.col("feature"), group_of))


def _text_profile(df: DataFrame, label: str, words: Sequence[str], text_as: str,
                  max_chars: int | None = None) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), column(f).cast("string").alias("value")) for f in words
    ])
    values = (
        df.select(label, F.explode(pairs).alias("x")).select(label, "x.*")
        .groupBy(label, "feature", "value").agg(F.count("*").alias("n"))
    )
    size = values.groupBy(label, "feature").agg(F.sum("n").alias("rows"), F.count("value").alias("distinct"))
    if text_as == "count":
        note = F.concat(F.lit("distinct: "), F.col("distinct").cast("string"))
        noted = size.withColumn("note", note)
    else:
        listed = values.where(F.col("value").isNotNull())
        if max_chars is not None:
            # So many characters cannot show more than as many values.
            w = Window.partitionBy(label, "feature").orderBy("value")
            listed = listed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_chars + 1)
        first = listed.groupBy(label, "feature").agg(
            F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("text"))
        shown = F.col("text")
        if max_chars is not None:
            shown = F.when(F.length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("..."))).otherwise(shown)
        noted = size.join(first, [label, "feature"], "left").withColumn(
            "note", F.concat(F.lit("values: "), F.coalesce(shown, F.lit(""))))
    none = F.lit(None).cast("double")
    return noted.select(label, "rows", "feature", F.lit(100.0).alias("usage"), none.alias("min"),
                        none.alias("max"), none.alias("mean"), "note")


def label_consistency(df: DataFrame, label: str, category: str, normal: str = "Normal") -> DataFrame:
    """Agreement of a 0/1 label with its category, in one row."""
    is_normal = F.col(category) == normal
    return df.agg(
        F.count_if(is_normal & (F.col(label) == 0)).alias("normal_as_0"),
        F.count_if(~is_normal & (F.col(label) == 1)).alias("attack_as_1"),
        F.count("*").alias("rows"),
    ).withColumn(
        "accuracy", F.try_divide((F.col("normal_as_0") + F.col("attack_as_1")).cast("double"), F.col("rows"))
    )


def verify(df: DataFrame, label: str, category: str, normal: str = "Normal") -> DataFrame:
    """Conversion report as (section, item, value, percent) rows."""
    types = [t for _, t in df.dtypes]
    frame = small_table(
        df.sparkSession,
        [("shape", "columns", float(len(types))),
         ("types", "numeric", float(len(numeric_columns(df)))),
         ("types", "text", float(len(text_columns(df))))],
        "section string, item string, value double",
    ).withColumn("percent", F.lit(None).cast("double"))
    check = label_consistency(df, label, category, normal)
    n = F.col("rows").cast("double")
    items = F.array(
        _item("shape", "rows", n, None),
        _item("labels", "normal as 0", F.col("normal_as_0"), None),
        _item("labels", "attack as 1", F.col("attack_as_1"), None),
        _item("labels", "consistent", F.col("normal_as_0") + F.col("attack_as_1"), F.col("accuracy") * 100),
    )
    totals = check.select(F.explode(items).alias("x")).select("x.*")
    out = frame.unionByName(totals)
    for section, c in (("label", label), ("category", category)):
        share = class_share(df, c)
        out = out.unionByName(share.select(
            F.lit(section).alias("section"), F.col(c).cast("string").alias("item"),
            F.col("n").cast("double").alias("value"), "percent"))
    nulls = null_counts(df).where(F.col("nulls") > 0)
    return out.unionByName(nulls.select(
        F.lit("nulls").alias("section"), F.col("feature").alias("item"),
        F.col("nulls").cast("double").alias("value"), F.lit(None).cast("double").alias("percent")))


def _item(section: str, name: str, value: Column, percent: Column | None) -> Column:
    percent = F.lit(None) if percent is None else percent
    return F.struct(F.lit(section).alias("section"), F.lit(name).alias("item"),
                    value.cast("double").alias("value"), percent.cast("double").alias("percent"))


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts around a resampling step."""
    def stage(df, name):
        return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))

    return stage(before, "before").unionByName(stage(after, "after"))


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order_by).limit(n)
