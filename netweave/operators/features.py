"""Feature operators that are fitted once and applied as plain projections.

Fitted parameters are a handful of numbers per column, so an apply turns them
into literals.  Vocabularies can be large; they are tables, and broadcast only
when their counted size is small.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.numeric import clip, coerce_double, log1p_clipped, normal_quantile
from netweave.operators.ordering import with_row_ids
from netweave.operators.quantiles import SMALL, quantiles
from netweave.operators.skew import split_join
from netweave.plans.mapping import column
from netweave.session import materialize, small_table

SMALL_VOCABULARY = 100_000
_WIDE = 100  # products beyond this many are built as one array expression


# --- label encoding ------------------------------------------------------------

@dataclass
class Encoder:
    """Codes of text values: ``vocab(feature, value, code)`` and its size per feature."""

    features: list[str]
    vocab: DataFrame
    sizes: dict[str, int]
    null_token: str = ""

    def _table(self, feature: str) -> DataFrame:
        table = self.vocab.where(F.col("feature") == feature)
        table = table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        return F.broadcast(table) if self.sizes[feature] <= SMALL_VOCABULARY else table

    def _joined(self, df: DataFrame, feature: str) -> DataFrame:
        """``df`` with the ``_code`` of its ``_value``; values that many rows share are split where the table is not sent around."""
        if self.sizes[feature] <= SMALL_VOCABULARY:
            return df.join(self._table(feature), "_value", "left")
        return split_join(df, self._table(feature), ["_value"], "left")

    def _fallback(self) -> dict[str, int]:
        rows = self.vocab.where(F.col("value") == self.null_token).collect()
        return {r["feature"]: r["code"] for r in rows}

    def apply(self, df: DataFrame, suffix: str = "", unseen: str = "fallback") -> DataFrame:
        """Replace each feature by its code (or add ``feature + suffix``).

        Unseen values take the code of the null token; with ``unseen="error"`` they
        raise.  A feature the table lacks becomes 0.
        """
        fallback = self._fallback()
        for f in self.features:
            if f not in df.columns:
                df = df.withColumn(f + suffix, F.lit(0))
                continue
            value = F.coalesce(column(f).cast("string"), F.lit(self.null_token))
            missing = F.lit(fallback[f]) if unseen == "fallback" else F.raise_error(
                F.concat(F.lit(f"{f}: unseen value "), value)).cast("int")
            joined = self._joined(df.withColumn("_value", value), f)
            coded = F.coalesce(F.col("_code"), missing).alias(f + suffix)
            keep = [column(c) for c in df.columns if c != f + suffix]
            df = joined.select(*keep, coded)
        return df

    def unseen_values(self, df: DataFrame) -> DataFrame:
        """Values outside the vocabulary with their row counts."""
        out = None
        for f in self.features:
            value = F.coalesce(column(f).cast("string"), F.lit(self.null_token))
            counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("rows"))
            stray = counts.join(self._table(f), F.col("value") == F.col("_value"), "left_anti")
            stray = stray.select(F.lit(f).alias("feature"), "value", "rows")
            out = stray if out is None else out.unionByName(stray)
        return out


def fit_encoder(df: DataFrame, cols: Sequence[str], null_token: str = "") -> Encoder:
    """Codes are ranks among the sorted distinct values, the null token included."""
    spark = df.sparkSession
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(column(f).cast("string"), F.lit(null_token)).alias("value"))
        for f in cols
    ])
    # Duplicates fall away on the map side, so little of the exploded pairs is shuffled.
    values = df.select(F.explode(pairs).alias("x")).select("x.*").distinct()
    head = values.limit(SMALL_VOCABULARY + 1).collect()
    if len(head) <= SMALL_VOCABULARY:
        # Few enough to hold: later applies then cost no pass over the data.
        rows = []
        for f in cols:
            known = sorted({r["value"] for r in head if r["feature"] == f} | {null_token})
            rows += [(f, v, i) for i, v in enumerate(known)]
        vocab = small_table(spark, rows, "feature string, value string, code int")
        return Encoder(list(cols), vocab, {f: sum(r[0] == f for r in rows) for f in cols}, null_token)
    tokens = small_table(spark, [(f, null_token) for f in cols], "feature string, value string")
    values = values.unionByName(tokens).distinct()
    ranked = with_row_ids(values, ["feature", "value"], name="_rank")
    starts = ranked.groupBy("feature").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    coded = ranked.join(F.broadcast(starts), "feature").select(
        "feature", "value", (F.col("_rank") - F.col("_first")).cast("int").alias("code"))
    sizes = {r["feature"]: r["_n"] for r in starts.collect()}
    return Encoder(list(cols), materialize(coded, "vocabulary"), sizes, null_token)


def encode_text(df: DataFrame, exclude: Sequence[str] = (), null_token: str = "nan") -> tuple[DataFrame, Encoder]:
    """Label encode every text column."""
    cols = [c for c, t in df.dtypes if t == "string" and c not in exclude]
    encoder = fit_encoder(df, cols, null_token)
    return encoder.apply(df), encoder


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, limit: int = 2000) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for every value of the text columns.

    Output columns are plan-time objects, so a column with more than ``limit``
    distinct values is an error rather than a silent cut; :func:`one_hot_cells` takes any.
    """
    text = [c for c, t in df.dtypes if t == "string" and (cols is None or c in cols)]
    out = [column(c) for c in df.columns if c not in text]
    for c in text:
        values = [r[0] for r in df.select(column(c)).distinct().limit(limit + 1).collect() if r[0] is not None]
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} values; encode it instead")
        out += [F.coalesce((column(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in sorted(values)]
    return df.select(*out)


def one_hot_cells(df: DataFrame, encoder: Encoder, key: str) -> DataFrame:
    """The ones of a one-hot matrix as ``(key, feature, code)`` rows, for any number of values.

    ``code`` is the value's place among its feature's sorted values; null and unseen values
    have the encoder's fallback code.
    """
    coded = encoder.apply(df.select(key, *[column(f) for f in encoder.features if f in df.columns]), suffix="_code")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_code").cast("long").alias("code"))
                      for f in encoder.features])
    return coded.select(key, F.explode(cells).alias("x")).select(key, "x.*")


# --- clipping ------------------------------------------------------------------

@dataclass
class Bounds:
    """Clip limits per column."""

    limits: dict[str, tuple[float | None, float | None]]

    def value(self, c: str, v: Column) -> Column:
        low, high = self.limits.get(c, (None, None))
        return v if low is None or high is None else clip(v, low, high)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            self.value(c, column(c)).alias(c) if c in self.limits else column(c) for c in df.columns
        ])


def fit_bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr", small: int = SMALL) -> Bounds:
    """``iqr``: 1.5 interquartile ranges; ``zscore``: three sample deviations; ``percentile``: 1 to 99."""
    cols = list(cols)
    if method == "iqr":
        q = quantiles(df, cols, [0.25, 0.75], small=small)
        return Bounds({c: (None, None) if q[c][0] is None else
                       (q[c][0] - 1.5 * (q[c][1] - q[c][0]), q[c][1] + 1.5 * (q[c][1] - q[c][0])) for c in cols})
    if method == "percentile":
        q = quantiles(df, cols, [0.01, 0.99], small=small)
        return Bounds({c: tuple(q[c]) for c in cols})
    if method == "zscore":
        row = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.avg(column(c)).alias(f"m{i}"), F.stddev_samp(column(c)).alias(f"s{i}"))]).first()
        return Bounds({c: (None, None) if row[f"s{i}"] is None else
                       (row[f"m{i}"] - 3 * row[f"s{i}"], row[f"m{i}"] + 3 * row[f"s{i}"]) for i, c in enumerate(cols)})
    raise ValueError(method)


# --- skew ----------------------------------------------------------------------

def adjusted_skewness(v: Column) -> Column:
    """Bias-adjusted sample skewness; null below three rows or without spread."""
    n = F.count(v).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0)
    return F.when((n > 2) & (F.max(v) > F.min(v)), F.skewness(v) * factor)


@dataclass
class SkewLog:
    """Columns to log-transform and the minimum each one is shifted by."""

    shift: dict[str, float]

    def value(self, c: str, v: Column) -> Column:
        return F.log1p(v - F.lit(self.shift[c]) + F.lit(1e-6)) if c in self.shift else v

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.value(c, column(c)).alias(c) for c in df.columns])


def fit_skew_log(df: DataFrame, cols: Sequence[str], threshold: float = 1.0) -> SkewLog:
    """Columns whose adjusted skewness exceeds the threshold."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        adjusted_skewness(column(c).cast("double")).alias(f"s{i}"), F.min(column(c)).alias(f"m{i}"))]).first()
    return SkewLog({c: float(row[f"m{i}"]) for i, c in enumerate(cols)
                    if row[f"s{i}"] is not None and row[f"s{i}"] > threshold})


# --- scaling -------------------------------------------------------------------

@dataclass
class Scaler:
    """``(x - centre) / width`` per column."""

    kind: str
    centre: dict[str, float]
    width: dict[str, float]

    def value(self, c: str, v: Column) -> Column:
        return (v - F.lit(self.centre[c])) / F.lit(self.width[c]) if c in self.centre else v

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.value(c, column(c)).alias(c) for c in df.columns])


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "robust", small: int = SMALL) -> Scaler:
    """``robust`` (median, interquartile range), ``standard`` (mean, population deviation),
    ``minmax`` per column, or ``global_minmax`` over all columns together.  A zero
    width becomes 1."""
    cols = list(cols)
    if not cols:
        return Scaler(kind, {}, {})
    if kind == "robust":
        q = quantiles(df, cols, [0.25, 0.5, 0.75], small=small)
        centre = {c: q[c][1] for c in cols}
        width = {c: None if q[c][0] is None else q[c][2] - q[c][0] for c in cols}
    elif kind == "standard":
        row = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.avg(column(c)).alias(f"a{i}"), F.stddev_pop(column(c)).alias(f"b{i}"),
            F.min(column(c)).alias(f"c{i}"), F.max(column(c)).alias(f"d{i}"))]).first()
        centre = {c: row[f"a{i}"] for i, c in enumerate(cols)}
        # Rounding can leave a constant column a tiny deviation.
        width = {c: 0.0 if row[f"c{i}"] == row[f"d{i}"] else row[f"b{i}"] for i, c in enumerate(cols)}
    elif kind in ("minmax", "global_minmax"):
        row = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.min(column(c)).alias(f"a{i}"), F.max(column(c)).alias(f"b{i}"))]).first()
        low = {c: row[f"a{i}"] for i, c in enumerate(cols)}
        high = {c: row[f"b{i}"] for i, c in enumerate(cols)}
        if kind == "global_minmax":
            lows = [v for v in low.values() if v is not None]
            highs = [v for v in high.values() if v is not None]
            low = {c: min(lows, default=None) for c in cols}
            high = {c: max(highs, default=None) for c in cols}
        centre = low
        width = {c: None if low[c] is None else high[c] - low[c] for c in cols}
    else:
        raise ValueError(kind)
    return Scaler(
        kind,
        {c: float(v) if v is not None else 0.0 for c, v in centre.items()},
        {c: float(v) if v else 1.0 for c, v in width.items()},
    )


@dataclass
class QuantileScaler:
    """Maps a column to its rank position in [0, 1], optionally on to a normal distribution."""

    knots: dict[str, list[float]]
    normal: bool = True

    def value(self, c: str, v: Column) -> Column:
        """A search over a thousand knots per value; vectorised, since nested array
        functions are interpreted row by row."""
        if c not in self.knots:
            return v
        knots, normal = np.array(self.knots[c]), self.normal

        @F.pandas_udf("double")
        def place(x: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            u = rank_position(x.to_numpy(dtype=float)[known], knots)
            out = np.full(len(x), np.nan)
            # Fixed value: positions are kept this far from 0 and 1.
            out[known] = normal_quantile(np.clip(u, 1e-7, 1 - 1e-7)) if normal else u
            return pd.Series(out).where(known, None)

        return place(v.cast("double"))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.value(c, column(c)).alias(c) for c in df.columns])


def rank_position(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Position among sorted knots in [0, 1]: straight between two, the middle of equal ones."""
    last = len(knots) - 1
    below, upto = np.searchsorted(knots, x, side="left"), np.searchsorted(knots, x, side="right")
    at = np.clip(upto - 1, 0, last - 1)
    gap = np.maximum(knots[at + 1] - knots[at], np.finfo(float).tiny)
    position = np.where(upto > below, (below + upto - 1) / 2, at + (x - knots[at]) / gap) / last
    return np.where(x <= knots[0], 0.0, np.where(x >= knots[-1], 1.0, position))


def fit_quantile_scaler(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000, normal: bool = True,
                        small: int = SMALL, exact: bool = True) -> QuantileScaler:
    """Knots at evenly spaced quantiles, at most one per row, exact at every size.

    ``exact=False`` takes them from one sketch over all rows instead.
    """
    n = df.count()
    k = max(2, min(n_quantiles, n))
    q = quantiles(df, cols, [i / (k - 1) for i in range(k)], exact=exact, small=small)
    return QuantileScaler({c: [float(x) for x in q[c]] for c in cols if q[c][0] is not None}, normal)


# --- selection and interactions --------------------------------------------------

def label_correlation(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of every column with the label; null for constant columns."""
    row = df.agg(*[_correlation(column(c).cast("double"), F.col(label).cast("double")).alias(f"r{i}")
                   for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("correlation"))
                      for i, c in enumerate(cols)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def _correlation(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    moving = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(moving, F.try_divide(F.covar_pop(x, y), spread))


def select_by_corr(df: DataFrame, cols: Sequence[str], label: str, threshold: float | None = 0.01,
                   top: int | None = None) -> list[str]:
    """Columns with \\|r\\| above the threshold in table order, or the ``top`` strongest, strongest first."""
    found = [(r["feature"], abs(r["correlation"])) for r in label_correlation(df, cols, label).collect()
             if r["correlation"] is not None]
    if top is not None:
        return [f for f, _ in sorted(found, key=lambda x: (-x[1], x[0]))[:top]]
    return [f for f, r in found if threshold is None or r > threshold]


def pair_names(cols: Sequence[str], max_pairs: int | None = None) -> list[tuple[str, str]]:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return pairs if max_pairs is None else pairs[:max_pairs]


def interactions(df: DataFrame, cols: Sequence[str], max_pairs: int | None = None, packed: str | None = None) -> DataFrame:
    """Add the product ``a_b_inter`` of every pair of columns.

    With ``packed`` they come as one array column of that name instead.  Hundreds of product
    columns outgrow generated code, so these are taken from such an array.
    """
    pairs = pair_names(cols, max_pairs)
    if packed is not None:
        return df.withColumn(packed, packed_products(cols, max_pairs))
    if len(pairs) <= _WIDE:
        return df.select("*", *[(column(a) * column(b)).alias(f"{a}_{b}_inter") for a, b in pairs])
    built = df.withColumn("_products", packed_products(cols, max_pairs))
    return built.select(*[column(c) for c in df.columns],
                        *[F.col("_products")[i].alias(f"{a}_{b}_inter") for i, (a, b) in enumerate(pairs)])


def packed_products(cols: Sequence[str], max_pairs: int | None = None) -> Column:
    """All pair products as one array, in pair order."""
    values = F.array(*[column(c).cast("double") for c in cols])
    n = len(cols)
    index = F.sequence(F.lit(0), F.lit(n - 1))
    products = F.flatten(F.transform(index, lambda i: F.transform(
        F.slice(values, i + 2, F.lit(n)), lambda v: v * F.get(values, i))))
    return products if max_pairs is None else F.slice(products, 1, max_pairs)


# --- the whole chain -------------------------------------------------------------

@dataclass
class FlowPreprocessor:
    """Options of the preprocessing chain.

    Order: coerce, ``log_cols``, means for missing values (``fill_mean``), clip (``clip``
    then optionally percentile), skew log, scale, select by correlation with the label, pair
    products, append the text codes, keep within ``limit`` of zero, final scaling (``final``,
    with ``standardize``).  What is missing after the scaling becomes ``fill``.
    """

    numeric: Sequence[str]
    text: Sequence[str] = ()
    label: str | None = None
    log_cols: Sequence[str] = ()
    clip: str | None = "iqr"
    percentile_clip: bool = False
    skew_threshold: float | None = 1.0
    scale: str | None = "robust"
    select_threshold: float | None = 0.01
    select_top: int | None = None
    pairs: int | None = None
    use_pairs: bool = True
    standardize: bool = True
    null_token: str = ""
    fill: float = 0.0
    small: int = SMALL
    fill_mean: bool = False
    limit: float | None = None
    final: str = "standard"

    def columns(self, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
        """Label, text and coerced numeric columns, written once: a fit reads its source no more often."""
        kinds = dict(df.dtypes)
        other = [c for c in dict.fromkeys([*([self.label] if self.label else []), *self.text]) if c in kinds]
        numbers = [coerce_double(column(c), kinds[c] == "string").alias(c) for c in numeric if c not in other]
        if not other and not numbers:
            return df
        return materialize(df.select(*[column(c) for c in other], *numbers), "fit-columns")

    def fit(self, df: DataFrame) -> FlowPreprocessorModel:
        model = FlowPreprocessorModel(options=self)
        numeric = [c for c in self.numeric if c in df.columns]
        model.numeric = numeric
        df = self.columns(df, numeric)
        if self.text:
            model.encoder = fit_encoder(df, list(self.text), self.null_token)
        keep = [self.label] if self.label else []

        def stage():
            """The numeric columns after the steps fitted so far."""
            return df.select(*keep, *[model.step(c, df).alias(c) for c in numeric])

        if self.fill_mean and numeric:
            row = stage().agg(*[F.avg(column(c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
            model.means = {c: row[f"m{i}"] for i, c in enumerate(numeric) if row[f"m{i}"] is not None}
        if self.clip:
            model.bounds.append(fit_bounds(stage(), numeric, self.clip, self.small))
        if self.percentile_clip:
            model.bounds.append(fit_bounds(stage(), numeric, "percentile", self.small))
        if self.skew_threshold is not None:
            model.skew = fit_skew_log(stage(), numeric, self.skew_threshold)
        if self.scale == "quantile":
            model.scalers.append(fit_quantile_scaler(stage(), numeric, small=self.small))
            model.scalers.append(fit_scaler(stage(), numeric, "robust", self.small))
            model.scalers.append(fit_scaler(stage(), numeric, "standard", self.small))
        elif self.scale:
            model.scalers.append(fit_scaler(stage(), numeric, self.scale, self.small))
        selected = numeric
        if self.label and (self.select_top or self.select_threshold is not None):
            selected = select_by_corr(stage(), numeric, self.label, self.select_threshold, self.select_top)
        model.selected = selected
        if self.standardize:
            names = model.feature_names()
            model.final = (
                _fit_packed(model.packed(df), names, self.final) if model.is_wide()
                else fit_scaler(model.assemble(df), names, self.final)
            )
        return model


def _fit_packed(rows: DataFrame, names: Sequence[str], kind: str = "standard") -> Scaler:
    """Scaling of an array column by mean and deviation or by ends, all positions in one vector aggregate."""
    if kind not in ("standard", "minmax", "global_minmax"):
        raise ValueError(f"{kind} needs order statistics, which too many products rule out")
    stats = rows.select(
        Summarizer.metrics("mean", "variance", "min", "max", "count").summary(array_to_vector("_x")).alias("s")).first()["s"]
    if kind != "standard":
        low, high = [float(v) for v in stats["min"]], [float(v) for v in stats["max"]]
        if kind == "global_minmax":
            low, high = [min(low)] * len(low), [max(high)] * len(high)
        return Scaler(kind, dict(zip(names, low)), {n: b - a or 1.0 for n, a, b in zip(names, low, high)})
    n = stats["count"]
    shrink = (n - 1) / n if n > 1 else 0.0
    centre, width = {}, {}
    for i, name in enumerate(names):
        flat = stats["min"][i] == stats["max"][i]
        centre[name] = float(stats["mean"][i])
        width[name] = 1.0 if flat else math.sqrt(float(stats["variance"][i]) * shrink)
    return Scaler("standard", centre, width)


@dataclass
class FlowPreprocessorModel:
    """Fitted chain: ``transform`` is one projection (and a lookup per text column)."""

    options: FlowPreprocessor
    numeric: list[str] = field(default_factory=list)
    encoder: Encoder | None = None
    means: dict[str, float] = field(default_factory=dict)
    bounds: list[Bounds] = field(default_factory=list)
    skew: SkewLog | None = None
    scalers: list = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    final: Scaler | None = None

    def step(self, c: str, df: DataFrame) -> Column:
        """The numeric column ``c`` after all fitted steps."""
        v = coerce_double(column(c), dict(df.dtypes)[c] == "string")
        if c in self.options.log_cols:
            v = log1p_clipped(v)
        if c in self.means:
            v = F.coalesce(v, F.lit(self.means[c]))
        for b in self.bounds:
            v = b.value(c, v)
        if self.skew is not None:
            v = self.skew.value(c, v)
        for s in self.scalers:
            v = s.value(c, v)
        return v

    def pair_list(self) -> list[tuple[str, str]]:
        return pair_names(self.selected, self.options.pairs) if self.options.use_pairs else []

    def feature_names(self) -> list[str]:
        return [*self.selected, *[f"{a}_{b}_inter" for a, b in self.pair_list()], *self.options.text]

    def is_wide(self) -> bool:
        """Whether the products are too many to be generated as separate expressions."""
        return len(self.pair_list()) > _WIDE

    def _scaled(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The scaled columns as ``_s_*`` and the codes, before any product.

        Products come in a second projection, so that no column is computed once per
        product it takes part in.
        """
        if self.encoder is not None:
            df = self.encoder.apply(df, suffix="_code")
        fill = F.lit(self.options.fill)
        have = set(df.columns)
        scaled = [F.coalesce(self.step(c, df), fill).alias(f"_s_{c}") if c in have else fill.alias(f"_s_{c}")
                  for c in self.selected]
        return df.select(*keep, *scaled, *[F.col(f"{c}_code") for c in self.options.text])

    def _limited(self, v: Column) -> Column:
        limit = self.options.limit
        return v if limit is None else clip(v, -float(limit), float(limit))

    def packed(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` and all features before the final scaling as one array ``_x``."""
        names = [f"_s_{c}" for c in self.selected]
        parts = [F.array(*[column(n) for n in names]), packed_products(names, len(self.pair_list()))]
        if self.options.text:
            parts.append(F.array(*[F.col(f"{c}_code").cast("double") for c in self.options.text]))
        whole = F.concat(*parts)
        if self.options.limit is not None:
            whole = F.transform(whole, self._limited)
        return self._scaled(df, keep).select(*keep, whole.alias("_x"))

    def _packed_final(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        rows = self.packed(df, keep)
        if self.final is None:
            return rows
        names = self.feature_names()

        def literal(values):
            return F.expr("array(" + ",".join(f"{float(values[n])!r}D" for n in names) + ")")

        centred = F.zip_with("_x", literal(self.final.centre), lambda v, m: v - m)
        return rows.select(*keep, F.zip_with(centred, literal(self.final.width), lambda v, w: v / w).alias("_x"))

    def assemble(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Features before the final scaling, one column each."""
        base = self._scaled(df, keep)
        return base.select(
            *keep,
            *[self._limited(F.col(f"`_s_{c}`")).alias(c) for c in self.selected],
            *[self._limited(F.col(f"`_s_{a}`") * F.col(f"`_s_{b}`")).alias(f"{a}_{b}_inter") for a, b in self.pair_list()],
            *[self._limited(F.col(f"{c}_code").cast("double")).alias(c) for c in self.options.text],
        )

    def refit_bounds(self, df: DataFrame) -> FlowPreprocessorModel:
        """The same chain with clip limits and skew shifts taken from another table."""
        other = replace(self, bounds=[], skew=None, scalers=[])
        numeric = [c for c in self.numeric if c in df.columns]
        df = self.options.columns(df, numeric)
        methods = [self.options.clip] * bool(self.options.clip) + ["percentile"] * self.options.percentile_clip
        for method in methods:
            other.bounds.append(fit_bounds(df.select(*[other.step(c, df).alias(c) for c in numeric]), numeric, method,
                                           self.options.small))
        if self.skew is not None:
            other.skew = fit_skew_log(df.select(*[other.step(c, df).alias(c) for c in numeric]), numeric,
                                      self.options.skew_threshold)
        other.scalers = self.scalers
        return other

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.is_wide():
            rows = self._packed_final(df, keep)
            return rows.select(*keep, *[F.col("_x")[i].alias(n) for i, n in enumerate(self.feature_names())])
        flat = self.assemble(df, keep)
        if self.final is None:
            return flat
        return flat.select(*keep, *[self.final.value(c, column(c)).alias(c) for c in self.feature_names()])

    def vector(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """``keep`` plus one feature vector."""
        if self.is_wide():
            return self._packed_final(df, keep).select(*keep, array_to_vector("_x").alias(out))
        flat = self.transform(df, keep)
        safe = flat.toDF(*keep, *[f"f{i}" for i in range(len(flat.columns) - len(keep))])
        inputs = [c for c in safe.columns if c not in keep]
        return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error").transform(safe).select(*keep, out)

    # -- state ----------------------------------------------------------------

    def params(self, spark: SparkSession) -> DataFrame:
        """Fitted numbers as ``(stage, feature, param, position, value)``."""
        rows = [("select", c, "position", i, float(i)) for i, c in enumerate(self.selected)]
        rows += [("numeric", c, "position", i, float(i)) for i, c in enumerate(self.numeric)]
        rows += [("fill", c, "mean", 0, v) for c, v in self.means.items()]
        for k, b in enumerate(self.bounds):
            rows += [(f"clip{k}", c, name, 0, v) for c, (low, high) in b.limits.items()
                     for name, v in (("low", low), ("high", high))]
        if self.skew is not None:
            rows += [("skew", c, "shift", 0, v) for c, v in self.skew.shift.items()]
        for k, s in enumerate(self.scalers + ([self.final] if self.final else [])):
            stage = "final" if s is self.final else f"scale{k}"
            if isinstance(s, QuantileScaler):
                rows += [(stage, c, "knot", i, v) for c, q in s.knots.items() for i, v in enumerate(q)]
            else:
                rows += [(stage, c, "centre", 0, v) for c, v in s.centre.items()]
                rows += [(stage, c, "width", 0, v) for c, v in s.width.items()]
        return small_table(spark, rows, "stage string, feature string, param string, position int, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write params, vocabulary and options under ``path``; existing state is an error."""
        self.params(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/params")
        options = json.dumps(asdict(self.options))
        small_table(spark, [(options,)], "options string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/options")
        if self.encoder is not None:
            self.encoder.vocab.write.mode("errorifexists").parquet(f"{path}/vocab")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FlowPreprocessorModel:
        options = FlowPreprocessor(**json.loads(spark.read.parquet(f"{path}/options").first()["options"]))
        rows = spark.read.parquet(f"{path}/params").collect()
        by_stage: dict[str, list] = {}
        for r in rows:
            by_stage.setdefault(r["stage"], []).append(r)
        model = FlowPreprocessorModel(options)

        def ordered(stage):
            return [r["feature"] for r in sorted(by_stage.get(stage, []), key=lambda r: r["position"])]

        model.numeric, model.selected = ordered("numeric"), ordered("select")
        model.means = {r["feature"]: r["value"] for r in by_stage.get("fill", [])}
        for k in range(int(bool(options.clip)) + int(options.percentile_clip)):
            limits: dict = {}
            for r in by_stage.get(f"clip{k}", []):
                limits.setdefault(r["feature"], {})[r["param"]] = r["value"]
            model.bounds.append(Bounds({c: (v["low"], v["high"]) for c, v in limits.items()}))
        if options.skew_threshold is not None:
            model.skew = SkewLog({r["feature"]: r["value"] for r in by_stage.get("skew", [])})

        def scaler(stage, kind):
            part = by_stage.get(stage, [])
            knots: dict = {}
            for r in sorted((r for r in part if r["param"] == "knot"), key=lambda r: r["position"]):
                knots.setdefault(r["feature"], []).append(r["value"])
            if knots:
                return QuantileScaler(knots)
            return Scaler(kind, {r["feature"]: r["value"] for r in part if r["param"] == "centre"},
                          {r["feature"]: r["value"] for r in part if r["param"] == "width"})

        kinds = ["quantile", "robust", "standard"] if options.scale == "quantile" else [options.scale] if options.scale else []
        model.scalers = [scaler(f"scale{k}", kind) for k, kind in enumerate(kinds)]
        if options.standardize:
            model.final = scaler("final", options.final)
        if options.text:
            vocab = spark.read.parquet(f"{path}/vocab")
            sizes = {r["feature"]: r["n"] for r in vocab.groupBy("feature").agg(F.count("*").alias("n")).collect()}
            model.encoder = Encoder(list(options.text), vocab, sizes, options.null_token)
        return model
