"""Named preprocessing option sets of the model variants."""

from __future__ import annotations

from collections.abc import Sequence

from netweave.operators.features import FlowPreprocessor
from netweave.plans.schemas import MODEL_SUBSET, MODEL_SUBSET_TEXT

_SUBSET_NUMERIC = tuple(c for c in MODEL_SUBSET if c not in MODEL_SUBSET_TEXT)
_SUBSET = dict(numeric=_SUBSET_NUMERIC, text=MODEL_SUBSET_TEXT, log_cols=("src_bytes", "dst_bytes", "duration"),
               skew_threshold=None, select_threshold=None, use_pairs=False)


def full(numeric: Sequence[str], text: Sequence[str], label: str = "label") -> FlowPreprocessor:
    """All columns: clip, log skewed ones, robust scale, select, multiply pairs, standardise."""
    return FlowPreprocessor(numeric=tuple(numeric), text=tuple(text), label=label)


def wide(numeric: Sequence[str], text: Sequence[str], label: str = "label") -> FlowPreprocessor:
    """Very wide tables: the ten strongest columns and five products."""
    return FlowPreprocessor(numeric=tuple(numeric), text=tuple(text), label=label, select_threshold=None,
                            select_top=10, pairs=5)


def subset_robust() -> FlowPreprocessor:
    return FlowPreprocessor(**_SUBSET)


def subset_robust_short() -> FlowPreprocessor:
    """As :func:`subset_robust`, without the logarithm of the duration."""
    return FlowPreprocessor(**{**_SUBSET, "log_cols": ("src_bytes", "dst_bytes")})


def subset_minmax() -> FlowPreprocessor:
    return FlowPreprocessor(**_SUBSET, scale="minmax")


def subset_quantile() -> FlowPreprocessor:
    return FlowPreprocessor(**_SUBSET, scale="quantile", percentile_clip=True, standardize=False)


def standard_limited(numeric: Sequence[str], text: Sequence[str] = ()) -> FlowPreprocessor:
    """Means for missing values, standard scaling, ten deviations at most, then one range for all columns."""
    return FlowPreprocessor(numeric=tuple(numeric), text=tuple(text), clip=None, skew_threshold=None, fill_mean=True,
                            scale="standard", select_threshold=None, use_pairs=False, limit=10.0, final="global_minmax")


# How each variant balances, augments and combines; keys name the functions' options.
TRAINING = {
    "full": {"noise": 0.05, "mask": 0.1, "resample": "scores", "meta": "boosted"},
    "full_smote": {"noise": 0.05, "mask": 0.1, "resample": "features", "meta": "boosted", "early_stop": "macro_f1"},
    "full_smote_nc": {"noise": 0.05, "mask": 0.1, "resample": "categorical", "meta": "boosted"},
    "wide": {"noise": 0.0, "mask": 0.1, "resample": "scores", "meta": "boosted", "fraction": 0.1},
    "full_mixup": {"noise": 0.05, "mask": 0.1, "mixup": 0.2, "resample": "scores", "meta": "boosted"},
    "full_search": {"noise": 0.05, "mask": 0.1, "resample": "scores", "meta": "searched", "trials": 30},
    "subset": {"noise": 0.05, "mask": 0.1, "resample": "features", "meta": "boosted"},
    "subset_logistic": {"noise": 0.05, "mask": 0.1, "resample": "features", "meta": "logistic"},
    "subset_forest": {"noise": 0.05, "mask": 0.1, "resample": "features", "meta": "forest"},
    "subset_masked": {"noise": 0.05, "mask": 0.0, "resample": "features", "meta": "boosted", "schedule": "a"},
    "subset_weighted_mask": {"noise": 0.05, "mask": 0.0, "resample": "features", "meta": "boosted", "schedule": "b"},
    "subset_domain": {"noise": 0.05, "mask": 0.0, "resample": "domain", "meta": "boosted", "schedule": "a",
                      "calibrate": True},
}
