from netweave.functions.hashing import mix_uniform, row_hash, row_words, unit_hash
from netweave.functions.labels import (
    binary_label,
    detect_label_rule,
    flag_indicator,
    map_contains,
    map_values,
    tcp_flag_state,
)
from netweave.functions.numeric import (
    clean_infinite,
    clip,
    coerce_double,
    finite_or_null,
    hurwitz_zeta,
    log1p_clipped,
    normal_quantile,
    smoothed_ratio,
)

__all__ = [
    "binary_label", "clean_infinite", "clip", "coerce_double", "detect_label_rule", "finite_or_null",
    "flag_indicator", "hurwitz_zeta", "log1p_clipped", "map_contains", "map_values",
    "mix_uniform", "normal_quantile", "row_hash", "row_words", "smoothed_ratio", "tcp_flag_state", "unit_hash",
]
