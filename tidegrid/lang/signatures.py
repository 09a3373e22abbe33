"""Arguments and results of the functions of the language."""

from __future__ import annotations

from dataclasses import dataclass

from .nodes import MATRIX, SCALAR, STRING, VECTOR


@dataclass(frozen=True)
class Signature:
    """``optional``: how many of the last arguments may be left out; -1: the last one may repeat, or be left out."""

    args: tuple[str, ...]
    result: str = VECTOR
    optional: int = 0
    experimental: bool = False


V, M, S, T = VECTOR, MATRIX, SCALAR, STRING

#: By name: arguments, and what else there is to say.
FUNCTIONS: dict[str, Signature] = {
    **{n: Signature((V,)) for n in "abs ceil floor exp sqrt ln log2 log10 sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh rad deg sgn timestamp absent sort sort_desc histogram_avg histogram_count histogram_sum histogram_stddev histogram_stdvar".split()},
    **{n: Signature((V,), optional=1) for n in "year month day_of_month day_of_week day_of_year days_in_month hour minute".split()},
    **{n: Signature((M,)) for n in "avg_over_time min_over_time max_over_time sum_over_time count_over_time stddev_over_time stdvar_over_time last_over_time present_over_time absent_over_time changes resets rate irate increase delta idelta deriv".split()},
    **{n: Signature((M,), experimental=True) for n in "mad_over_time first_over_time ts_of_first_over_time ts_of_last_over_time ts_of_max_over_time ts_of_min_over_time".split()},
    **{n: Signature((), S, experimental=True) for n in "start end step range".split()},
    "pi": Signature((), S), "time": Signature((), S),
    "scalar": Signature((V,), S), "vector": Signature((S,)),
    "max_of": Signature((S, S), S, experimental=True), "min_of": Signature((S, S), S, experimental=True),
    "round": Signature((V, S), optional=1), "clamp": Signature((V, S, S)), "clamp_min": Signature((V, S)), "clamp_max": Signature((V, S)),
    "quantile_over_time": Signature((S, M)), "predict_linear": Signature((M, S)),
    "double_exponential_smoothing": Signature((M, S, S), experimental=True),
    "histogram_quantile": Signature((S, V)), "histogram_fraction": Signature((S, S, V)),
    "histogram_quantiles": Signature((V, T, S, S), optional=-1, experimental=True),
    "label_replace": Signature((V, T, T, T, T)), "label_join": Signature((V, T, T, T), optional=-1),
    "sort_by_label": Signature((V, T), optional=-1, experimental=True), "sort_by_label_desc": Signature((V, T), optional=-1, experimental=True),
    "info": Signature((V, V), optional=1, experimental=True),
}

AGGREGATIONS = ("sum", "avg", "count", "min", "max", "group", "stddev", "stdvar", "topk", "bottomk", "count_values", "quantile", "limitk", "limit_ratio")
#: What the parameter of an aggregation must be.
PARAMETERS = {"topk": SCALAR, "bottomk": SCALAR, "quantile": SCALAR, "limitk": SCALAR, "limit_ratio": SCALAR, "count_values": STRING}
