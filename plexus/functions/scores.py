"""Score normalizers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column, k: float, x0: float) -> Column:
    return 1 / (1 + F.exp(-F.lit(k) * (x - F.lit(x0))))


#: Fixed values: (transform, steepness, midpoint) of each attribute's logistic.
LOGISTIC = {
    "probability_treats": ("x", 15.0, 0.6),
    "normalized_google_distance": ("x", -9.0, 0.6),
    "probability": ("x", 20.0, 0.8),
    "paired_concept_frequency": ("x", 2000.0, 0.002),
    "observed_expected_ratio": ("x", 2.0, 2.0),
    "chi_square": ("-ln", 0.03, 200.0),
    "pValue": ("-ln", 0.849, 4.97),
    "fisher_exact_test_p-value": ("-ln", 3.0, 2.7),
    "feature_coefficient": ("ln|x|", 2.75, 0.15),
}


def normalized(name: str, x: Column, maximum: Column | None = None) -> Column:
    """K2: an attribute's value as a score in [0, 1]; null and non-finite values give null."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    if name == "jaccard_index":
        score = x / (F.lit(1.0) if maximum is None else maximum)
    elif name == "cmap":
        score = F.abs(x / 100)
    elif name in LOGISTIC:
        form, k, x0 = LOGISTIC[name]
        y = {"x": x, "-ln": -F.log(x), "ln|x|": F.log(F.abs(x))}[form]
        score = logistic(y, k, x0)
        if form == "-ln":
            score = F.when(x <= F.lit(2.220446049250313e-16), F.lit(1.0)).otherwise(score)
    else:
        score = x
    return F.when(finite, score)


def publications_score(n: Column) -> Column:
    """K3: a logistic of the log count of distinct publications."""
    return F.when(n > 0, logistic(F.log(n.cast("double")), 3.16993, 1.60943)).otherwise(0.0)
