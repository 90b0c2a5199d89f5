"""Text forms of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alnum(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^a-z0-9]", "")


def name_tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda t: t != "")


def simple_name(x: Column) -> Column:
    """Lower case without punctuation and white space."""
    return F.regexp_replace(F.lower(x), r"[\p{Punct}\s]+", "")


def prefix_of(x: Column) -> Column:
    """The prefix of an identifier; without a colon, null."""
    return F.when(F.instr(x, ":") > 0, F.upper(F.substring_index(x, ":", 1)))


def to_snake(x: Column) -> Column:
    """``ThisName`` and ``this name`` become ``this_name``."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", r"$1_$2"), r"[\s-]+", "_"))


def to_pascal(x: Column) -> Column:
    """``this_name`` becomes ``ThisName``."""
    return F.array_join(F.transform(F.split(x, r"[_\s-]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


#: Greek letters as names spell them.
GREEK = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ε", "epsilon"), ("κ", "kappa"), ("λ", "lambda"), ("μ", "mu"), ("ω", "omega"))


def clean_concept(x: Column) -> Column:
    """Greek letters spelled out, dashes and quotes made plain, white space folded; too short or all digits gives null."""
    for letter, name in GREEK:
        x = F.replace(x, F.lit(letter), F.lit(name))
    x = F.regexp_replace(x, "[‐-―]", "-")
    x = F.regexp_replace(x, "[‘’“”\"]", "'")
    x = F.btrim(F.regexp_replace(x, r"\s+", " "))
    return F.when((F.length(x) >= 2) & x.rlike("[A-Za-z]"), x)
