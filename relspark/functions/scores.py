"""Score-vector math as Column -> Column expressions (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Catalyst does not share common subexpressions inside higher-order-function lambdas, so an
    expression such as ``array_max(x)`` written inside ``transform(x, ...)`` would run once
    per element.  Binding it through a one-element ``transform`` runs it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double_array(x: Column | str) -> Column:
    """Cast an ``array<float>`` (or any numeric array) to ``array<double>``."""
    return _col(x).cast("array<double>")


def softmax(x: Column | str) -> Column:
    """Row softmax, shifted by the row maximum for stability."""
    x = _col(x)
    return let(
        F.array_max(x),
        lambda m: let(
            F.transform(x, lambda v: F.exp(v - m)),
            lambda e: let(
                F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, v: acc + v),
                lambda total: F.transform(e, lambda v: v / total),
            ),
        ),
    )


def sigmoid(x: Column | str) -> Column:
    """Elementwise logistic function of a scalar column."""
    x = _col(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_array(x: Column | str) -> Column:
    """Elementwise logistic function of an array column."""
    return F.transform(_col(x), lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))


def argmax(x: Column | str) -> Column:
    """0-based index of the first maximum; NaN counts as the largest value; empty -> null."""
    return let(_col(x), lambda a: (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int"))


def bce_with_logits_sum(logits: Column | str, targets: Column | str) -> Column:
    """Sum over one row of binary cross-entropy with logits, in the overflow-free form
    ``max(x, 0) - x * z + log(1 + exp(-|x|))``."""
    pairs = F.zip_with(
        _col(logits),
        _col(targets),
        lambda x, z: F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x))),
    )
    return F.aggregate(pairs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
