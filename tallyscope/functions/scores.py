"""Per-record score expressions over ``probs ARRAY<DOUBLE>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .basic import as_col, clip, let, literal_array, total


def softmax(logits: Column, temperature: float = 1.0, floor: float = 1e-6) -> Column:
    """Temperature softmax, shifted by the row maximum."""
    scale = float(max(temperature, floor))
    return let(
        F.transform(logits, lambda x: x / F.lit(scale)),
        lambda z: let(
            F.array_max(z),
            lambda top: let(
                F.transform(z, lambda x: F.exp(x - top)),
                lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)),
            ),
        ),
    )


def confidence(probs: Column | str) -> Column:
    return F.array_max(as_col(probs))


def top_index(probs: Column | str) -> Column:
    """Index of the largest score; the lowest index wins a tie."""
    p = as_col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(probs: Column | str) -> Column:
    """Shannon entropy scaled to 0..1 by the log of the class count."""
    p = as_col(probs)
    clipped = F.transform(p, lambda x: clip(x, 1e-12, 1.0))
    raw = let(
        clipped,
        lambda c: let(
            total(c),
            lambda s: F.aggregate(
                c, F.lit(0.0), lambda acc, x: acc - (x / s) * F.log(x / s)
            ),
        ),
    )
    return clip(raw / F.log(F.size(p).cast("double")), 0.0, 1.0)


def margin(probs: Column | str) -> Column:
    """Gap between the two best scores; a lone class gives its own score."""
    p = as_col(probs)
    return let(
        F.sort_array(p, asc=False),
        lambda s: F.when(F.size(s) >= 2, s[0] - s[1]).otherwise(s[0]),
    )


def verdict(
    conf: Column, ent: Column, agreement: Column, low: float = 0.50, high: float = 0.55
) -> Column:
    """confident / borderline / uncertain; the first matching rule wins."""
    return (
        F.when((conf < low) | (ent > high) | (agreement < 0.6), "uncertain")
        .when((conf < 0.70) | (ent > 0.40) | (agreement < 0.8), "borderline")
        .otherwise("confident")
    )


def malignant_sum(probs: Column | str, flags: Sequence[bool]) -> Column:
    """Summed score of the flagged classes."""
    return total(
        F.zip_with(
            as_col(probs),
            literal_array([1.0 if f else 0.0 for f in flags]),
            lambda p, f: F.coalesce(p * f, F.lit(0.0)),
        )
    )


def risk_dot(probs: Column | str, weights: Sequence[float]) -> Column:
    """Weighted risk on a 0..100 scale."""
    dot = total(
        F.zip_with(
            as_col(probs), literal_array([float(w) for w in weights]),
            lambda p, w: F.coalesce(p * w, F.lit(0.0)),
        )
    )
    return clip(dot * 100.0, 0.0, 100.0)


def linear_logits(vector: Column, weights: Column, bias: Column | None = None, scale: float = 1.0) -> Column:
    """scale * (W v + b) for W ARRAY<ARRAY<DOUBLE>>, one row of W per class."""
    dots = F.transform(
        weights,
        lambda w: F.lit(float(scale))
        * F.aggregate(F.zip_with(w, vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x),
    )
    return dots if bias is None else F.zip_with(dots, bias, lambda d, b: d + b)
