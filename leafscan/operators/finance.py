"""Finance formulas over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365


def difference(a: Column, b: Column) -> Column:
    """I1"""
    return a - b


def list_sum(values: Column) -> Column:
    """An empty list sums to 0."""
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL for a zero denominator; ``calculate`` reports it as an error."""
    return F.try_divide(numerator, denominator)


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * 100


def yoy_reverse(current: Column, growth: Column) -> Column:
    """I4: the base a growth rate was applied to."""
    return F.try_divide(current, 1 + growth)


def bond_interest(principal: Column, rate: Column, days: Column) -> Column:
    """I5"""
    return principal * rate * days / DAYS_PER_YEAR


def claim_base(expense: Column, deductible: Column, compensation: Column | None = None) -> Column:
    paid = F.coalesce(compensation, F.lit(0.0)) if compensation is not None else F.lit(0.0)
    return F.greatest(F.lit(0.0), expense - paid - deductible)


def deductible_claim(expense: Column, deductible: Column, compensation: Column | None = None, payout_rate: Column | None = None) -> Column:
    """I6"""
    rate = F.coalesce(payout_rate, F.lit(1.0)) if payout_rate is not None else F.lit(1.0)
    return claim_base(expense, deductible, compensation) * rate


# Operations, their parameters (aliases in order) and defaults, and the formulas shown.
PARAMETERS = {
    "difference": (("a",), ("b",)),
    "sum": (),
    "ratio": (("numerator",), ("denominator",)),
    "yoy_reverse": (("current",), ("growth_rate",)),
    "bond_interest": (("principal", "B"), ("rate", "i"), ("days", "t")),
    "deductible_claim": (("expense",), ("deductible",), ("compensation",), ("payout_rate",)),
}
DEFAULTS = {"compensation": 0.0, "payout_rate": 1.0}
FORMULAS = {
    "difference": "a - b",
    "sum": "sum(values)",
    "ratio": "numerator / denominator",
    "yoy_reverse": "current / (1 + growth_rate)",
    "bond_interest": "IA = B * i * t / 365",
    "deductible_claim": "max(0, expense - compensation - deductible) * payout_rate",
}


def calculate(calls: DataFrame) -> DataFrame:
    """Results of ``calls(operation, params MAP, values ARRAY)``; bad calls get an ``error`` instead."""
    op = F.lower(F.trim(F.coalesce("operation", F.lit(""))))
    params = F.col("params")

    def raw(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at(params, F.lit(n)) for n in names])

    def number(names: tuple[str, ...]) -> Column:
        value = F.trim(raw(names)).try_cast("double")
        if names[0] in DEFAULTS:
            return F.when(raw(names).isNull(), F.lit(DEFAULTS[names[0]])).otherwise(value)
        return value

    args = {name: [number(p) for p in wanted] for name, wanted in PARAMETERS.items()}
    values = F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.trim(v).try_cast("double"))
    results = {
        "difference": difference(*args["difference"]),
        "sum": list_sum(values),
        "ratio": ratio(*args["ratio"]),
        "yoy_reverse": yoy_reverse(*args["yoy_reverse"]),
        "bond_interest": bond_interest(*args["bond_interest"]),
        "deductible_claim": deductible_claim(*args["deductible_claim"]),
    }
    error = F.when(~op.isin(*FORMULAS), F.concat(F.lit("unsupported operation: "), op))
    for name, wanted in PARAMETERS.items():
        for names, arg in zip(wanted, args[name]):
            error = error.when((op == name) & arg.isNull(), F.lit(f"{names[0]} must be a number"))
    error = error.when((op == "sum") & F.exists(values, lambda v: v.isNull()), "value must be a number")
    error = error.when((op == "ratio") & (args["ratio"][1] == 0), "denominator must not be zero")
    error = error.when((op == "yoy_reverse") & (args["yoy_reverse"][1] == -1), "growth_rate must not be -1")

    def by_op(items: dict[str, Column]) -> Column:
        chain = F.when(F.lit(False), F.lit(None))
        for name, item in items.items():
            chain = chain.when(op == name, item)
        return chain

    rows = calls.select("*", op.alias("op"), by_op(results).alias("result"), by_op({k: F.lit(v) for k, v in FORMULAS.items()}).alias("formula"), error.alias("error"))
    good = F.col("error").isNull()
    return rows.select(
        *calls.columns,
        F.when(good, F.col("result")).alias("result"),
        F.when(good & (op == "ratio"), F.col("result") * 100).alias("percent"),
        F.when(good & (op == "deductible_claim"), claim_base(*args["deductible_claim"][:3])).alias("claim_base"),
        F.when(good, F.col("formula")).alias("formula"),
        "error",
    )
