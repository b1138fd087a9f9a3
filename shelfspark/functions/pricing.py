"""Prices, discounts and numbers found in text.

Three page readers disagree on prices; each rule keeps its own name: ``adv``, ``cmp``, ``sim``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import blank_to_null, let

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def to_float(c: Column) -> Column:
    """Whole text as a number, else null (rejects Spark's own suffix forms such as ``5f``)."""
    return F.when(c.rlike(_FLOAT), c.try_cast("double"))


def to_int(c: Column) -> Column:
    """Whole text as an integer, else null."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))


def first_int(c: Column) -> Column:
    """First run of digits: ``(53)`` gives 53, ``1,234`` gives 1."""
    return F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int")


def first_float(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9.]+)", 1).try_cast("double")


def price_adv(c: Column) -> Column:
    """First run of digits and dots; anything that is no number is 0.0."""
    return F.coalesce(F.regexp_extract(_plain(c), r"[0-9.]+", 0).try_cast("double"), F.lit(0.0))


def price_cmp(c: Column) -> Column:
    """As ``price_adv``, but failure is null."""
    return F.regexp_extract(_plain(c), r"[0-9.]+", 0).try_cast("double")


def price_sim(c: Column) -> Column:
    """A number that must start on a digit (``.5`` gives 5); failure is null."""
    return F.regexp_extract(_plain(c), r"\$?([0-9]+\.?[0-9]*)", 1).try_cast("double")


def first_dollar_text(c: Column) -> Column:
    """First ``$`` price as written, null if there is none."""
    return blank_to_null(F.regexp_extract(c, r"\$[0-9]+(?:\.[0-9]{2})?", 0))


def comparison_price(c: Column) -> Column:
    """Number after a ``$`` sign only, else 0.0."""
    return price_adv(F.coalesce(F.regexp_extract(c, r"\$([0-9,.]+)", 1), F.lit("")))


def price_with_fallback(tagged: Column, texts: Column) -> Column:
    """``adv`` price of the tagged text; if that is 0, of the first text with ``$`` and a digit."""
    other = F.get(F.filter(texts, lambda t: t.rlike(r"\$\s*[0-9]")), F.lit(0))
    return let(
        price_adv(F.coalesce(tagged, F.lit("0"))),
        lambda first: F.when(first == 0, price_adv(F.coalesce(other, F.lit("0")))).otherwise(first),
    )


def regular_or_current(regular: Column, current: Column) -> Column:
    """A missing or zero regular price is the current one."""
    zero = F.lit(0).cast("int")
    return F.coalesce(F.nullif(regular, zero), current)


def discount_adv(current: Column, regular: Column) -> Column:
    """struct(amount, percent): unrounded amount, percent cut to a whole number."""
    lower = regular > current
    return F.struct(
        F.when(lower, regular - current).otherwise(F.lit(0.0)).alias("amount"),
        F.when(lower, ((regular - current) / regular * 100).cast("int"))
        .otherwise(F.lit(0))
        .alias("percent"),
    )


def round_one_place(x: Column) -> Column:
    """Round a non-negative double to one decimal by its exact binary value, ties to even.

    ``round`` and ``bround`` work on the printed decimal, so they turn 0.35 (which is a little
    less than 0.35) into 0.4. The tie point nearest to x is known as t = (2n + 1) / 20; when x
    equals t, the sign of t's own error (exact, by two exact subtractions) says which side x is on.
    """

    def nearest(x: Column, n: Column) -> Column:
        odd = 2 * n + 1
        t = odd / 20
        error = (t * 16 - odd) + t * 4
        up = F.when(x != t, x > t).when(error != 0, error > 0).otherwise(n % 2 == 1)
        return (n + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / 10

    def tenths(x: Column) -> Column:
        n = F.floor(x * 10).cast("double")
        return F.when(n / 10 > x, n - 1).otherwise(n)

    return let(x, lambda v: let(tenths(v), lambda n: nearest(v, n)))


def discount_rounded(current: Column, regular: Column) -> Column:
    """struct(amount, percent): both prices must be non-zero, percent to one decimal."""
    lower = (current != 0) & (regular != 0) & (regular > current)
    amount = regular - current
    return F.struct(
        F.when(lower, amount).otherwise(F.lit(0.0)).alias("amount"),
        F.when(lower, round_one_place(amount / regular * 100)).otherwise(F.lit(0.0)).alias("percent"),
    )


def sale_price_adv(current: Column, regular: Column) -> Column:
    """Current price when it undercuts a known regular price, else 0."""
    return F.when((regular > 0) & (current < regular), current).otherwise(F.lit(0.0))


def sale_price_cmp(current: Column, is_sale: Column) -> Column:
    """Current price on sale, else null."""
    return F.when(is_sale, current)
