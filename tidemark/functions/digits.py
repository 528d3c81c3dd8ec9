"""Decimal text of fractions beyond DECIMAL(38): long division in limbs of 15 digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 15


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _increment(digits: Column) -> Column:
    """A text of digits plus one; one digit longer if all were nines."""
    head = F.rtrim(digits, F.lit("9"))
    nines = F.repeat(F.lit("0"), F.length(digits) - F.length(head))
    raised = (F.right(head, F.lit(1)).cast("int") + 1).cast("string")
    return F.when(head == "", F.concat(F.lit("1"), nines)).otherwise(F.concat(F.left(head, F.length(head) - 1), raised, nines))


def fraction_text(numerator: Column, denominator: Column, precision: int = 50) -> Column:
    """numerator / denominator to `precision` significant digits, half to even, as text without exponent.

    An exact result has no zeros at its end. The whole part must have fewer digits than
    `precision`, the numerator fit DECIMAL(38,0), the denominator 18 digits. NULL for a
    NULL part or a denominator of zero or below.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    # leading zeros of the fraction are no significant digits: enough limbs for those of a denominator of 18 digits
    n_limbs = -(-(precision + 19) // LIMB) + 1

    def divided(d: Column, value: Column, text: Column, width: int) -> Column:
        """The next digits behind `text`, and what is left."""
        return _let(wide(value % d), lambda rest: F.struct(rest.alias("rest"), F.concat(text, F.lpad(wide((value - rest) / d).cast("string"), width, "0")).alias("text")))

    def told(parts: Column) -> Column:
        whole, fraction, rest = parts["whole"], parts["fraction"], parts["rest"]
        zeros = F.length(fraction) - F.length(F.ltrim(fraction, F.lit("0")))
        places = F.when(whole != "0", precision - F.length(whole)).otherwise(precision + zeros).cast("int")
        return _let(F.struct(whole.alias("whole"), rest.alias("rest"), F.left(fraction, places).alias("kept"), F.substr(fraction, places + 1).alias("tail")), rounded)

    def rounded(cut: Column) -> Column:
        whole, kept, tail, rest = cut["whole"], cut["kept"], cut["tail"], cut["rest"]
        half = F.rpad(F.lit("5"), F.length(tail), "0")
        odd = F.right(kept, F.lit(1)).cast("int") % 2 == 1
        up = (tail > half) | ((tail == half) & ((rest > 0) | odd))
        digits = F.concat(whole, kept)
        exact = (rest == 0) & (F.rtrim(tail, F.lit("0")) == "")

        def written(number: Column) -> Column:
            integer, last = F.left(number, F.length(number) - F.length(kept)), F.right(number, F.length(kept))
            # a carry beyond the first digit leaves one place too many
            grown = F.length(F.ltrim(number, F.lit("0"))) > precision
            last = F.when(exact, F.rtrim(last, F.lit("0"))).when(grown, F.left(last, F.length(last) - 1)).otherwise(last)
            return F.concat(integer, F.when(last == "", "").otherwise(F.concat(F.lit("."), last)))

        return _let(F.when(up, _increment(digits)).otherwise(digits), written)

    def divide(both: Column) -> Column:
        n, d = both["n"], both["d"]
        first = _let(wide(n % d), lambda rest: F.struct(wide((n - rest) / d).cast("string").alias("whole"), rest.alias("rest")))

        def with_fraction(start: Column) -> Column:
            begin = F.struct(start["rest"].alias("rest"), F.lit("").alias("text"))
            step = lambda a, _: divided(d, wide(a["rest"] * F.lit(10**LIMB).cast("decimal(16,0)")), a["text"], LIMB)
            end = F.aggregate(F.sequence(F.lit(1), F.lit(n_limbs)), begin, step)
            return _let(end, lambda e: told(F.struct(start["whole"].alias("whole"), e["text"].alias("fraction"), e["rest"].alias("rest"))))

        return _let(first, with_fraction)

    both = F.struct(F.abs(wide(numerator)).alias("n"), denominator.cast("decimal(18,0)").alias("d"))
    sign = F.when((numerator < 0), "-").otherwise("")
    return F.when((denominator > 0) & numerator.isNotNull(), F.concat(sign, _let(both, divide)))
