"""Money as integer cents.

Every parser returns null for text that is not an amount; the caller turns the null into a
warning or a reject row, so one bad value never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: largest supported magnitude, 999,999,999,999.99 in cents.
MAX_CENTS = 99_999_999_999_999

# What trims and separates in typed text: ASCII and Unicode spaces, and the byte order mark.
BLANKS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANK_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK_CHARACTERS))


def in_range(cents: Column) -> Column:
    return F.abs(cents) <= F.lit(MAX_CENTS)


def guarded(cents: Column) -> Column:
    """Null outside the supported range."""
    return F.when(in_range(cents), cents)


def from_decimal(value: Column) -> Column:
    """Decimal units (double or decimal) to cents, half away from zero."""
    return (value.cast("decimal(20,2)") * 100).cast("bigint")


def to_decimal(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") / 100).cast("decimal(16,2)")


def to_db(cents: Column) -> Column:
    """Cents to plain decimal text: -1 is ``-0.01``."""
    size = F.abs(cents)
    return F.concat(
        F.when(cents < 0, "-").otherwise(""),
        ((size - size % 100) / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _decimal_text(text: Column) -> Column:
    """``-12.345`` to cents; the third fraction digit decides the rounding.

    Amounts beyond the range of the result are null.
    """

    def digits_to_cents(plain: Column) -> Column:
        fraction = F.rpad(F.regexp_extract(plain, r"\.(\d*)$", 1), 3, "0")
        digits = F.regexp_extract(plain, r"^-?0*(\d*)", 1)
        whole = F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("decimal(20,0)"))
        hundredths = F.substring(fraction, 1, 2).cast("int")
        up = (F.substring(fraction, 3, 1) >= "5").cast("int")
        sign = F.when(F.startswith(plain, F.lit("-")), -1).otherwise(1)
        return sign * (whole * 100 + hundredths + up)

    number = F.when(text.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), text)
    return let(let(number, digits_to_cents), guarded).cast("bigint")


def from_db(text: Column) -> Column:
    """Stored decimal text to cents; null counts as zero."""
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(_decimal_text(trimmed(text)))


def parse_user_amount(text: Column) -> Column:
    """A typed pt-BR amount to cents.

    Comma is the decimal mark. A single dot with at most two digits after it is decimal;
    any other dot groups thousands. Parentheses and a leading minus negate.
    """
    common = text.rlike(r"^-?(?:\d[\d.]{0,11},\d{1,2}|\d{1,12}(?:\.\d{1,2})?)\z")
    units = F.when(F.contains(text, F.lit(",")), F.translate(text, ",.", ".")).otherwise(text)
    return F.when(common, _plain_cents(units)).otherwise(_any_user_amount(text))


def _plain_cents(text: Column) -> Column:
    """Cents of ``-1234.5``, at most twelve digits and two after the dot."""
    return (text.try_cast("decimal(14,2)") * 100).cast("bigint")


def _any_user_amount(text: Column) -> Column:
    """Every other form: currency signs, parentheses, blanks, further fraction digits."""

    def value(body: Column) -> Column:
        return F.regexp_replace(body, r"^[-+]", "")

    def plain(digits: Column) -> Column:
        return (
            F.when(~digits.rlike(r"^[\d.,]+$"), F.lit(None))
            .when(
                F.contains(digits, F.lit(",")),
                F.regexp_replace(F.regexp_replace(digits, r"\.", ""), r"^([^,]*),", "$1."),
            )
            .when(digits.rlike(r"^\d*\.\d{0,2}$"), digits)
            .otherwise(F.regexp_replace(digits, r"\.", ""))
        )

    def signed(raw: Column) -> Column:
        wrapped = F.startswith(raw, F.lit("(")) & F.endswith(raw, F.lit(")"))
        inner = F.when(wrapped, F.regexp_replace(raw, r"^\(|\)$", "")).otherwise(raw)
        bare = F.regexp_replace(inner, r"(?i)R\$|" + BLANKS, "")
        return let(
            F.struct(bare.alias("text"), wrapped.alias("wrapped")),
            lambda b: let(value(b["text"]), lambda digits: _decimal_text(plain(digits)))
            * F.when(F.startswith(b["text"], F.lit("-")) != b["wrapped"], -1).otherwise(1),
        )

    return let(trimmed(text), signed)


def parse_tolerant_amount(text: Column) -> Column:
    """A statement amount to cents: of comma and dot, the last one is the decimal mark.

    A lone dot is always decimal here, unlike in :func:`parse_user_amount`.
    """
    common = text.rlike(r"^-?\d{1,12}(?:[.,]\d{1,2})?\z")
    return F.when(common, _plain_cents(F.translate(text, ",", "."))).otherwise(_any_tolerant_amount(text))


def _any_tolerant_amount(text: Column) -> Column:
    """Every other form: currency signs, blanks, grouped thousands, further fraction digits."""

    def plain(raw: Column) -> Column:
        comma = F.length(raw) - F.instr(F.reverse(raw), ",")
        dot = F.length(raw) - F.instr(F.reverse(raw), ".")
        has_comma, has_dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
        without_dots = F.when(has_dot, F.regexp_replace(raw, r"\.", "")).otherwise(raw)
        decimal_comma = F.regexp_replace(without_dots, r"^([^,]*),", "$1.")
        return F.when(has_comma & (~has_dot | (comma > dot)), decimal_comma).otherwise(
            F.regexp_replace(raw, ",", "")
        )

    raw = F.regexp_replace(text, r"(?i)" + BLANKS + r"|R\$", "")
    return _decimal_text(F.regexp_replace(let(raw, plain), r"^\+", ""))


def allocate(total: Column, parts: Column) -> Column:
    """Split ``total`` cents in ``parts``; the first ones take the odd cents."""
    size = F.abs(total)
    rest = F.pmod(size, parts)
    base = ((size - rest) / parts).cast("bigint")  # exact: the remainder is gone
    sign = F.when(total < 0, -1).otherwise(1)
    return F.transform(
        F.sequence(F.lit(0), (parts - 1).cast("int")),
        lambda i: sign * (base + F.when(i < rest, 1).otherwise(0)),
    )


def format_amount(cents: Column) -> Column:
    """``1.234,56``"""
    size = F.abs(cents)
    units = ((size - size % 100) / 100).cast("bigint")
    return F.concat(
        F.when(cents < 0, "-").otherwise(""),
        F.translate(F.format_number(units, 0), ",", "."),
        F.lit(","),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def format_brl(cents: Column) -> Column:
    """``R$ 1.234,56`` with a no-break space, the minus before the symbol."""
    return F.concat(
        F.when(cents < 0, "-").otherwise(""), F.lit("R$\u00a0"), format_amount(F.abs(cents))
    )


def is_inflow(cents: Column) -> Column:
    return cents > 0


def is_outflow(cents: Column) -> Column:
    return cents < 0


def direction_of(cents: Column) -> Column:
    return F.when(cents > 0, "entrada").otherwise("saida")


def safe_sum(cents: Column) -> Column:
    """A sum that fails the job when it leaves the supported range.

    The total is widened to ``decimal(38,0)`` so it cannot wrap before the check.
    """
    total = F.coalesce(F.sum(cents.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return (
        F.when(in_range(total), total)
        .otherwise(F.raise_error(F.lit("monetary total out of supported range")))
        .cast("bigint")
    )


def sum_when(condition: Column, cents: Column) -> Column:
    """Conditional sum, zero when nothing qualifies."""
    return F.coalesce(F.sum(F.when(condition, cents)), F.lit(0).cast("bigint"))
