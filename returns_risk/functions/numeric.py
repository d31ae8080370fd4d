"""Ratios, clean-up of model input and number formats, as SQL expression texts.

Texts are for ``selectExpr`` and ``expr``; arguments are column names or SQL expressions.
"""

from __future__ import annotations

from string import Formatter


def sql_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def safe_ratio(top: str, bottom: str, zero_policy: str = "zero") -> str:
    """``top / bottom`` where a zero ``bottom`` yields 0 ("zero") or counts as 1 ("unit")."""
    if zero_policy == "zero":
        return f"coalesce(try_divide(double({top}), {bottom}), 0D)"
    if zero_policy == "unit":
        return f"double({top}) / if({bottom} > 0, {bottom}, 1)"
    raise ValueError(f"zero_policy must be 'zero' or 'unit', not {zero_policy!r}")


def finite_or_zero(value: str) -> str:
    """0 for null, NaN and either infinity. Spark ranks NaN above every number, so two tests do."""
    return f"if({value} > double('-inf') AND {value} < double('inf'), {value}, 0D)"


def fixed_decimals(value: str, digits: int) -> str:
    """Text with ``digits`` decimals, rounded on the exact binary value."""
    return f"format_number({value}, '0.{'0' * digits}')"


def rounded_like_text(value: str, digits: int = 2) -> str:
    """The number that the text of :func:`fixed_decimals` stands for."""
    return f"double({fixed_decimals(value, digits)})"


def fill_template(template: str) -> str:
    """A text from a template such as ``"rate {rate:.2f} in {orders:d} orders"``."""
    parts = []
    for text, field, spec, _ in Formatter().parse(template):
        if text:
            parts.append(sql_text(text))
        if field is None:
            continue
        if spec == "d":
            parts.append(f"string(bigint({field}))")
        elif spec.startswith(".") and spec.endswith("f"):
            parts.append(fixed_decimals(field, int(spec[1:-1])))
        else:
            raise ValueError(f"unsupported format {spec!r} in template")
    return f"concat({', '.join(parts)})" if parts else "''"
