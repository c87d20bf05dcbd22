"""Scalar column expressions (F1-F14) and exact money arithmetic.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage codegen; no Python UDF is involved.

Money is ``decimal(18,2)``.  Averages and pro-rata splits of money are done in
integer cents with explicit round-half-up, so the result does not depend on
the engine's decimal-division scale rules.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tranche import config as C

MONEY = "decimal(18,2)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_map(c: str | Column, mapping: dict, default=None) -> Column:
    """``CASE c WHEN k1 THEN v1 ... [ELSE default] END`` from a dict."""
    x = col(c)
    out = None
    for k, v in mapping.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = F.when(x == k, val) if out is None else out.when(x == k, val)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


# ---------------------------------------------------------------------------
# Numeric helpers
# ---------------------------------------------------------------------------

def nan_to_null(c: str | Column) -> Column:
    """NaN -> null, so comparisons and means skip it (D-10)."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def idiv(a: Column, b: Column) -> Column:
    """Exact integer division truncated toward zero (bigint a, b != 0)."""
    return ((a - a % b).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("bigint")


def half_up_div(num: Column, den: Column) -> Column:
    """round(num / den) with halves away from zero, for integer num and den > 0."""
    q = idiv(F.abs(num) * 2 + den, den * 2)
    return F.when(num < 0, -q).otherwise(q)


def cents(money: Column) -> Column:
    """Exact integer cents of a money value."""
    return (money * 100).cast("bigint")


def from_cents(c: Column) -> Column:
    return (c.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def money_avg(total: Column, n: Column) -> Column:
    """Mean of money rounded half-up to cents; null when n = 0."""
    return F.when(n > 0, from_cents(half_up_div(cents(total), n)))


def money_sum(c: str | Column) -> Column:
    """Aggregate: sum of money cast back to decimal(18,2)."""
    return F.sum(col(c)).cast(MONEY)


def avg_round1(total: Column, n: Column) -> Column:
    """Integer mean rounded half-up to one decimal, as double; null when n = 0."""
    return F.when(n > 0, half_up_div(total.cast("bigint") * 10, n).cast("double") / 10.0)


def rate_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; null when whole is 0 or null."""
    return F.when(whole > 0, part.cast("double") * 100.0 / whole.cast("double"))


def success_rate(settled: Column, cancelled: Column) -> Column:
    """Success rate = settled / (settled + cancelled) * 100, null if nothing ended."""
    return rate_pct(settled, settled + cancelled)


# ---------------------------------------------------------------------------
# F1 / F2: tax ids
# ---------------------------------------------------------------------------

def normalize_tax_id(c: str | Column, width: int = 14) -> Column:
    """trim, drop '.', '/', '-', left-pad with zeros to ``width``.

    Longer input is kept whole (plain ``lpad`` would truncate it)."""
    s = F.translate(F.trim(col(c).cast("string")), "./-", "")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def format_tax_id(c: str | Column) -> Column:
    """``XX.XXX.XXX/XXXX-XX``; input returned unchanged when not 14 digits."""
    s = normalize_tax_id(c)
    pretty = F.concat(
        F.substring(s, 1, 2), F.lit("."), F.substring(s, 3, 3), F.lit("."),
        F.substring(s, 6, 3), F.lit("/"), F.substring(s, 9, 4), F.lit("-"),
        F.substring(s, 13, 2))
    return F.when(F.length(s) == 14, pretty).otherwise(col(c).cast("string"))


# ---------------------------------------------------------------------------
# Display text
# ---------------------------------------------------------------------------

def _brl_number(x: Column) -> Column:
    # '1,234,567.89' -> '1.234.567,89'
    return F.translate(F.format_number(x, 2), ",.", ".,")


def format_brl(c: str | Column) -> Column:
    """``R$ 1.234.567,89``; null -> ``R$ 0,00``."""
    x = col(c)
    return F.when(x.isNull(), F.lit("R$ 0,00")).otherwise(
        F.concat(F.lit("R$ "), _brl_number(x)))


def format_brl_scaled(c: str | Column, scale: float, suffix: str) -> Column:
    x = col(c)
    return F.when(x.isNull(), F.lit(f"R$ 0,00 {suffix}")).otherwise(
        F.concat(F.lit("R$ "), _brl_number(x.cast("double") / scale), F.lit(f" {suffix}")))


def format_brl_millions(c: str | Column) -> Column:
    """value in millions, ``R$ 2,50 MM``."""
    return format_brl_scaled(c, 1e6, "MM")


def format_brl_billions(c: str | Column) -> Column:
    """value in billions, ``R$ 3,00 Bi``."""
    return format_brl_scaled(c, 1e9, "Bi")


def format_pattern(c: str | Column, pattern: str) -> Column:
    """``format_number`` with a decimal pattern such as ``'0.0'`` (no grouping)."""
    return F.call_function("format_number", col(c), F.lit(pattern))


def format_pct(c: str | Column, decimals: int = 1) -> Column:
    """``12.3%`` (dot decimal, half-even on the binary value like Python)."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.concat(format_pattern(col(c).cast("double"), pattern), F.lit("%"))


def format_int(c: str | Column) -> Column:
    """integer with ',' thousands, truncated toward zero."""
    return F.format_number(col(c).cast("bigint"), 0)


def company_label(name: str | Column, cnpj: str | Column, score: str | Column) -> Column:
    """F8: ``<name> - <formatted id> (Score: <n>)``."""
    return F.concat(col(name), F.lit(" - "), format_tax_id(cnpj),
                    F.lit(" (Score: "), format_pattern(col(score).cast("double"), "0"), F.lit(")"))


def gap_text(gap: str | Column) -> Column:
    """``-<millions> em risco`` when the gap is positive, else null."""
    g = col(gap)
    return F.when(g > 0, F.concat(F.lit("-"), format_brl_millions(g), F.lit(" em risco")))


# ---------------------------------------------------------------------------
# F10-F14
# ---------------------------------------------------------------------------

def plus_days(ts: str | Column, days: int) -> Column:
    """timestamp + N days, keeping the time part."""
    return col(ts) + F.make_dt_interval(F.lit(days))


def period_text(p: str | Column) -> Column:
    """month period -> ``yyyy-MM``."""
    return F.date_format(col(p), "yyyy-MM")


def is_missing(c: str | Column) -> Column:
    """null or NaN."""
    x = col(c)
    return x.isNull() | F.isnan(x)


def risk_class(score: str | Column) -> Column:
    """CRÍTICO >= 80, ALTO >= 60, MÉDIO >= 40, else BAIXO (null stays null)."""
    s = col(score)
    out = None
    for label, cut in C.RISK_CLASSES:
        if cut is None:
            out = out.when(s.isNotNull(), F.lit(label))
        else:
            out = F.when(s >= cut, F.lit(label)) if out is None else out.when(s >= cut, F.lit(label))
    return out


def success_band(rate: str | Column) -> Column:
    """company success band, >= 70 good, >= 50 moderate, else attention."""
    r = col(rate)
    return (F.when(r >= 70, F.lit("BOM")).when(r >= 50, F.lit("MODERADO"))
            .when(r.isNotNull(), F.lit("ATENÇÃO")))


def global_success_band(rate: str | Column) -> Column:
    """global success band, > 70 excellent, >= 50 adequate, else attention."""
    r = col(rate)
    return (F.when(r > 70, F.lit("EXCELENTE")).when(r >= 50, F.lit("ADEQUADO"))
            .when(r.isNotNull(), F.lit("ATENÇÃO")))


def probability_band(p: str | Column) -> Column:
    """model probability band, > 0.7 very high, >= 0.5 high, else moderate/low."""
    x = col(p)
    return (F.when(x > 0.7, F.lit("MUITO ALTO")).when(x >= 0.5, F.lit("ALTO"))
            .when(x.isNotNull(), F.lit("MODERADO/BAIXO")))


def score_mean_band(m: str | Column) -> Column:
    """mean-score band, < 40 low, <= 60 moderate, > 60 high."""
    x = col(m)
    return (F.when(x < 40, F.lit("BAIXO")).when(x <= 60, F.lit("MODERADO"))
            .when(x.isNotNull(), F.lit("ALTO")))


def round1(c: str | Column) -> Column:
    """round to one decimal (half up)."""
    return F.round(col(c), 1)


def instalment_band(n: str | Column) -> Column:
    """Band of the instalment count (``faixa_parcelas``)."""
    x = col(n)
    out = None
    for label, lo, hi in C.INSTALMENT_BANDS:
        cond = (x >= lo) if hi is None else x.between(lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def status_label(code: str | Column) -> Column:
    """Status code -> label, from the fixed vocabulary."""
    return case_map(code, C.STATUS)


def priority_label(code: str | Column) -> Column:
    """Alert priority code -> label."""
    return case_map(code, C.PRIORITIES)


def success_probability(risk: str | Column) -> Column:
    """Risk class -> probability of receiving (decimal(3,2)); unknown -> null."""
    return case_map(risk, {k: F.lit(Decimal(v)).cast("decimal(3,2)") for k, v in C.SUCCESS_PROBABILITY.items()})
