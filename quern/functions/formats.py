"""Values as text for people, in US English: numbers, money, storage, phone numbers, dates and times ago.

Numbers are rounded half up on their shortest decimal form. Where nothing else is said null counts as 0, as
it does for a display of totals; dates and phone numbers of null are ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sign and decimals of currencies; others show their code and a no-break space.
CURRENCIES = {"USD": ("$", 2), "EUR": ("€", 2), "GBP": ("£", 2), "JPY": ("¥", 0), "CAD": ("CA$", 2), "AUD": ("A$", 2), "NZD": ("NZ$", 2), "MXN": ("MX$", 2), "BRL": ("R$", 2), "CNY": ("CN¥", 2), "INR": ("₹", 2), "KRW": ("₩", 0), "ILS": ("₪", 2), "VND": ("₫", 0)}
# Where the unit of storage changes, in bytes, with the unit, its size and its decimals.
STORAGE = ((10**6, "kB", 10**3, 0), (10**7, "MB", 10**6, 1), (10**9, "MB", 10**6, 0), (10**10, "GB", 10**9, 1), (10**12, "GB", 10**9, 0), (None, "TB", 10**12, 2))
# The units of a time ago in milliseconds, their short names, and the words for one of them before and after.
AGO = ((60_000, 1_000, "s", None), (3_600_000, 60_000, "min", None), (86_400_000, 3_600_000, "h", None), (30 * 86_400_000, 86_400_000, "d", ("yesterday", "tomorrow")), (365 * 86_400_000, 30 * 86_400_000, "mo", ("last mo.", "next mo.")), (None, 365 * 86_400_000, "y", ("last yr.", "next yr.")))


def _plain(value: Column, most: int, least: int = 0) -> Column:
    pattern = "#,##0" + ("." + "0" * least + "#" * (most - least) if most else "")
    return F.call_function("format_number", F.round(F.coalesce(value, F.lit(0)).cast("decimal(38,10)"), most), F.lit(pattern))


def number(value: Column, most: int = 2, least: int = 0) -> Column:
    """``1,234.5``: groups of three, between ``least`` and ``most`` decimals."""
    return _plain(value, most, least)


def number_in(text: Column) -> Column:
    """The number that a text's digits and points begin with, whatever stands between them; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"[^\d.]", ""), r"^\d*\.?\d*", 0), F.lit("")).try_cast("double")


def currency(value: Column, code: str = "USD", html: bool = False) -> Column:
    """``$1,234.50``; ``html`` marks sign, point and fraction and leaves out a fraction that is zero."""
    sign, decimals = CURRENCIES.get(code, (code + "\u00a0", 2))
    amount = F.coalesce(value, F.lit(0)).cast("decimal(38,10)")
    text = _plain(F.abs(amount), decimals, decimals)
    minus = F.when(amount < 0, "-").otherwise("")
    if not html:
        return F.concat(minus, F.lit(sign), text)
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    marked = F.when(fraction.rlike("[1-9]"), F.concat(F.lit('<span class="decimal">.</span><span class="fraction">'), fraction, F.lit("</span>"))).otherwise("")
    return F.concat(minus, F.lit(f'<span class="symbol">{sign}</span>'), whole, marked)


def storage(size: Column, largest: str = "TB") -> Column:
    """Bytes in units of 1000: ``23 kB``, ``1.5 MB``; nothing is put in a unit beyond the ``largest``, as in ``1,414 GB``."""
    size = F.coalesce(size, F.lit(0))
    out, last = None, max(i for i, (_, unit, *_) in enumerate(STORAGE) if unit == largest)
    for i, (limit, unit, one, decimals) in enumerate(STORAGE[: last + 1]):
        text = F.concat(_plain(size.cast("decimal(38,10)") / F.lit(one).cast("decimal(14,0)"), decimals), F.lit(f" {unit}"))
        fits = size < limit if i < last else F.lit(True)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


def phone(text: Column) -> Column:
    """Ten digits, also behind a 1, as ``+1 (555) 123-4567``; anything else as it stands."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    body = F.regexp_replace(digits, r"^1?(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    known = digits.rlike(r"^1?\d{10}$")
    return F.coalesce(F.when(known, F.concat(F.when(F.length(digits) == 11, "+1 ").otherwise(""), body)).otherwise(text), F.lit(""))


def date(time: Column, now: Column) -> Column:
    """The hour of a day that is today, month and day in this year, else the whole date, in the session's time zone.

    Before AM and PM stands a plain space, where some locale data have a narrow one.
    """
    year = lambda t: F.date_format(t, "yyyy")
    text = F.when(F.to_date(time) == F.to_date(now), F.date_format(time, "h:mm a")).when(year(time) == year(now), F.date_format(time, "MMM d")).otherwise(F.date_format(time, "M/d/yy"))
    return F.coalesce(text, F.lit(""))


def ago(ms: Column, now_ms: Column) -> Column:
    """``5min ago``, ``in 3d``, ``yesterday``: the distance of two times in milliseconds in its largest unit, months of 30 days."""
    past = now_ms - ms
    far, out = F.abs(past), None
    for limit, unit, name, words in AGO:
        n = F.floor(far / unit + 0.5)
        text = F.when(past > 0, F.concat(n, F.lit(f"{name} ago"))).otherwise(F.concat(F.lit("in "), n, F.lit(name)))
        if words:
            text = F.when(n == 1, F.when(past > 0, words[0]).otherwise(words[1])).otherwise(text)
        elif unit == 1_000:
            text = F.when(n == 0, "now").otherwise(text)
        fits = far < limit if limit else F.lit(True)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.when(past.isNotNull(), out)
