"""Small scalar functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOUR = r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?"
_DAY = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_H = "[0-9a-fA-F]"
_G = f"{_H}{{1,4}}"
_QUAD = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# What string formats accept. Java's $ also matches before a last newline, so they end in \z.
FORMATS = {
    "email": r"^(?!\.)(?!.*\.\.)([A-Za-z0-9_'+\-.]*)[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}\z",
    "url": r"^(https?|ftp|wss?)://[^\s/?#]+[^\s]*\z|^(?!(https?|ftp|wss?):)[A-Za-z][A-Za-z0-9+.-]*:[^\s]*\z",
    "uuid": rf"^({_H}{{8}}-{_H}{{4}}-[1-8]{_H}{{3}}-[89abAB]{_H}{{3}}-{_H}{{12}}|0{{8}}(-0{{4}}){{3}}-0{{12}}|f{{8}}(-f{{4}}){{3}}-f{{12}})\z",
    "datetime": rf"^{_DAY}T{_HOUR}(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)\z",
    "date": rf"^{_DAY}\z",
    "time": rf"^{_HOUR}\z",
    "ipv4": rf"^({_QUAD}\.){{3}}{_QUAD}\z",
    "ipv6": "^(" + "|".join([f"({_G}:){{7}}{_G}", f"({_G}:){{1,7}}:", *(f"({_G}:){{1,{7 - k}}}(:{_G}){{1,{k}}}" for k in range(1, 7)), f":((:{_G}){{1,7}}|:)", rf"::(ffff(:0{{1,4}})?:)?({_QUAD}\.){{3}}{_QUAD}", rf"({_G}:){{1,4}}:({_QUAD}\.){{3}}{_QUAD}"]) + r")\z",
    "base64": r"^([0-9a-zA-Z+/]{4})*(([0-9a-zA-Z+/]{2}==)|([0-9a-zA-Z+/]{3}=))?\z",
    "color": rf"^#({_H}{{3}}|{_H}{{6}})\z",
    "password": r"(?s)^.*\z",
    "phone": r"(?s)^.*\z",
}


def of_format(text: Column, name: str) -> Column:
    return text.rlike(FORMATS[name])


def _codes(text: Column, charset: str, digits: int) -> Column:
    """Code units of a text as an array of longs."""
    raw = F.hex(F.encode(text, charset))
    n = (F.length(raw) / digits).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(raw, i * digits + 1, F.lit(digits)), 16, 10).cast("long"))


def humanized(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "[_-]+", " "))


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/=\r\n", "-_"), F.lit("="))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    teen = (F.abs(n) % 100).between(11, 13)
    last = F.abs(n) % 10
    return F.concat(n.cast("string"), F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def storage(size: Column) -> Column:
    """Bytes in the largest fitting unit of 1024, one decimal."""
    names = ["B", "KB", "MB", "GB", "TB"]
    step = F.least(F.greatest(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)))), F.lit(0)), F.lit(len(names) - 1)).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), step), 1)
    return F.concat(F.format_number(value, 1), F.lit(" "), F.element_at(F.array(*map(F.lit, names)), step + 1))


def character_signature(text: Column) -> Column:
    """A 32-bit set of the code points of a text: texts within k edits differ in at most 2k bits."""
    bit = lambda c: F.call_function("shiftleft", F.expr("1L"), c.bitwiseXOR(F.shiftright(c, 5)).bitwiseAND(F.lit(31)).cast("int"))
    return F.aggregate(_codes(text, "UTF-32", 8), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(bit(c)))


def djb2(text: Column) -> Column:
    """Hash of the UTF-16 units (times 33 plus the unit, in 32 bits) in base 36, and the number of units."""
    units = _codes(text, "UTF-16BE", 4)
    value = F.aggregate(units, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % F.lit(1 << 32))
    return F.concat(F.lower(F.conv(value.cast("string"), 10, 36)), F.lit("_"), F.size(units).cast("string"))


def unbase64url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def time_prefix(ms: Column) -> Column:
    """Eight base-62 digits of a time in milliseconds: ids that begin so sort by time."""
    digit = lambda k: F.substring(F.lit(_BASE62), (F.floor(ms / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(k) for k in range(7, -1, -1)))


def time_of_prefix(text: Column) -> Column:
    """The time in milliseconds that an id begins with; null where the first eight characters are no base-62 digits."""
    digit = lambda k: (F.instr(F.lit(_BASE62), F.substring(text, k + 1, 1)) - 1).cast("long")
    return F.when(text.rlike("^[0-9A-Za-z]{8}"), reduce(lambda a, k: a * 62 + digit(k), range(8), F.lit(0).cast("long")))


def url_parts(url: Column) -> Column:
    """Protocol, host, path and query of an address; nulls for what is no address."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.struct(part("PROTOCOL").alias("protocol"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"))


def rgb(color: Column) -> Column:
    """Red, green and blue (0 to 255) of #rgb or #rrggbb; null for anything else."""
    short = F.regexp_replace(color, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    full = F.when(color.rlike(FORMATS["color"]), short)
    return F.transform(F.array(*map(F.lit, (2, 4, 6))), lambda i: F.conv(F.substring(full, i, F.lit(2)), 16, 10).cast("int"))


def inverted(color: Column) -> Column:
    """The complement of a colour, as #rrggbb."""
    parts = F.transform(rgb(color), lambda c: F.lpad(F.lower(F.hex(F.lit(255) - c)), 2, "0"))
    return F.when(color.rlike(FORMATS["color"]), F.concat(F.lit("#"), F.array_join(parts, "")))


def on_step(value: Column, step: str) -> Column:
    """Whether a number is a whole multiple of ``step``, in decimals: 19.99 is one of 0.01."""
    return value.cast("decimal(28,10)") % F.lit(step).cast("decimal(28,10)") == 0


def transformed(text: Column, steps: list[str]) -> Column:
    """``trim``, ``lowercase`` and ``uppercase``, in order."""
    known = {"trim": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "lowercase": F.lower, "uppercase": F.upper}
    return reduce(lambda c, name: known[name](c), steps, text)


def coerced(text: Column, kind: str) -> Column:
    """A text as a number, boolean or time; null where it is none."""
    low = F.lower(F.trim(text))
    if kind == "boolean":
        return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)
    return F.trim(text).try_cast("double" if kind == "number" else "timestamp")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def backoff(attempt: Column, first: float, most: float) -> Column:
    """Seconds until a retry: doubling from ``first`` up to ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def issues(rules: list[tuple[str, Column, str]]) -> Column:
    """(path, message) of every broken rule of a row; a rule that is null is kept."""
    found = [F.when(~F.coalesce(ok, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(text).alias("message"))) for path, ok, text in rules]
    return F.array_compact(F.array(*found))


def source_text(parts: list[Column], most: int) -> Column:
    """Non-empty parts on lines of their own, cut at ``most`` characters."""
    kept = [F.when(F.length(F.trim(p)) > 0, p) for p in parts]
    return F.rtrim(F.substring(F.concat_ws("\n", *kept), 1, most))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(False)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
