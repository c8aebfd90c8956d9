"""Text to typed values: blanks, keys, dates, decorated numbers; and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean no value, and date formats in the order in which they are tried.
MISSING = ["", "nan", "none", "null", "na", "n/a"]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "yyyyMMdd"]

# What letters count for in a vehicle number (none of I, O, Q), its places' weights, and the remainder that X stands for.
VIN_VALUES = dict(zip("0123456789ABCDEFGHJKLMNPRSTUVWXYZ", [*range(10), 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9], strict=True))
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_X = 10

# Signs of money.
SYMBOLS = "$€£¥"
DIGITS = "0123456789"


def blank(c: Column) -> Column:
    """Null for a text that means no value, else the text."""
    return F.when(~F.lower(F.trim(c)).isin(MISSING), c)


def norm_key(c: Column) -> Column:
    """A key without quotes around it or leading zeros; null if blank."""
    bare = F.regexp_replace(F.trim(c), r"^['\"]+|['\"]+$", "")
    return F.when(blank(bare).isNotNull(), F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0")))


def snake(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def number(c: Column) -> Column:
    """A plain number, with or without thousands commas and a dollar sign."""
    return F.regexp_replace(c, "[,$]", "").try_cast("double")


def _all_digits(c: Column) -> Column:
    return (F.length(c) > 0) & (F.translate(c, DIGITS, "") == "")


def unsigned(c: Column) -> Column:
    """Digits, in threes between commas if there are any, with or without a fraction; null for anything else."""
    parts, groups = F.split(c, "\\."), F.split(F.split(c, "\\.")[0], ",")
    threes = F.forall(F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0))), lambda g: _all_digits(g) & (F.length(g) == 3))
    whole = _all_digits(groups[0]) & threes & ((F.size(groups) == 1) | (F.length(groups[0]) <= 3))
    fraction = (F.size(parts) == 1) | (F.size(parts) == 2) & _all_digits(F.get(parts, F.lit(1)))
    return F.when(whole & fraction, F.replace(c, F.lit(","), F.lit("")).try_cast("double"))


def signed(c: Column) -> Column:
    """``unsigned`` after a minus, or without."""
    minus = F.startswith(c, F.lit("-"))
    x = unsigned(F.when(minus, F.ltrim(F.substr(c, F.lit(2)))).otherwise(c))
    return F.when(minus, -x).otherwise(x)


def money(c: Column) -> Column:
    """An amount before or after its one sign, a minus before or after that; brackets are a minus as well."""
    t = F.trim(c)
    bracketed = F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")"))
    sides = F.split(F.translate(F.when(bracketed, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t), SYMBOLS, "$" * len(SYMBOLS)), "\\$")
    before, after = F.trim(F.get(sides, F.lit(0))), F.trim(F.get(sides, F.lit(1)))
    plain = F.when(before == "", signed(after)).when(before == "-", -unsigned(after)).when(after == "", signed(before))
    x = F.when(bracketed, -F.when(before == "", unsigned(after)).when(after == "", unsigned(before))).otherwise(plain)
    return F.when(F.size(sides) == 2, x)


def percent(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.endswith(t, F.lit("%")), signed(F.rtrim(F.substr(t, F.lit(1), F.length(t) - 1))))


def clock(c: Column) -> Column:
    """A time of day as minutes since midnight."""
    parts = F.split(F.trim(c), ":")
    field = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    two = lambda i: _all_digits(F.get(parts, F.lit(i))) & (F.length(F.get(parts, F.lit(i))) == 2) & (field(i) < 60)
    hour = _all_digits(parts[0]) & (F.length(parts[0]) <= 2) & (field(0) < 24)
    return F.when(hour & two(1) & ((F.size(parts) == 2) | (F.size(parts) == 3) & two(2)), field(0) * 60 + field(1) + F.coalesce(field(2), F.lit(0.0)) / 60)


def quantity(c: Column) -> Column:
    """Currency and percent as their number, a clock as minutes since midnight; null for anything else."""
    return F.coalesce(clock(c), money(c), percent(c))


def day_number(c: Column, fmt: str) -> Column:
    """Days since 1970-01-01 of a text date; null where it doesn't parse."""
    return F.datediff(F.try_to_timestamp(c, F.lit(fmt)).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def from_day_number(c: Column, fmt: str) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.round(c).cast("int")), fmt)


def tokens(c: Column, sep: str = ";") -> Column:
    """The trimmed, non-empty members of a joined set; null for null."""
    return F.filter(F.transform(F.split(c, f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")


def vin_valid(c: Column) -> Column:
    """Whether a text is a vehicle number whose check digit holds; null for null."""
    v = F.upper(F.trim(c))
    values = F.create_map(*[F.lit(x) for kv in VIN_VALUES.items() for x in kv])
    total = sum((F.element_at(values, F.substring(v, i + 1, 1)) * w for i, w in enumerate(VIN_WEIGHTS)), F.lit(0)) % 11
    digit = F.substring(v, 9, 1)
    shape = v.rlike(f"^[{''.join(VIN_VALUES)}]{{{len(VIN_WEIGHTS)}}}$")
    return F.when(shape, total == F.when(digit == "X", VIN_X).otherwise(F.coalesce(digit.try_cast("int"), F.lit(-1)))).when(v.isNotNull(), F.lit(False))
