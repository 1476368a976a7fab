"""String functions over columns; nulls stay null, except that predicates and searches give False and -1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LETTER = r"[\p{L}]"


def length(c: Column) -> Column:
    return F.length(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def _characters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def swapcase(c: Column) -> Column:
    return F.array_join(F.transform(_characters(c), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def title(c: Column) -> Column:
    """Upper case after every character that isn't a letter, lower case elsewhere."""
    return F.array_join(F.transform(_characters(c), lambda x, i: F.when((i > 0) & F.coalesce(F.get(_characters(c), i - 1).rlike(_LETTER), F.lit(False)), F.lower(x)).otherwise(F.upper(x))), "")


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def casefold(c: Column) -> Column:
    """Unicode folding; Spark has no function for it, so texts beyond ASCII go through Arrow."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(_casefold(c))


def strip(c: Column, chars: str | None = None) -> Column:
    return F.btrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lstrip(c: Column, chars: str | None = None) -> Column:
    return F.ltrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"(?U)^\s+", "")


def rstrip(c: Column, chars: str | None = None) -> Column:
    return F.rtrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"(?U)\s+$", "")


def ljust(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(c) < width, F.rpad(c, width, fill)).otherwise(c)


def rjust(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c)


def center(c: Column, width: int, fill: str = " ") -> Column:
    """Of an odd number of fills, the left side gets one more if the width is odd."""
    room = F.lit(width) - F.length(c)
    left = (room / 2).cast("int") + (room % 2) * (width % 2)
    return F.when(room > 0, F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), room - left))).otherwise(c)


def zfill(c: Column, width: int) -> Column:
    signed = c.rlike(r"^[+-]")
    rest = F.when(signed, F.substring(c, 2, 2147483647)).otherwise(c)
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(c)))
    return F.concat(F.when(signed, F.substring(c, 1, 1)).otherwise(""), zeros, rest)


def contains(c: Column, pattern: str, case: bool = True, regex: bool = False) -> Column:
    """Literal search by default; without ``case`` both sides are compared in lower case."""
    if regex:
        return F.coalesce(c.rlike(pattern if case else f"(?i){pattern}"), F.lit(False))
    return F.coalesce(F.contains(c, F.lit(pattern)) if case else F.contains(F.lower(c), F.lit(pattern.lower())), F.lit(False))


def startswith(c: Column, pattern: str) -> Column:
    return F.coalesce(F.startswith(c, F.lit(pattern)), F.lit(False))


def endswith(c: Column, pattern: str) -> Column:
    return F.coalesce(F.endswith(c, F.lit(pattern)), F.lit(False))


def find(c: Column, sub: str) -> Column:
    return F.coalesce(F.instr(c, F.lit(sub)) - 1, F.lit(-1))


def _all(c: Column, kind: str) -> Column:
    return F.coalesce(c.rlike(f"^(?U){kind}+\\z"), F.lit(False))


def isalpha(c: Column) -> Column:
    return _all(c, r"\p{L}")


def isalnum(c: Column) -> Column:
    return _all(c, r"[\p{L}\p{N}]")


def isdigit(c: Column) -> Column:
    """Decimal digits, and superscript, subscript and circled ones."""
    return _all(c, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]")


def isdecimal(c: Column) -> Column:
    return _all(c, r"\p{Nd}")


def isnumeric(c: Column) -> Column:
    return _all(c, r"\p{N}")


def isspace(c: Column) -> Column:
    return _all(c, r"\s")


def islower(c: Column) -> Column:
    return F.coalesce((c == F.lower(c)) & (c != F.upper(c)), F.lit(False))


def isupper(c: Column) -> Column:
    return F.coalesce((c == F.upper(c)) & (c != F.lower(c)), F.lit(False))


def istitle(c: Column) -> Column:
    """Cased, and equal to its title form."""
    return F.coalesce((c == title(c)) & (F.lower(c) != F.upper(c)), F.lit(False))


def replace(c: Column, old: str, new: str, regex: bool = False) -> Column:
    return F.regexp_replace(c, old, new) if regex else F.replace(c, F.lit(old), F.lit(new))


def split(c: Column, separator: str) -> Column:
    return F.split(c, r"\Q" + separator + r"\E")


def get(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i)) if i >= 0 else F.try_element_at(parts, F.lit(i))


def join(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def to_int(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def to_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


NAMES = [
    "length", "lower", "upper", "capitalize", "swapcase", "title", "casefold", "strip", "lstrip", "rstrip", "ljust", "rjust", "center", "zfill", "contains", "startswith", "endswith", "find",
    "isalpha", "isalnum", "isdigit", "isdecimal", "isnumeric", "isspace", "islower", "isupper", "istitle", "replace", "split",
]
