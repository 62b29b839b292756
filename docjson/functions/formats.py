"""String formats of the schema language, as Python predicates and, where a pattern decides, as native columns."""

from __future__ import annotations

import datetime
import ipaddress
import re
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define these formats.
PATTERNS = {
    "email": r"[^\s@]+@[^\s@]+\.[^\s@]+",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}",
    "ipv4": r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}",
    "json-pointer": r"(?:/(?:[^~]|~[01])*)?",
    "relative-json-pointer": r"(?:0|[1-9][0-9]*)(?:#|/(?:[^~]|~[01])*)?",
    "duration": r"P(?!$)(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?|P[0-9]+W",
    "time": r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:[\s\S]*",
}
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
_INSTANT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)([Zz]|[+-][0-9]{2}:[0-9]{2})")
_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")


def _whole(name: str) -> Callable[[str], bool]:
    pattern = re.compile(PATTERNS[name])
    return lambda v: pattern.fullmatch(v) is not None


def _date(v: str) -> bool:
    m = _DATE.fullmatch(v)
    if not m:
        return False
    try:
        datetime.date(*map(int, m.groups()))
    except ValueError:
        return False
    return True


def _date_time(v: str) -> bool:
    m = _INSTANT.fullmatch(v)
    if not m:
        return False
    zone = "+00:00" if m[3] in "Zz" else m[3]
    try:
        datetime.datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}")
    except ValueError:
        return False
    return True


def _scheme(v: str) -> bool:
    try:
        return bool(urlsplit(v).scheme)
    except ValueError:
        return False


def _parses(v: str) -> bool:
    """A URL, or at least a relative reference (RFC 3986, 4.2): no colon in its first segment, no line break in its fragment."""
    try:
        urlsplit(v)
    except ValueError:
        rest, _, fragment = v.partition("#")
        return ":" not in re.split("[/?]", rest, maxsplit=1)[0] and "\n" not in fragment
    return True


def _labels(v: str, good: Callable[[str], bool]) -> bool:
    return len(v) <= 253 and all(0 < len(x) < 64 and good(x) for x in v.split("."))


def _ipv6(v: str) -> bool:
    try:
        ipaddress.IPv6Address(v)
    except ValueError:
        return False
    return True


def _variable(v: str) -> bool:
    """A variable of a template (RFC 6570, 2.3 and 2.4): a name, and ``*`` or a length after it."""
    name, colon, length = v.removesuffix("*").partition(":")
    named = name != "" and name.isascii() and name.replace("_", "a").isalnum()
    if not colon:
        return named
    return named and not v.endswith("*") and length.isascii() and length.isdigit() and length[0] != "0"


def _template(v: str) -> bool:
    """Literals without braces around expressions (RFC 6570, 2): an operator, if any, and variables between commas."""
    for i, piece in enumerate(v.split("{")):
        expression, closed, literal = piece.partition("}") if i else ("", "", piece)
        if "}" in literal or bool(closed) != bool(i):
            return False
        if i and not all(map(_variable, (expression[1:] if expression[:1] in tuple("+#./;?&") else expression).split(","))):
            return False
    return True


def _compiles(v: str) -> bool:
    try:
        re.compile(v)
    except re.error:
        return False
    return True


def _relative(v: str) -> bool:
    return v == "" or v[0] in "/#?"


CHECKS: dict[str, Callable[[str], bool]] = {
    "email": _whole("email"),
    "idn-email": _whole("email"),
    "date": _date,
    "time": _whole("time"),
    "date-time": _date_time,
    "duration": lambda v: v != "PT" and _whole("duration")(v),
    "uri": _scheme,
    "uri-reference": lambda v: _relative(v) or _parses(v),
    "uri-template": _template,
    "iri": _scheme,
    "iri-reference": lambda v: _relative(v) or _scheme(v),
    "hostname": lambda v: _labels(v, lambda x: _LABEL.fullmatch(x) is not None),
    "idn-hostname": lambda v: _labels(v, lambda x: x[0] != "-" and x[-1] != "-"),
    "ipv4": _whole("ipv4"),
    "ipv6": _ipv6,
    "uuid": _whole("uuid"),
    "json-pointer": _whole("json-pointer"),
    "relative-json-pointer": _whole("relative-json-pointer"),
    "regex": _compiles,
}


def matches(name: str, value: object) -> bool:
    """Whether ``value`` is a string of the format; an unknown format takes every string."""
    if not isinstance(value, str):
        return False
    check = CHECKS.get(name)
    return check is None or check(value)


def col_matches(name: str, value: Column) -> Column:
    """The same for a column, false for null: inside the JVM where a pattern or a built-in decides, else Arrow-batched."""
    if name.endswith("json-pointer"):
        # The JVM's regular expressions recurse once per character of a repeated alternative, and a word can have 100,000.
        start = r"\A(?:0|[1-9][0-9]*)(?:#?\z|/)" if name.startswith("relative") else r"\A(?:\z|/)"
        found = value.rlike(start) & ~value.rlike("~(?![01])")
    elif name in PATTERNS:
        found = value.rlike(f"\\A(?:{PATTERNS[name]})\\z")
        found = found & (value != "PT") if name == "duration" else found
    elif name == "idn-email":
        return col_matches("email", value)
    elif name == "date":
        found = value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~value.startswith("0000") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    elif name == "hostname":
        parts = F.split(value, r"\.", -1)
        found = (F.length(value) <= 253) & F.forall(parts, lambda x: x.rlike(r"\A[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\z") & (F.length(x) < 64))
    elif name in CHECKS:

        def batch(values: pd.Series) -> pd.Series:
            return values.map(lambda v: matches(name, v)).astype(bool)

        return F.pandas_udf(batch, "boolean")(value)
    else:
        found = value.isNotNull()
    return F.coalesce(found, F.lit(False))
