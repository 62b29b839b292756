"""JSON Pointers, as Python functions and as native columns.

Three dialects differ in what they do with a missing slash and with percent escapes; in all of them ``""`` and ``"/"`` name
the root, so an empty key at the top cannot be named.
"""

from __future__ import annotations

from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape(token: str) -> str:
    return token.replace("~1", "/").replace("~0", "~")


def escape(token: Any) -> str:
    return str(token).replace("~", "~0").replace("/", "~1")


def join(base: str, token: Any) -> str:
    return f"{base}/{escape(token)}"


def tokens(path: Any, lenient: bool = False, percent: bool = False) -> list[str]:
    """The decoded tokens of a pointer. Without ``lenient``, one that doesn't start with a slash raises ValueError."""
    if not isinstance(path, str):
        raise ValueError("Invalid path: must be a string")
    if path in ("", "/"):
        return []
    if path[0] != "/":
        if not lenient:
            raise ValueError(f'Invalid JSON Pointer (must start with "/"): {path}')
        path = "/" + path
    plain = [unescape(t) for t in path[1:].split("/")]
    return [unquote(t) if "%" in t else t for t in plain] if percent else plain


MISSING = object()


def walk(document: Any, path: list[str], loose_index: bool = True) -> Any:
    """The value at ``path`` or MISSING. ``loose_index`` takes what Python's ``int`` takes; ``-`` is never a place."""
    here = document
    for t in path:
        if isinstance(here, dict):
            if t not in here:
                return MISSING
            here = here[t]
        elif isinstance(here, list):
            i = index(t, loose_index)
            if i is None or not 0 <= i < len(here):
                return MISSING
            here = here[i]
        else:
            return MISSING
    return here


def index(token: str, loose: bool = True) -> int | None:
    if not loose:
        return int(token) if token.isascii() and token.isdigit() and (token == "0" or token[0] != "0") else None
    try:
        return int(token)
    except ValueError:
        return None


def col_unescape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def col_unescape_url(token: Column) -> Column:
    """Percent escapes too; a malformed one leaves the token as it was."""
    plain = col_unescape(token)
    decoded = F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(plain, F.lit("%")), F.coalesce(decoded, plain)).otherwise(plain)


def col_escape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def col_join(base: Column, token: Column) -> Column:
    return F.concat(base, F.lit("/"), col_escape(token))


def col_tokens(path: Column, lenient: bool = False) -> Column:
    """The decoded tokens; null for a pointer that the strict dialect refuses."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)) if lenient else path
    parts = F.transform(F.slice(F.split(full, "/"), 2, 1_000_000), col_unescape)
    root = F.array().cast("array<string>")
    fine = F.lit(True) if lenient else F.startswith(path, F.lit("/"))
    return F.when(path.isin("", "/"), root).when(fine, parts)
