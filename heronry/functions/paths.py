"""Path spelling, names and extensions."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ODD = re.compile(r"[\\]|//|/\.|^\s|\s$|^[Ff][Ii][Ll][Ee]:|/$|^\.")


def canonical_path(path: str | None) -> str | None:
    """The plain spelling of a path: absolute or relative, '/' between steps, no '.' or '..' that can be resolved,
    no URL form, no surrounding blanks, composed Unicode. Case is kept. Blank and null give null."""
    if path is None:
        return None
    if path.isascii() and not _ODD.search(path):
        return path or None
    s = path.strip().strip("\ufeff").strip()
    if s[:5].lower() == "file:":
        s = s[5:].replace("\\", "/")
        if s.startswith("//"):
            s = "/" + s[2:].partition("/")[2]
        s = unquote(s)
    s = unicodedata.normalize("NFC", s.replace("\\", "/"))
    root, steps = s.startswith("/"), []
    for step in s.split("/"):
        if step == "..":
            if steps and steps[-1] != "..":
                steps.pop()
            elif not root:
                steps.append(step)
        elif step not in ("", "."):
            steps.append(step)
    return ("/" if root else "") + "/".join(steps) or None


# A path in plain spelling, of ASCII and of Latin letters below U+0300 (composed, as no mark can follow them): no backslash, no empty or dotted step, no blank at an end, no URL form, no slash at its end.
_PLAIN = r"^(?![Ff][Ii][Ll][Ee]:|[. ])(?:[ -.0-\[\]-~¡-˿]|/(?![/.]|\z))+(?<! )\z"


@F.pandas_udf(T.StringType())
def _spelled(paths: pd.Series) -> pd.Series:
    return pd.Series([canonical_path(p) for p in paths], dtype=object)


def path_key(path: Column | str) -> Column:
    """canonical_path of a column. Paths in plain spelling are taken as they are; only the others go to Python, as Spark has
    no function for Unicode composition."""
    c = F.col(path) if isinstance(path, str) else path
    plain = F.coalesce(c.rlike(_PLAIN), F.lit(False))
    return F.when(plain, c).otherwise(_spelled(F.when(~plain, c)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
