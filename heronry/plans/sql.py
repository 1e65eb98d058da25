"""Pieces of SQL that several queries' SQL share; written for DuckDB, apart from the operators."""

from __future__ import annotations


def path_key(c: str) -> str:
    """The plain spelling of a path column, by its steps from the left."""
    plain = f"regexp_replace({c}, '^[\\s\\x{{FEFF}}]+|[\\s\\x{{FEFF}}]+$', '', 'g')"
    local = f"CASE WHEN regexp_matches({plain}, '^(?i)file:') THEN url_decode(regexp_replace({plain}, '^(?i)file:(//[^/]*)?', '')) ELSE {plain} END"
    steps = f"list_filter(string_split(nfc_normalize(replace({local}, '\\', '/')), '/'), lambda x: x NOT IN ('', '.'))"
    return f"nullif(list_reduce(list_prepend('', {steps}), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END), '')"
