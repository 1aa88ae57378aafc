"""Judge names and the loosely typed fields of lookup responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeflow.functions.text import strip_ws


def parse_name_list(c: Column) -> Column:
    """Array of names from the printed form of a list, e.g. ``['A', "O'B"]``.

    Lists and tuples, with or without their brackets, give their trimmed, non-empty items; literals side by side are
    one item; ``None``, ``True`` and ``False`` are items by their names. A quoted or bare scalar gives itself, text that
    is no list gives its trimmed self, blank and null give an empty array.
    """
    text = strip_ws(c)
    # what follows up to the end holds whole literals only, so the place itself is in none
    quoted = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
    outside = rf"""(?=(?:[^'"\\]|{quoted})*+\z)"""
    item = rf"(?:(?:{quoted})(?:\s+(?:{quoted}))*|None|True|False|-?[0-9.]+)"
    as_list = F.regexp_replace(text, r"(?s)\A\((.*)\)\z", "[$1]")
    as_list = F.regexp_replace(as_list, rf"(?s)\A({item}\s*(?:,\s*{item}\s*)*,\s*(?:{item})?)\z", "[$1]")
    as_list = F.regexp_replace(as_list, r",\s*\]\z", "]")
    as_list = F.regexp_replace(as_list, rf"(?s)(?<=[\[,\s])(None|True|False)(?=\s*[,\]]){outside}", '"$1"')
    for quote in ("'", '"'):
        as_list = F.regexp_replace(as_list, rf"(?s){quote}\s+{quote}(?=(?:[^{quote}\\]|\\.)*+{quote}(?:[^'\"\\]|{quoted})*+\z)", "")
    as_list = F.regexp_replace(as_list, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
    items = F.from_json(as_list, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})
    trimmed = F.filter(F.transform(items, strip_ws), lambda x: x != "")
    scalar = strip_ws(F.regexp_replace(text, r"""(?s)\A(['"])(.*)\1\z""", "$2"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>"))
        .when(items.isNotNull(), trimmed)
        .otherwise(F.filter(F.array(scalar), lambda x: x != ""))
    )


def split_judges(c: Column) -> Column:
    """Names from a comma-separated string."""
    return F.filter(F.transform(F.split(c, ","), strip_ws), lambda x: x != "")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def json_or(body: Column, *fields: str) -> Column:
    """First of the fields with a value; empty strings, lists and objects, zero and false count as no value."""
    # fixed values: JSON texts that stand for nothing
    blank = ["", "[]", "{}", "0", "false"]
    read = [F.get_json_object(body, f"$.{f}") for f in fields]
    return F.coalesce(*[F.when(~r.isin(blank), r) for r in read])


def field_or_name(body: Column, field: str) -> Column:
    """A field that is either a plain value or an object with a ``name``."""
    as_object = F.from_json(body, f"{field} struct<name:string>")[field]
    return F.when(as_object.isNotNull(), as_object["name"]).otherwise(F.get_json_object(body, f"$.{field}"))


def match_count(raw: Column) -> Column:
    """Number of matches in a lookup response; 0 when there is none."""
    return F.coalesce(F.json_array_length(raw), F.array_size(F.json_object_keys(raw)), F.lit(0)).cast("int")
