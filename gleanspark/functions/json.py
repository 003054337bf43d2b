"""JSON helpers as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def object_keys(text: Column) -> Column:
    """Top-level keys in order; null if the text is no object."""
    return F.json_object_keys(text)


def get_path(text: Column, path: str) -> Column:
    """Value at a dotted path, numbers being array places: ``a.b.0``; null if there is none."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split(".") if s)
    return F.get_json_object(text, "$" + steps)


def pretty(text: Column) -> Column:
    """The document over several lines, indented by two blanks; null if it is none."""

    @F.pandas_udf("string")
    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    return indented(F.when(F.try_parse_json(text).isNotNull(), text))
