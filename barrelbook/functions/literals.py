"""Constant tables as one literal expression, folded by the optimizer."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(values: Mapping[str, str]) -> Column:
    """A map of strings."""
    return F.from_json(F.lit(json.dumps(dict(values))), "map<string, string>")


def literal_rows(rows: Sequence[Sequence[str]], fields: Sequence[str]) -> Column:
    """An array of structs of strings."""
    records = [dict(zip(fields, row)) for row in rows]
    ddl = ", ".join(f"{field}: string" for field in fields)
    return F.from_json(F.lit(json.dumps(records)), f"array<struct<{ddl}>>")
