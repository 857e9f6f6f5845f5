"""Dates in several layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layouts that are tried in order (the first stands for ISO dates, with or without a time of day).
LAYOUTS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "MM/dd/yyyy", "yyyyMMdd")


def parse_date(s: Column) -> Column:
    """The date that the text holds in the first layout that fits the whole of it, or else its first ten characters; NULL if none does. A time of day is dropped."""
    text = F.trim(s)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    shapes = [r"^\d{4}/\d{2}/\d{2}$", *[r"^\d{2}-\d{2}-\d{4}$", r"^\d{2}/\d{2}/\d{4}$"] * 2, r"^\d{8}$"]
    tries = [iso]
    for layout, shape in zip(LAYOUTS[1:], shapes, strict=True):
        for part in (text, F.substring(text, 1, 10)):
            tries.append(F.when(part.rlike(shape), F.try_to_date(part, layout)))
    return F.coalesce(*tries)


def days_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first)
