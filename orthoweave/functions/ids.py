"""Identifier rules: canonical keys and the prefixes under which ids are looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_key(a: Column, b: Column) -> tuple[Column, Column]:
    """The undirected key of an edge."""
    return F.least(a, b), F.greatest(a, b)


def first_dot(c: Column) -> Column:
    """The text before the first dot."""
    return F.substring_index(c, ".", 1)


def last_dot(c: Column) -> Column:
    """The text before the last dot."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def node_key(c: Column) -> Column:
    """Without a |suffix and a trailing .p."""
    return F.regexp_replace(F.regexp_replace(c, r"\|.*$", ""), r"\.p$", "")


def node_key_unversioned(c: Column) -> Column:
    """`node_key` without a trailing version number."""
    return F.regexp_replace(node_key(c), r"\.\d+$", "")


def pair_name(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def short_name(c: Column, n: int = 3) -> Column:
    return F.substring(c, 1, n)


def duration(seconds: Column) -> Column:
    """12.3s, 4.5min or 1.2h; a half that binary holds exactly (a quarter) goes to the even digit."""
    one = lambda x, unit: F.format_string(f"%.1f{unit}", F.when(x * 4 % 1 == 0, F.bround(x, 1)).otherwise(x))
    return F.when(seconds < 60, one(seconds, "s")).when(seconds < 3600, one(seconds / 60, "min")).otherwise(one(seconds / 3600, "h"))
