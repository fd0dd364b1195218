"""Compiling derivation trees to Columns.

A derivation is JSON: {"operation": ..., "a": ..., "b": ...} with numbers, {"column": name} or nested trees as leaves. It is
compiled once, when the plan is built, so Catalyst folds its constants and generates code for the rest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded

OPERATIONS = ("add", "subtract", "multiply", "divide", "percent_of", "percent_change", "average")


class DerivationError(ValueError):
    pass


def compile_tree(tree: dict | float | str, round_results: bool = False) -> Column:
    """Column of a tree; a zero divisor gives null."""
    if isinstance(tree, str):
        tree = json.loads(tree)
    if isinstance(tree, bool) or not isinstance(tree, dict | int | float):
        raise DerivationError(f"not a derivation: {tree!r}")
    if isinstance(tree, int | float):
        return F.lit(float(tree))
    if "column" in tree:
        return F.col(tree["column"]).cast("double")
    if tree.get("operation") not in OPERATIONS or "a" not in tree or "b" not in tree:
        raise DerivationError(f"unknown operation or missing operand: {tree!r}")
    a, b = compile_tree(tree["a"], round_results), compile_tree(tree["b"], round_results)
    out, decimals = {
        "add": (a + b, None), "subtract": (a - b, None), "multiply": (a * b, None), "average": ((a + b) / 2, None), "divide": (F.try_divide(a, b), 2),
        "percent_of": (F.try_divide(a, b) * 100, 1), "percent_change": (F.try_divide(a - b, F.abs(b)) * 100, 1),
    }[tree["operation"]]
    return rounded(out, decimals) if round_results and decimals is not None else out


def leaves(tree: dict | float) -> list[str]:
    """Columns that a tree reads, in order."""
    if not isinstance(tree, dict):
        return []
    return [tree["column"]] if "column" in tree else leaves(tree["a"]) + leaves(tree["b"])


def corner_spread(df: DataFrame, tree: dict, half_units: dict[str, float]) -> DataFrame:
    """Adds low and high: the least and greatest result when every leaf is moved by plus or minus its half unit.

    The 2^n corners of a tree of n leaves are columns of one row, so nothing is exploded.
    """
    names = list(dict.fromkeys(leaves(tree)))

    def moved(node, bits: int):
        if not isinstance(node, dict):
            return node
        if "column" in node:
            sign = 1 if bits >> names.index(node["column"]) & 1 else -1
            return {"operation": "add", "a": node, "b": sign * half_units[node["column"]]}
        return node | {"a": moved(node["a"], bits), "b": moved(node["b"], bits)}

    corners = [compile_tree(moved(tree, bits)) for bits in range(2 ** len(names))]
    corners = corners * 2 if len(corners) == 1 else corners
    return df.withColumns({"low": F.least(*corners), "high": F.greatest(*corners)})
