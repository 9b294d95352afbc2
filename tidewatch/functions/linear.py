"""Small linear systems solved inside a row, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def solve_symmetric(df: DataFrame, a: list[list[str]], b: list[str], out: list[str]) -> DataFrame:
    """Add columns ``out`` that solve ``a x = b`` in every row.

    ``a[i][j]`` (``j <= i``) and ``b[i]`` name columns of a positive definite system;
    it is factored as L D L'. The steps are aliases in one projection that refer to the
    ones before them, so that no expression is held twice.
    """
    n, columns = len(b), df.columns

    def minus(first: str, *parts: str) -> str:
        return " - ".join([first, *parts])

    steps = []
    for j in range(n):
        steps.append(minus(a[j][j], *[f"_l{j}_{k}*_l{j}_{k}*_d{k}" for k in range(j)]) + f" AS _d{j}")
        steps += [f"({minus(a[i][j], *[f'_l{i}_{k}*_l{j}_{k}*_d{k}' for k in range(j)])}) / _d{j} AS _l{i}_{j}" for i in range(j + 1, n)]
    steps += [minus(b[i], *[f"_l{i}_{k}*_z{k}" for k in range(i)]) + f" AS _z{i}" for i in range(n)]
    steps += [minus(f"_z{i}/_d{i}", *[f"_l{k}_{i}*{out[k]}" for k in range(i + 1, n)]) + f" AS {out[i]}" for i in reversed(range(n))]
    return df.selectExpr("*", *steps).select(*columns, *out)
