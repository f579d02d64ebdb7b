"""Reading input tables and checking the columns an operator needs.

Parquet is the input format. Schemas come from the files; an operator names the
columns it needs and ``require_columns`` fails fast (driver side, no job) when
one is missing, instead of failing deep inside a plan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``<base_dir>/<name>.parquet`` (file or folder) with the schema that it has now."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def reject_reserved(cols, reserved, where: str = "input") -> None:
    """Fail early when an argument column is named like a column the operator adds."""
    clash = sorted({c for c in cols if c is not None and c.lower() in {r.lower() for r in reserved}})
    if clash:
        raise ValueError(f"{where}: column name(s) {clash} are used for output columns; rename them first")


def require_columns(df: DataFrame, *cols: str, where: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{where} lacks required column(s) {missing}; has {df.columns}")


def named_inputs(df: DataFrame, *args: str | Column, where: str = "input") -> tuple[DataFrame, list[str]]:
    """``(df of just the arguments, their names)`` for arguments given as column names or as expressions.

    An expression is named as Spark names it (its alias, or its text). Two
    arguments of one name (letter case aside) are refused, unless they are the
    same named column.
    """
    require_columns(df, *[a for a in args if isinstance(a, str)], where=where)
    picked = [df.select(F.col(f"`{a}`") if isinstance(a, str) else a) for a in args]
    names = [p.columns[0] for p in picked]
    if any(len(p.columns) != 1 for p in picked):
        raise ValueError(f"{where}: an argument stands for several columns")
    if odd := [n for n in names if "." in n or "`" in n]:
        raise ValueError(f"{where}: give the argument(s) {odd} an alias without dots")
    wanted: dict[str, tuple[str, str | Column]] = {}
    for name, a in zip(names, args):
        known = wanted.setdefault(name.lower(), (name, a))[1]
        if known is not a and not (isinstance(known, str) and isinstance(a, str)):
            raise ValueError(f"{where}: two arguments are named {name!r}; give one of them another alias")
    return df.select(*[F.col(f"`{a}`") if isinstance(a, str) else a.alias(n) for n, a in wanted.values()]), names


def is_numeric(df: DataFrame, col: str) -> bool:
    """Numeric columns get statistics, everything else is categorical (schema only, no job)."""
    return isinstance(df.schema[col].dataType, NumericType)
