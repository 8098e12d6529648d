"""Writers of results, graphs, table dumps and id lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.notes import encoded


def write_csv(df: DataFrame, path: str) -> None:
    encoded(df).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type, and edges, as JSON lines."""
    nodes.write.partitionBy("type").mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def python_cleaner(clean: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Python string function as an Arrow-batched column function; nulls stay null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(clean, na_action="ignore")

    return run


def cleaned(df: DataFrame, clean: Callable[[Column], Column] | None) -> DataFrame:
    """The rows with the cleaner applied to every string column."""
    if clean is None:
        return df
    return df.select(*[clean(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def dump(tables: dict[str, DataFrame], path: str, clean: Callable[[Column], Column] | None = None) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        cleaned(df, clean).write.mode("overwrite").json(f"{path}/{name}")


def write_ids(ids: DataFrame, path: str, start: str, end: str, field: str, column: str = "arxiv_id") -> str:
    """Processed ids, one a line, in a folder named by date window and field."""
    target = f"{path}/start={start}/end={end}/field={field}"
    ids.select(F.col(column).cast("string")).write.mode("overwrite").text(target)
    return target
