"""Carrying a caller's columns, whatever their names, past an operator's own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct named row; select("row.*") brings them back in order."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores after it while df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
