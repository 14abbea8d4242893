"""Column names that an input doesn't have."""

from pyspark.sql import DataFrame


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the frame is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
