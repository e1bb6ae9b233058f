"""Database tables, read in parallel ranges of a numeric key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    **properties: str,
) -> dict[str, str]:
    """Reader options; with a key and its bounds the table is read in ``partitions`` ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if key is not None:
        if bounds is None:
            raise ValueError("a partition key needs its lowest and highest value")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def bounds_query(table: str, key: str) -> str:
    """One row with the lowest and highest key, worked out by the database."""
    return f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}) AS bounds"


def range_predicates(key: str, cuts: list[str]) -> list[str]:
    """Conditions of a table's parts between cut points of a text key, such as its quantiles; every row meets exactly one."""
    quoted = ["'" + c.replace("'", "''") + "'" for c in sorted(set(cuts))]
    if not quoted:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(quoted, quoted[1:])]
    return [f"{key} < {quoted[0]} OR {key} IS NULL", *inner, f"{key} >= {quoted[-1]}"]


def read_ranges(spark: SparkSession, url: str, table: str, key: str, partitions: int = 64, **properties: str) -> DataFrame:
    """A whole table in ranges of a numeric key whose bounds the database is asked for."""
    low, high = read_table(spark, url, bounds_query(table, key), **properties).head()
    if low is None:
        return read_table(spark, url, table, **properties)
    return read_table(spark, url, table, key=key, bounds=(int(low), int(high)), partitions=partitions, **properties)


def read_parts(spark: SparkSession, url: str, table: str, key: str, cuts: list[str], **properties: str) -> DataFrame:
    """A whole table in ranges of a text key between given cut points."""
    return spark.read.jdbc(url, table, predicates=range_predicates(key, cuts), properties=properties)


def read_table(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """A whole table; filters and column choices made on the result reach the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()
