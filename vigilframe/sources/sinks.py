"""Writers: list bundles, customers' sheets, text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import spreadsheet_safe


def write_bundle(entities: DataFrame, path: str, generated_at: str) -> DataFrame:
    """Entities as JSON lines in a folder for each list, sorted by id; returns the catalog rows that were written too.
    Lists without rows are refused before anything is written."""
    catalog = entities.groupBy(F.col("source_list").alias("id")).agg(F.max("list_version").alias("version"), F.count("*").alias("entitiesCount")).withColumn("fetchedAt", F.lit(generated_at)).orderBy("id")
    if catalog.isEmpty():
        raise ValueError("no list has entities")
    entities.repartition("source_list").sortWithinPartitions("source_list", "entity_id").write.mode("overwrite").partitionBy("source_list").json(f"{path}/entities")
    catalog.coalesce(1).write.mode("overwrite").json(f"{path}/catalog")
    return catalog


def write_frozen(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("compression", "gzip").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """id, vector as Parquet: the row tells the entity, no position does."""
    vectors.write.mode("overwrite").parquet(path)


def customers_sheet(customers: DataFrame) -> DataFrame:
    return customers.select(*[spreadsheet_safe(F.col(c).cast("string")).alias(c) for c in customers.columns])


def write_customers(customers: DataFrame, path: str) -> None:
    customers_sheet(customers).write.mode("overwrite").option("header", True).csv(path)


def text_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One line of fixed columns for each row."""
    return df.select(F.concat_ws("  ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]).alias("line"))
