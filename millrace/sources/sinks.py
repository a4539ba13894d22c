"""Sinks: snapshots, SQL text, sitemap files and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replaces a table by its next state. ``df`` must not read from ``path``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def sql_literal(column: Column) -> Column:
    text = F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(column.isNull(), "NULL").otherwise(text)


def insert_statements(df: DataFrame, table: str, order: list[str], per_statement: int = 50, buckets: int = 16) -> DataFrame:
    """INSERT statements of up to ``per_statement`` rows for a database that takes text; made in buckets side by side."""
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "short", "float")}
    values = F.concat(F.lit("("), F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) if c in numbers else sql_literal(F.col(c)) for c in df.columns)), F.lit(")"))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    rows = df.withColumn("bucket", bucket).withColumn("values", values).withColumn("place", place).withColumn("n", F.floor(F.col("place") / per_statement))
    head = F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "values"))), lambda x: x["values"]), ", ")
    return rows.groupBy("bucket", "n").agg(F.concat(head, listed, F.lit(";")).alias("statement")).select("statement")


def sitemap_xml(urls: DataFrame, base: str) -> DataFrame:
    """One XML text for each file: ``kind``, ``file``, ``xml``; a file holds at most 45,000 URLs. urls: kind, file, path, lastmod."""
    escaped = F.concat(F.lit(base), F.col("path"))
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        escaped = F.replace(escaped, F.lit(character), F.lit(entity))
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>"), F.substring("lastmod", 1, 10), F.lit("</lastmod></url>"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), "")
    return urls.groupBy("kind", "file").agg(F.concat(head, body, F.lit("</urlset>")).alias("xml"))


def markdown_table(df: DataFrame, order: list, most: int = 200) -> str:
    """A report's table of at most ``most`` rows."""
    rows = df.orderBy(*order).limit(most).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
