"""Text files in, pages out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .page import Page


def read_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text): whole files, decoded."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", encoding).alias("text"))


def write_page(
    blocks: DataFrame, html: str, order: str | list[str], path: str, css: tuple[str, ...] = (), pre: bool = True, overwrite: bool = True
) -> None:
    """A web page of the blocks in order, as files in the folder ``path`` that follow one another by name.

    Blocks are dealt out by ranges of ``order``, so a large page is written by many tasks; the page is its parts
    end to end. Blocks that are equal in ``order`` follow by their text, so a rerun writes the same page. A
    job that fails leaves no part of a page, and the page that was there before (see ``sources/page.py``).
    """
    spark = blocks.sparkSession
    spark.dataSource.register(Page)
    head = ["<!DOCTYPE html>", "<html>", *(["<style>", *css, "</style>"] if css else []), "<body>", *(["<pre>"] if pre else [])]
    tail = [*(["</pre>"] if pre else []), "</body>", "</html>"]
    keys = [order] if isinstance(order, str) else order
    body = blocks.select(F.lit(1).alias("part"), F.lit(0).alias("at"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keys)], F.col(html).alias("value"))
    edges = spark.createDataFrame([(0, k, t) for k, t in enumerate(head)] + [(2, k, t) for k, t in enumerate(tail)], "part int, at int, value string")
    page = body.unionByName(edges, allowMissingColumns=True)
    by = [c for c in page.columns if c != "value"]
    lines = page.repartitionByRange(*by).sortWithinPartitions(*by, "value").select("value")
    lines.write.format("page").mode("overwrite" if overwrite else "append").save(path)
