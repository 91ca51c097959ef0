"""Pages from dumps of a wiki's responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "struct<data:struct<pages:struct<list:array<struct<id:bigint,path:string,title:string,tags:array<string>,locale:string>>>>>"
SINGLE = "struct<data:struct<pages:struct<single:struct<content:string,tags:array<struct<tag:string>>>>>>"


def page_list(responses: DataFrame, json: str = "json", locale: str = "ko") -> DataFrame:
    """One row a listed page of this locale; a page that doesn't say is taken to be of it. A response that isn't JSON or lacks a level gives none."""
    pages = F.explode(F.from_json(json, LIST)["data"]["pages"]["list"]).alias("page")
    listed = responses.select(pages).where(F.col("page.locale").isNull() | (F.col("page.locale") == locale))
    return listed.select(F.col("page.id").alias("page_id"), "page.path", "page.title", "page.tags", F.lit(locale).alias("locale"))


def page_content(json: Column) -> Column:
    """The body in a single page's response; missing or damaged, it is empty."""
    return F.coalesce(F.from_json(json, SINGLE)["data"]["pages"]["single"]["content"], F.lit(""))


def page_tags(json: Column) -> Column:
    return F.from_json(json, SINGLE)["data"]["pages"]["single"]["tags"]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Dump files with one response a line."""
    return spark.read.text(path).withColumnRenamed("value", "json")
