"""Views that feed the texture operators from the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Width of the surface that ``events`` is read as; not a multiple of 4, so that edge blocks clamp.
WIDTH = 50

PX_EVENTS = f"""SELECT event_id % {WIDTH} AS x, event_id // {WIDTH} AS y, CAST(floor(value) AS BIGINT) % 256 AS r,
  user_id % 256 AS g, (event_id * 37 + 11) % 251 AS b, CASE WHEN event_type = 'error' THEN 128 ELSE 255 END AS a FROM events"""
BLK_LINEITEM = """SELECT l_partkey * 31 % 65536 AS c0, l_suppkey * 977 % 65536 AS c1, l_orderkey * 2654435761 % 4294967296 AS idx FROM lineitem"""
BLK_ALPHA = """SELECT CAST(l_quantity AS BIGINT) * 5 % 256 AS a0, CAST(round(l_discount * 100) AS BIGINT) * 23 % 256 AS a1,
  (l_orderkey * 2654435761 % 16777216) * 16777216 + l_partkey * 40503 % 16777216 AS idx FROM lineitem"""
TEX_PART = """SELECT p_partkey AS tex, CAST(p_size AS BIGINT) * 4 + p_partkey % 7 + 1 AS width, CAST(p_size AS BIGINT) * 8 + 1 AS height,
  1 + p_partkey % 6 AS mips, p_partkey % 10 AS content_id FROM part"""
WORLD_PART = """SELECT p_partkey AS tex, (p_partkey * 7919 % 600) - 300 AS x, (p_partkey * 104729 % 600) - 300 AS z, 1 + p_partkey % 6 AS mips FROM part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The view's columns over the table it names last; ``//`` is Spark's ``div``."""
    head, source = sql.replace("//", "div").rsplit(" FROM ", 1)
    columns = head.split("SELECT ", 1)[1]
    depth, parts, start = 0, [], 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(columns[start:i])
            start = i + 1
    parts.append(columns[start:])
    return table(spark, sf_dir, source.strip()).selectExpr(*[p.strip() for p in parts])


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", PX_EVENTS)


def blk_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", BLK_LINEITEM)


def blk_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", BLK_ALPHA)


def tex_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", TEX_PART)


def world_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", WORLD_PART)
