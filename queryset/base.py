"""Inputs and scratch places of the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tableops.operators.tables import quoted
from tableops.session import delete_path, shared_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session_name(spark: SparkSession) -> str:
    return re.sub(r"\W", "_", spark.sparkContext.applicationId).lower()


def fresh_path(spark: SparkSession, query: str) -> str:
    """A folder for the files of one query; an earlier run's are removed."""
    path = f"{shared_dir(spark)}/tableops_{_session_name(spark)}/{query}"
    delete_path(spark, path)
    return path


def fresh_db(spark: SparkSession, query: str) -> str:
    """An empty database for the tables of one query, in the shared folder."""
    name = f"{query}_{_session_name(spark)}"
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(name)} CASCADE")
    location = fresh_path(spark, f"{query}_db")
    spark.sql(f"CREATE DATABASE {quoted(name)} LOCATION '{location}'")
    return name
