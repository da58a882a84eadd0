"""Lookup tables from small configuration texts (SRC-05). Configuration is
parsed on the driver -- it is a parameter file of fixed, small size -- and
becomes a broadcast DataFrame."""

from __future__ import annotations

import tomllib

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_toml_list(spark: SparkSession, text: str, key: str, schema: str = "pos int, label_id string") -> DataFrame:
    """A TOML list (``key = [...]``) as (position, value) rows."""
    values = tomllib.loads(text)[key]
    return F.broadcast(spark.createDataFrame(list(enumerate(values)), schema))


def from_yaml_pairs(spark: SparkSession, text: str, schema: str = "id string, translation string") -> DataFrame:
    """A YAML list of ``{id, translation}`` entries."""
    rows = [(e["id"], e.get("translation")) for e in yaml.safe_load(text)]
    return F.broadcast(spark.createDataFrame(rows, schema))
