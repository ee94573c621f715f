"""Batch sinks: nested JSON documents.

Outputs are written by Spark in parallel (one file per partition); nothing
is funnelled through the driver or a single task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_json_documents(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row (arrays of structs stay nested)."""
    nested.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_long_documents(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str, path: str, mode: str = "overwrite") -> None:
    """S7 for documents of any length: one JSON document per parent and line, with its
    children as the array ``name``, in ``order``.

    No document is ever held whole: its head, its children and its end are rows of
    their own, sorted by (key, order), and the text writer puts them one after the
    other; a task holds a row at a time, and its sort spills. ``key`` is unique among
    the parents and a column of both; a parent without children has an empty array,
    children without a parent and rows with a null key are left out."""
    whole = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(*parents.columns), whole)
    heads = parents.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(f",{json.dumps(name)}:[")).alias("_text"))
    own = [c for c in children.columns if c != key]
    rank = F.struct(*order)
    lines = (children.join(parents.select(key), key, "left_semi")
             .select(F.col(key).alias("_key"), rank.alias("_order"), F.to_json(F.struct(*own), whole).alias("_text")))
    kind = lines.schema["_order"].dataType
    none = F.lit(None).cast(kind)
    rows = (heads.select("_key", F.lit(0).alias("_kind"), none.alias("_order"), "_text")
            .unionByName(lines.withColumn("_kind", F.lit(1)))
            .unionByName(heads.select("_key", F.lit(2).alias("_kind"), none.alias("_order"), F.lit("]}\n").alias("_text"))))
    before = F.lag("_kind").over(Window.partitionBy("_key").orderBy("_kind", "_order"))
    rows = rows.withColumn("_comma", F.when((F.col("_kind") == 1) & (before == 1), ",").otherwise(""))
    # rows are parted by a space, which JSON allows between tokens; documents end their line themselves
    rows.select(F.concat("_comma", "_text").alias("value")).write.mode(mode).option("lineSep", " ").text(path)
