"""Scans of the given Parquet tables with fixed, explicit schemas.

Reading with a declared ``StructType`` skips schema inference and lets
Catalyst prune columns and push filters into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "region": _struct(("r_regionkey", _I), ("r_name", _S)),
    "nation": _struct(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _struct(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _struct(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _struct(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _struct(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _struct(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _struct(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "conversations": _struct(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "documents": _struct(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "labels": _struct(("doc_id", _L), ("quality", _I), ("toxic", _I)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one given table with its fixed schema."""
    schema = SOURCE_SCHEMAS.get(name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def load_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file stream.

    A folder that holds ``<name>.parquet`` as a file is filtered to that file;
    a folder ``<name>/`` (part files, e.g. landing in batches) is read whole.
    """
    import os
    reader = spark.readStream.schema(SOURCE_SCHEMAS[name])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    folder = f"{sf_dir.rstrip('/')}/{name}"
    if os.path.isdir(folder):
        return reader.parquet(folder)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
