"""Small frames with every awkward case: nulls in any column, empty and very
long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000)) + "\nlast line of the long text"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.\nA second line follows here.", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank.\nA second line follows here.", "en", "b", 1),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss.\n\n  \nZweite Zeile.", "de", "a", 1),
    (4, None, "en", "a", None),
    (5, "", "en", None, 0),
    (6, " \n\t ", None, "a", 3),
    (7, "12345 67890 !!! ???", "en", "a", 1),
    (None, "A text without an id stays what it is.\nA second line follows here.", "en", "a", 1),
    (8, LONG, "en", "a", 1),
    (9, LONG + " and a bit more", None, "a", 1),
    (10, "a", "en", "a", 1),
    (10, "a", "en", "a", 1),
    (10, "other text under the same id", "en", "a", 1),
    (11, "日本語のテキストです。空白がありません。\x00 emoji 👍🏽 ▁ \ud7ff", "ja", "a", 1),
]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(spark: SparkSession) -> DataFrame:
    """The same rows with columns named like the operators' own."""
    df = awkward(spark)
    for name in ("key", "id", "a", "b", "row", "fp", "version", "label", "ids", "decoded", "gone", "of", "line", "component", "item", "score"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else [
        (1, 1, 0), (2, 1, 0), (3, 1, None), (4, 0, 0), (5, 0, 1), (7, 0, 1), (7, 1, 1), (None, 1, 1), (8, None, 0), (99, 1, 1), (10, 2, 0),
    ], "doc_id long, quality int, toxic int")


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")
