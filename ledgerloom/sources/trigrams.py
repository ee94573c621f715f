"""P3-P5 by an inverted index: which rows can contain a search term.

Substring search ("contains", without regard to case and accents) has to look at every
text. The index holds for every three-character piece (gram) of the searched columns
the keys of the rows that have it:

* ``postings`` (gram, key), rebalanced and sorted by gram, so a gram is a few row
  groups found by their statistics, and a gram that a third of all rows share is
  spread over many files;
* ``counts`` (gram, rows), to read the rarest grams of a term first.

Two padding characters end each text, so a term of one or two characters is a range
of grams. The index only names candidates; the search predicate itself then decides,
so results equal the scan's for terms of any length. Grams are lower-case ASCII: a
text with any other character, or with a control character (which the collation
ignores), has no grams but is always a candidate, and pieces of a term with such
characters are not looked up; a term with no other piece is not looked up at all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import search_predicate
from ledgerloom.sources.keyed import KeyedTable

PAD = "\x01"
#: The gram of rows that are always candidates.
ALWAYS = ""
_PLAIN = r"\A[\t\n\x0b\f\r -~]*\z"
_PLAIN_CHAR = re.compile(r"[\t\n\x0b\f\r -~]+")
#: A further gram is read as well if its list is at most so many times the rarest one.
WORTH = 4


def postings(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(gram, key), each pair once per row: the padded texts of a row are laid end to
    end, and a gram is taken at its first place. A row with a text that is not plain
    has place 0 as well, for ``ALWAYS``."""
    lowered = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in columns]
    plain = [t.rlike(_PLAIN) for t in lowered]
    own = F.concat(*(F.when(ok & (F.length(t) > 0), F.concat(t, F.lit(PAD * 2))).otherwise("") for t, ok in zip(lowered, plain, strict=True)))
    first = F.when(reduce(lambda a, b: a & b, plain), 1).otherwise(0)
    texts = rows.select(F.col(key).alias("key"), own.alias("text"), first.alias("first")).where("first <= length(text)")
    placed = texts.select("key", "text", F.col("text").cast("binary").alias("bytes"), F.explode(F.expr("sequence(first, length(text))")).alias("at"))
    gram = F.when(F.col("at") == 0, ALWAYS).otherwise(F.substring("bytes", F.col("at"), F.lit(3)).cast("string"))  # ASCII: a character is a byte
    grams = placed.select(gram.alias("gram"), "key", "text", "at")
    return grams.where((F.col("at") == 0) | (~F.startswith("gram", F.lit(PAD)) & (F.instr(F.col("text"), F.col("gram")) == F.col("at")))).select("gram", "key")


def _order() -> Column:
    """A gram as a number of the same order, which sorts faster than text."""
    one, two, three = (F.ascii(F.substring("gram", k, 1)) for k in (1, 2, 3))
    return F.shiftleft(one, 14) + F.shiftleft(two, 7) + three


@dataclass(frozen=True)
class Lookup:
    """Candidate keys of a term, the grams that were read, and how many postings."""

    keys: DataFrame
    grams: list[str]
    postings: int


@dataclass(frozen=True)
class TrigramIndex:
    path: str
    key: str
    columns: tuple[str, ...]

    def build(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """Index a table; ``mode="append"`` adds rows that it has not had before."""
        found = postings(rows, self.key, self.columns).hint("rebalance", "gram")  # by ranges, all grams would be made a second time, for the sample
        found.sortWithinPartitions(_order()).write.mode(mode).parquet(f"{self.path}/postings")
        counts = rows.sparkSession.read.parquet(f"{self.path}/postings").groupBy("gram").count()
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts")

    def add(self, rows: DataFrame) -> None:
        self.build(rows, "append")

    def pieces(self, term: str) -> list[str]:
        """The grams of a term that a matching plain text must have."""
        parts = _PLAIN_CHAR.findall(term.strip().lower())
        return sorted({p[i:i + 3] for p in parts for i in range(len(p) - 2)})

    def lookup(self, spark: SparkSession, term: str) -> Lookup | None:
        """Candidates of a term; None if the index cannot narrow it down."""
        postings, counts = (spark.read.parquet(f"{self.path}/{name}") for name in ("postings", "counts"))
        term = term.strip().lower()
        pieces = self.pieces(term)
        if not pieces:
            if not 0 < len(term) < 3 or not _PLAIN_CHAR.fullmatch(term):
                return None
            found = counts.where(F.col("gram").startswith(term)).agg(F.sum("count")).first()[0]
            return Lookup(postings.where(F.col("gram").startswith(term) | (F.col("gram") == ALWAYS)).select("key").distinct(), [term], found or 0)
        known = {r.gram: r["count"] for r in counts.where(F.col("gram").isin([*pieces, ALWAYS])).collect()}
        always = postings.where(F.col("gram") == ALWAYS).select("key")
        lists = sorted((known.get(g, 0), g) for g in pieces)
        if not lists[0][0]:
            return Lookup(always.distinct(), [], known.get(ALWAYS, 0))
        few = [g for n, g in lists if n <= WORTH * lists[0][0]]
        own = postings.where(F.col("gram").isin(few)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(few)).select("key")
        return Lookup(own.unionByName(always).distinct(), few, sum(known[g] for g in few) + known.get(ALWAYS, 0))


def indexed_search(table: KeyedTable, index: TrigramIndex, spark: SparkSession, term: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of a table, keyed by the index's key, whose columns contain the term: the
    candidates' buckets are read, and the predicate decides on each candidate."""
    wanted = search_predicate(columns or index.columns, term)
    found = index.lookup(spark, term) if wanted is not None else None
    if found is None:
        rows = table.read(spark)
        return rows if wanted is None else rows.where(wanted)
    keys = found.keys.withColumnRenamed("key", index.key)
    return table.near(spark, table.touched(keys)).join(keys, index.key, "left_semi").where(wanted)
