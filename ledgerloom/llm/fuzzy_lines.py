"""Line dedup by MinHash, with DataFrame functions only.

Lines of a text (blank ones apart) are compared over the whole corpus. A line's
shingles are its runs of ``SHINGLE`` characters (a shorter line is one shingle).

1. Signatures: MinHash over all shingles of every line, the set that is
   verified later, by one hash under ``ROWS * BANDS`` bit flips, which are
   permutations.
2. Banding: ``BANDS`` bands of ``ROWS`` minima. Of 2,000 pairs of similarity 0.80
   to 0.82, 0.9975 shared a band (1 - (1 - 0.8^3)^8 = 0.997).
   Four bits of ``SKETCH`` minima travel along; a pair that agrees in fewer than
   ``AGREE`` of them is given up (none of those pairs agreed in fewer than 13).
3. In a band's bucket every line meets the bucket's pivot, the line with most
   copies (variants are near their original), by an equi-join with an aggregate. Pairs are verified by the exact Jaccard of all their shingles.
   Lines of one bucket that are still in different components then meet each
   other, so no link between different lines of a bucket is lost, and lines
   that are linked already are never paired. Only pairs whose folds differ in
   few enough bits are verified; a fold bounds the shingles in which two sets
   differ from below, so this loses no pair.
4. Distributed union-find over the verified links; of each component, and of
   all exact copies of a line, the first occurrence (document, then line
   number) stays.

Lines are known by 128 bits of hash, so copies fold before anything is paired;
text is fetched only for the lines of shared buckets, behind a bounded bit table.

Defined results: null text stays null, empty text stays empty; blank lines are
always kept; rows with a null id keep their lines and are nobody's first
occurrence; rows equal in id and text are one document; an empty table gives
an empty result; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import written

SHINGLE = 10
SIMILARITY = 0.8
#: Minima of a band, and bands. Three minima: unrelated lines seldom share a band.
ROWS, BANDS = 3, 8
#: Minima of the sketch, and how many of them a pair must agree in.
SKETCH, AGREE = 24, 11
_WORDS = 1 << 16
#: Words of 64 bits of a fold. With 32, pairs of 500 shingles below 0.77 are ruled out, of 2,000 below 0.7.
FOLD = 32


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, version, pos, line, a, b): lines that take part; a and b identify the line."""
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "").select(
        "*", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _units(line: Column) -> Column:
    """UTF-16 code units, two bytes each: fixed width, so any shingle is one slice."""
    return F.encode(line, "UTF-16BE")


def _flips() -> list[int]:
    """Bit flips of the permutations, over all 32 bits, as signed integers:
    multiples of an odd constant."""
    bits = [(k * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF for k in range(max(SKETCH, ROWS * BANDS))]
    return [c - (c >> 31 << 32) for c in bits]


def signatures(lines: DataFrame) -> DataFrame:
    """(a, b, weight, s1, s2, band keys k0...) of every distinct line; weight
    grows with its copies, s1 and s2 are its sketch."""
    units = lines.select("a", "b", _units(F.col("line")).alias("units"))
    at = units.select("a", "b", "units", F.explode(F.expr(_starts("units"))).alias("p"))
    least = at.select("a", "b", "p", F.hash(F.expr(_shingle("units", "p"))).alias("h")).groupBy("a", "b").agg(
        F.count_if(F.col("p") == 1).alias("copies"), *(F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(_flips())))
    half = SKETCH // 2
    sketch = [F.lit(0).cast("long")] * 2
    for k in range(SKETCH):
        sketch[k // half] = sketch[k // half].bitwiseOR(F.shiftleft(F.hash(f"m{k}").bitwiseAND(F.lit(15)).cast("long"), 4 * (k % half)))
    weight = F.shiftleft(F.least("copies", F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)))
    return least.select("a", "b", weight.alias("weight"), sketch[0].alias("s1"), sketch[1].alias("s2"), *(
        F.xxhash64(F.lit(k), *(f"m{j}" for j in range(ROWS * k, ROWS * k + ROWS))).alias(f"k{k}") for k in range(BANDS)))


def _differing(one: str, two: str) -> Column:
    """In how many places two halves of a sketch differ."""
    x = F.col(one).bitwiseXOR(F.col(two))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))


def _agree() -> Column:
    return SKETCH - _differing("s1", "ps1") - _differing("s2", "ps2") >= AGREE


def _starts(line: str) -> str:
    """The bytes at which a shingle starts, from 1."""
    return f"sequence(1, greatest(length({line}) - {2 * SHINGLE - 1}, 1), 2)"


def _shingle(line: str, start: str) -> str:
    return f"substring({line}, {start}, {2 * SHINGLE})"


def _shingles(line: str) -> str:
    """The shingle set of a line, as hashes. The outer lambda holds the bytes of
    the line; a column named inside the inner one would be copied for each shingle."""
    each = f"transform({_starts('u')}, p -> xxhash64({_shingle('u', 'p')}))"
    return f"array_distinct(transform(array({line}), u -> {each})[0])"


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, pa, pb) whose shingle sets have at least the
    similarity, as edges (x, y) of line names. The sizes pass a generator: a
    filter on plain columns would be moved into the join, where the sets are made
    anew for each mention."""
    other = texts.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("units").alias("pivot"))
    sets = pairs.join(texts, ["a", "b"]).join(other, ["pa", "pb"]).select(
        "a", "b", "pa", "pb", F.expr(_shingles("units")).alias("s"), F.expr(_shingles("pivot")).alias("t"))
    sizes = F.struct(F.size(F.array_intersect("s", "t")).alias("both"), (F.size("s") + F.size("t")).alias("total"))
    met = sets.select("a", "b", "pa", "pb", F.explode_outer(F.array(sizes)).alias("sizes")).select("*", "sizes.*")
    return met.where(F.col("both") >= SIMILARITY * (F.col("total") - F.col("both"))).select(
        _name("a", "b").alias("x"), _name("pa", "pb").alias("y"))


def _name(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _texts(lines: DataFrame, concerned: DataFrame) -> DataFrame:
    """(a, b, units) of the lines concerned. A bit table of fixed size turns
    away most other lines before the join; the join decides."""
    spark = lines.sparkSession
    bits = concerned.groupBy(F.expr(f"(a >> 6) & {_WORDS - 1}").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(a & 63 as int))")).alias("bits")).collect()  # _WORDS rows at most
    table = [0] * _WORDS
    for r in bits:
        table[r.word] = r.bits
    table = spark.createDataFrame([(table,)], "bits array<long>")
    inside = F.getbit(F.element_at(table.scalar(), F.expr(f"cast((a >> 6) & {_WORDS - 1} as int) + 1")), F.expr("a & 63")) == 1
    few = lines.where(inside).select("a", "b", _units(F.col("line")).alias("units"))
    return few.join(concerned, ["a", "b"], "left_semi").dropDuplicates(["a", "b"])


def folded(texts: DataFrame) -> DataFrame:
    """(a, b, size, f0...): the size of every line's shingle set and its fold, in
    which each shingle of the set flips one of 64 * FOLD bits."""
    sets = texts.select("a", "b", F.expr(_shingles("units")).alias("s"))
    sets = sets.select("a", "b", F.explode_outer("s").alias("h"))  # not explode: it would make the sets once more, for a filter
    words = sets.groupBy("a", "b", F.expr(f"cast((h >> 6) & {FOLD - 1} as int)").alias("word")).agg(
        F.count("*").alias("size"), F.bit_xor(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    return words.groupBy("a", "b").agg(F.sum("size").alias("size"), *(
        F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"f{k}") for k in range(FOLD)))


def _reach() -> Column:
    """Whether two folded lines can have the similarity. A shingle of both sets
    flips the same bit of both folds, so the folds differ in no more bits than
    the sets in shingles: no pair that has the similarity is ruled out."""
    total = F.col("size") + F.col("psize")
    differing = sum((F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"pf{k}"))) for k in range(1, FOLD)),
                    F.bit_count(F.col("f0").bitwiseXOR(F.col("pf0"))))
    possible = lambda most: most >= SIMILARITY * (total - most)
    return possible(F.least("size", "psize")) & possible((total - differing) / 2)


def crossing(members: DataFrame) -> DataFrame:
    """(a, b, pa, pb) of the members (key, a, b, s1, s2, component, home, size, fold)
    that share a bucket, are in different components and can have the similarity.
    ``home`` tells who is in the component of the bucket's pivot: those never meet
    each other. Columns that cannot be null keep the condition small enough to
    be compiled."""
    solid = members.select("key", *(F.coalesce(c, F.lit(0).cast(members.schema[c].dataType)).alias(c)
                                    for c in members.columns if c != "key"))
    other = solid.withColumnsRenamed({c: f"p{c}" for c in solid.columns if c != "key"})
    ordered = (F.col("a") < F.col("pa")) | (F.col("a") == F.col("pa")) & (F.col("b") < F.col("pb"))
    met = solid.where("NOT home").join(other, "key").where(
        (F.col("component") != F.col("pcomponent")) & (F.col("phome") | ordered) & _agree() & _reach())
    one, two = F.struct("a", "b"), F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))
    met = met.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).distinct()
    return met.select("one.a", "one.b", F.col("two.a").alias("pa"), F.col("two.b").alias("pb"))


def similar_lines(lines: DataFrame) -> DataFrame:
    """(node, component) of the names of lines that are linked to another line."""
    signed = written(signatures(lines), "lines-signed")
    bands = signed.select("a", "b", F.explode(F.array(*(f"k{k}" for k in range(BANDS)))).alias("key"))
    several = written(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lines-keys")
    met = bands.join(several, "key").join(signed.select("a", "b", "weight", "s1", "s2"), ["a", "b"])
    met = written(met, "lines-met")  # what follows concerns the lines of shared buckets only
    pivots = written(met.groupBy("key").agg(*(F.max_by(c, "weight").alias(f"p{c}") for c in ("a", "b", "s1", "s2"))), "lines-pivots")
    met = met.join(pivots, "key")
    texts = written(_texts(lines, met.select("a", "b").distinct()), "lines-texts")
    star = met.where("a <> pa OR b <> pb").where(_agree()).select("a", "b", "pa", "pb").distinct()
    star = written(star, "lines-star")
    edges = written(verified(star, texts), "lines-edges")
    label = written(components(edges, "x", "y"), "lines-components")
    # buckets that hold several components still
    member = met.where("n > 2").select("key", "a", "b", "s1", "s2", _name("a", "b").alias("node")).join(label, "node", "left").select(
        "key", "a", "b", "s1", "s2", "node", F.coalesce("component", "node").alias("component"))
    member = written(member, "lines-members")
    mixed = written(member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .where("lo <> hi").select("key"), "lines-mixed")
    homes = pivots.join(mixed, "key", "left_semi").select("key", _name("pa", "pb").alias("node")).join(label, "node", "left").select(
        "key", F.coalesce("component", "node").alias("of"))
    left = member.join(homes, "key").select(
        "key", "a", "b", "s1", "s2", F.xxhash64("component").alias("component"), (F.col("component") == F.col("of")).alias("home"))
    folds = written(folded(texts.join(left.select("a", "b").distinct(), ["a", "b"], "left_semi")), "lines-folds")
    cross = written(crossing(written(left.join(folds, ["a", "b"]), "lines-mixed")), "lines-cross")
    more = written(verified(cross, texts), "lines-edges")
    if more.isEmpty():
        return label
    return components(label.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more), "x", "y")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, pos) of every line that is not its component's first occurrence."""
    lines = _lines(docs, key, text)
    label = written(similar_lines(lines), "lines-labels")
    placed = lines.select("id", "version", "pos", _name("a", "b").alias("node")).join(label, "node", "left").select(
        "id", "version", "pos", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "lines-placed")
    first = placed.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("id", "version", "pos")).alias("first"))
    first = written(first.where("n > 1").select("component", "first.*").withColumnsRenamed(
        {"id": "id1", "version": "version1", "pos": "pos1"}), "lines-first")
    return placed.join(first, "component").where("id <> id1 OR version <> version1 OR pos <> pos1").select("id", "version", "pos").distinct()


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """The rows of ``docs`` without their removed lines; with ``removed``, the
    numbers of those lines as a further column of that name. Rows travel as one
    struct, so no column name can clash."""
    gone = removed_lines(docs, key, text).groupBy("id", "version").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    gone = gone.select(F.struct("id", "version").alias("of"), "gone")
    of = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("version")))
    rows = docs.select(F.struct("*").alias("row"), of.alias("of")).join(gone, "of", "left")
    before = F.col("row").getField(text)
    rows = rows.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(before, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by hash, in order
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    rows = rows.withColumn("row", F.col("row").withField(text, F.when(F.col("gone").isNull(), before).otherwise(kept)))
    out = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if removed:
        out.append(F.coalesce("gone", F.array().cast("array<int>")).alias(removed))
    return rows.select(*out)
