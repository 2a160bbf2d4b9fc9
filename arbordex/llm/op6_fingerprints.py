"""Operator 6, document fingerprints by winnowing, in DataFrame functions alone.

Words are runs without `[\\x20\\x09-\\x0D]`. Each K words in a row give a k-gram hash, and of each WINDOW k-grams in a row the one
with the smallest hash is kept, the rightmost of equals. A k-gram's hash is made anew from the hashes of its words, which are made
once: rolling would need a fold over the text, and DataFrame functions copy the whole array at each step of one. Kept marks carry their place, so two
texts that share any WINDOW + K - 1 words in a row share a mark. A text of fewer words than K is one k-gram; without words it
has no mark. A mark is one long: 39 bits of hash, then 24 bits that fall with the place (modulo 2**24 words).

Likeness is the Jaccard index of the sets of mark hashes; two texts without marks are alike (1.0). Null text is empty.
Order: ascending doc_id, a null doc_id after all others; rows that share a doc_id, or have none, are one place, whose next document
is the next place's (where several rows have that one, the one whose beginning sorts first). Each row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbordex.llm.tables import checkpointed, partitions, table

K = 4
WINDOW = 8
PLACES = (1 << 24) - 1


def words(text: Column) -> Column:
    """The words of a text; after the translation a single-character split needs no regular expression."""
    return F.array_remove(F.split(F.translate(text, "\t\n\u000b\f\r", "     "), " "), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def marks(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The winnowed marks of a text, in order of place."""

    def grams(hashes: Column) -> Column:
        def one(i: Column) -> Column:
            return F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]), 25), 24) + (F.lit(PLACES) - F.pmod(i, F.lit(PLACES + 1))).cast("long")

        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0))), one))

    def kept(values: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - (window - 1), F.lit(1))), lambda i: F.array_min(F.slice(values, i, window)))
        return F.when(F.size(values) == 0, values).otherwise(F.array_distinct(least))

    return let(let(F.transform(words(text), lambda w: F.xxhash64(w)), grams), kept)


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda m: F.shiftright(m, 24)))


def shown(found: Column) -> Column:
    """hash:place of each mark, comma-joined."""
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.shiftright(m, 24).cast("string"), (F.lit(PLACES) - m.bitwiseAND(F.lit(PLACES))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def predecessors(places: DataFrame) -> DataFrame:
    """(place, before, quarter): for each place the one before it (the last for the first), and how much of a text that one takes.

    places are dealt into ranges; only one row for each range meets in one place.
    """
    spark = places.sparkSession
    ranged = checkpointed(places.groupBy("place").agg(F.max("n").alias("n")).repartitionByRange(partitions(spark), "place").withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy("range").agg(F.max(F.struct("place", "n")).alias("last"))
    every = Window.partitionBy(F.lit(0))
    ends = ends.select("range", F.coalesce(F.lag("last").over(every.orderBy("range")), F.max("last").over(every)).alias("edge"))
    own = F.lag(F.struct("place", "n")).over(Window.partitionBy("range").orderBy("place"))
    found = ranged.withColumn("own", own).join(F.broadcast(ends), "range").select("place", F.coalesce("own", "edge").alias("p"))
    return found.select("place", F.col("p.place").alias("before"), F.floor(F.col("p.n") / 4).cast("int").alias("quarter"))


def compared(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    doc_id = df[key].cast("long")
    docs = df.select(F.struct(doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.lit(0)).alias("id")).alias("place"), F.coalesce(df[text], F.lit("")).alias("text"))
    before = predecessors(docs.select("place", F.char_length("text").alias("n")))
    following = docs.join(before, "place").select(F.col("before").alias("place"), F.expr("substring(text, 1, quarter)").alias("head"), hashes(marks(F.col("text"))).alias("next_hashes"))
    following = following.groupBy("place").agg(F.min(F.struct("head", "next_hashes")).alias("next"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = docs.join(following, "place").select("place", "text", n.alias("n"), F.col("next.next_hashes").alias("next_hashes"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.head", F.lit(1), quarter)).alias("edited"))
    marked = edited.select("place", "n", "next_hashes", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), marks(F.col("text")).alias("own"), marks(F.col("edited")).alias("changed"))
    sets = marked.select("*", hashes(F.col("own")).alias("own_hashes"), hashes(F.col("changed")).alias("changed_hashes"))
    return sets.select(
        F.when(~F.col("place.nameless"), F.col("place.id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("changed_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"), "doc_id", "text")
