"""Removal of lines that many documents share, by DataFrame operations only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased. Keys of at least 40 code points in at least 5 documents lose all
their lines, except those in the largest doc_id that holds the key.

Every long line is reduced to a hash, its document and position, written once to
the shared folder. The hashes are range-partitioned together with the document,
so that a key of a third of all rows spreads over many tasks, and sorted within;
equal pairs of a key and a document meet there, and each task passes one count
and one largest document per key on. Only the keys found in enough documents are
joined back, and become per-document bitmaps of the lines to drop, packed into
those 64-bit words that aren't zero. Text is never part of a shuffle by key.

Rows of one doc_id count as one document when documents are counted; each of
them is cleaned by the same keys. Null or empty text is one empty line. Rows
whose doc_id is null are never counted as documents nor cleaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrellis.llm.session import table

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
#: The white space stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """A line's 128-bit hash as two longs, or null if its key is too short to count."""
    bare = F.btrim(line, F.lit(BLANKS))
    folded = F.translate(bare, _UPPER, _LOWER)
    return F.when(F.char_length(bare) >= LEAST_LENGTH, F.struct(F.xxhash64(folded).alias("a"), F.xxhash64(F.lit("second"), F.reverse(folded)).alias("b")))


def long_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the whole text), a, b (the key) and position of every line with a key."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.transform(lines(F.col("text")), key)).alias("position", "k"))
    return keyed.where(F.col("k").isNotNull()).select("doc_id", "version", "k.a", "k.b", "position")


def shared_keys(held: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The keys of at least so many documents: a, b, keeper (the largest doc_id that holds one)."""
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("a", "b", "doc_id").repartitionByRange(n, "a", "b", "doc_id").sortWithinPartitions("a", "b", "doc_id")
    once = dealt.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least).select("a", "b", "keeper")


def bitmaps(held: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, version and dropped of every text that loses lines.

    dropped maps the number of a 64-line word to its bits; words without a line to drop are left out.
    """
    lost = held.join(table(shared_keys(held, least), "shared-keys"), ["a", "b"]).where(F.col("doc_id") < F.col("keeper"))
    places = lost.groupBy("doc_id", "version").agg(F.collect_set("position").alias("places"))

    def word(w: Column) -> Column:
        bits = F.filter("places", lambda p: F.shiftright(p, 6) == w)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)))))

    words = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.shiftright(p, 6))))
    return places.select("doc_id", "version", F.map_from_arrays(words, F.transform(words, word)).alias("dropped"))


def _is_dropped(dropped: Column, position: Column) -> Column:
    bits = F.coalesce(F.try_element_at(dropped, F.shiftright(position, 6)), F.lit(0).cast("long"))
    return F.call_function("shiftright", bits, F.pmod(position, F.lit(64))).bitwiseAND(F.lit(1).cast("long")) == 1


def with_kept(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Columns row (struct of docs' columns), kept (array of lines, null if all are kept) and dropped (the bitmap or null)."""
    maps = bitmaps(table(long_lines(docs), "long-lines"), least)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_version"))
    joined = packed.join(maps.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "dropped"), ["_doc", "_version"], "left")
    kept = F.when(F.col("dropped").isNotNull(), F.filter(lines(F.col("row.text")), lambda _, i: ~_is_dropped(F.col("dropped"), i)))
    return joined.select("row", kept.alias("kept"), "dropped")


def report(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 and the bitmap of the dropped lines, for each row."""
    out = with_kept(docs.select("doc_id", "text"), least)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(F.array_join("kept", "\n"), text).cast("binary"), 256).alias("kept_sha256"),
        "dropped",
    )


def clean(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with the kept lines as text (and n_chars to match where a text changed); other columns as they were."""
    out = with_kept(docs, least)
    text = F.array_join("kept", "\n")
    new = {"text": F.coalesce(text, F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length(text).cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
