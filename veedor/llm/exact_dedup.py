"""Exact dedup with two passes over hashes and a Bloom filter between them; DataFrame functions only.

Pass one counts how many rows hit each filter position (two positions a row) and packs the positions hit
twice or more into bitmaps.  A row can have a copy only if both its positions are among them.  Pass two
sends such rows, and no others, through a shuffle by their exact hash; the rest go straight to the result.
What pass one shuffles is the positions, two numbers of 31 bits a row (about 20 bytes with their framing, 5 MB for 256,410 rows),
summed by task: bitmaps of a task's own would be bits / 8 bytes each, which is more for any task of under bits / 128 rows.

The filter has 16 to 32 bits for each row, up to ``most_bits``; it is broadcast, so that many bits are its proven
bound.  With more rows than that it lets more rows into the shuffle, and the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Bits of the bitmaps that Spark's bitmap functions make.
PAGE = 32_768


def _position(sha: Column, which: int, bits: int) -> Column:
    """A position from 1 to bits, from 31 bits of the row's hash."""
    return F.shiftright(F.xxhash64(sha), 32 * which).bitwiseAND(F.lit(bits - 1)) + 1


def repeated(hashes: DataFrame, bits: int) -> DataFrame:
    """(page, bitmap): the positions that two rows or more hit; at most bits / 8 bytes."""
    both = hashes.select(F.explode(F.array(_position(F.col("sha"), 0, bits), _position(F.col("sha"), 1, bits))).alias("at"))
    twice = both.groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    page = F.call_function("bitmap_bucket_number", F.col("at")).alias("page")
    return twice.groupBy(page).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("at"))).alias("bitmap"))


def suspects(rows: DataFrame, filtered: DataFrame, bits: int) -> DataFrame:
    """rows with a boolean ``suspect``: whether the filter has both positions of the row."""
    hit = F.lit(True)
    for which in (0, 1):
        page, bitmap, at = f"_page{which}", f"_bitmap{which}", _position(F.col("sha"), which, bits)
        rows = rows.join(F.broadcast(filtered.toDF(page, bitmap)), F.call_function("bitmap_bucket_number", at) == F.col(page), "left")
        bit = F.call_function("bitmap_bit_position", at)
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.call_function("shiftright", F.coalesce(byte, F.lit(0)), (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.withColumn("suspect", hit).drop("_page0", "_page1", "_bitmap0", "_bitmap1")


def filter_bits(rows: int, most_bits: int) -> int:
    return min(most_bits, max(PAGE, 1 << (16 * max(rows, 1) - 1).bit_length()))


def text_hash(text_col: str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, 32 bytes; null as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 29) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The largest id of a group
    stays; rows that repeat it are the same document, and all of them are marked.  In a group with null ids
    only, null is the id that stays.
    """
    hashes = written(docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("sha")), "hashes")
    bits = filter_bits(hashes.count(), most_bits)
    marked = suspects(hashes, written(repeated(hashes, bits), "filter"), bits)
    alone = marked.where(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    maybe = marked.where("suspect").select("doc_id", "sha")
    # Written, so that both sides of the join come from shuffles of their own: only then does AQE split a group of very many copies.
    sizes = written(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    found = alone.unionByName(maybe.join(sizes, "sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 29) -> DataFrame:
    """The rows of docs that stay, all columns as they were; of rows with one id and one text, one.

    Null counts as empty; a null id stays only where its text has no other; long texts count whole; an empty table stays empty.
    """
    names = docs.columns
    hashes = written(docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("sha")), "hashes")
    bits = filter_bits(hashes.count(), most_bits)
    filtered = written(repeated(hashes, bits), "filter")
    best = suspects(hashes, filtered, bits).where("suspect").groupBy("sha").agg(F.max("doc_id").alias("_keep"))
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("_row"), F.col(id_col).alias("doc_id"), text_hash(text_col).alias("sha"))
    marked = suspects(rows, filtered, bits)
    best = best.withColumnRenamed("sha", "_sha")
    of_group = marked.where("suspect").join(best, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    kept = marked.where(~F.col("suspect")).select("_row").unionByName(of_group.dropDuplicates(["sha", "doc_id"]).select("_row"))
    return kept.select("_row.*")
