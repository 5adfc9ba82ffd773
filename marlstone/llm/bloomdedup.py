"""Exact deduplication by two Bloom filter passes; DataFrame functions only.

Pass one writes a digest per row and counts how often each filter bit is hit;
bits hit twice or more form a second filter. Pass two tests every row against
it: a row of which some bit was hit once only is unique and passes straight
through; only the others ("possibly repeated") shuffle, and as digests. A group's
members are dealt out by digest and task, so no task gets a whole hot group.

``deduplicate`` then reads the texts again. Unique rows pass straight through. Of
the possibly repeated ones only those that a third filter, of the keys that stay,
lets through are shuffled to meet these keys: about one row a group, however many
copies it has. These joins are inner or outer joins on unique keys, never semi or
anti joins, which the optimiser would push below the filters.

The filters are blocked: a row's two bits lie in one block of 32,768 bits, so the
test is one broadcast join on the block number. A filter has about 16 bits a
row and ``MAX_LOG2_BITS`` bits at most (128 MB): that is the bound on what is
broadcast. Beyond about 67 million rows it fills up, more rows count as
possibly repeated and are shuffled, and the result stays exact.

Cases: null text counts as empty; empty texts are equal to each other; a null
id sorts after all others, so it is kept only if its group has no other id; of
repeated rows (same id, same text) exactly one is kept, in ``deduplicate`` that
whose other columns have the smallest hash; very long texts are read as digests
but for those that stay; an empty table gives an empty result; other columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

BLOCK_BITS = 32768
BITS_PER_ROW = 16
MAX_LOG2_BITS = 30
ROWS_PER_SALT = 65536


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def _bits(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    first = F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(BLOCK_BITS)).cast("int")
    step = F.pmod(F.xxhash64(sha, F.lit(2)), F.lit(BLOCK_BITS - 1)).cast("int") + 1
    # never null, so that a join on the block asks for no second look at the digest
    return F.coalesce(F.pmod(F.xxhash64(sha), F.lit(blocks)), F.lit(0)), first, F.pmod(first + step, F.lit(BLOCK_BITS))


def _blocks(rows: int) -> int:
    log2 = max(15, (max(1, rows) * BITS_PER_ROW - 1).bit_length())
    return 1 << (min(log2, MAX_LOG2_BITS) - 15)


def repeated_filter(digests: DataFrame, sha: str, blocks: int) -> DataFrame:
    """(block, bitmap) of the bits that two or more rows hit; at most ``blocks`` rows of 4 KB."""
    block, one, two = _bits(F.col(sha), blocks)
    hit = digests.select(block.alias("__blk"), F.explode(F.array(one, two)).alias("__bit"))
    twice = hit.groupBy("__blk", "__bit").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return twice.groupBy("__blk").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bm"))


def member_filter(ids: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """(block, bitmap) of all the ids' bits; at most ``blocks`` rows of 4 KB."""
    block, one, two = _bits(F.col(id_col), blocks)
    hit = ids.select(block.alias("__blk"), F.explode(F.array(one, two)).alias("__bit"))
    return hit.groupBy("__blk").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bm"))


def split_by_members(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``df``'s rows that may be among ``ids`` (a written table), and those that aren't for sure; no row is shuffled."""
    blocks = _blocks(ids.count())
    flag = unused(df.columns, "maybe")
    tested = maybe_repeated(df, col, written(member_filter(ids, id_col, blocks), "members"), blocks, flag)
    return tested.filter(F.col(flag)).drop(flag), tested.filter(~F.col(flag)).drop(flag)


def among(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """``df``'s rows that are among ``ids`` (a written table of distinct values). Only those that a Bloom filter lets through are shuffled."""
    maybe, _ = split_by_members(df, col, ids, id_col)
    key = unused(df.columns, "key")
    return maybe.join(ids.select(F.col(id_col).alias(key)), F.col(f"`{col}`") == F.col(key)).drop(key)


def not_among(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """``df``'s rows that aren't among ``ids`` (a written table of distinct values), null ones included.

    Rows that a Bloom filter clears pass straight through. The others are looked up by their
    ``col`` alone, and only rows that the filter took wrongly are shuffled."""
    maybe, out = split_by_members(df, col, ids, id_col)
    key = unused(df.columns, "key")
    seen = maybe.select(F.col(f"`{col}`").alias(key)).distinct().join(ids.select(F.col(id_col).alias("__there")), F.col(key) == F.col("__there"), "left")
    wrong = written(seen.filter("__there is null").select(key), "wrong")
    return out.unionByName(among(maybe, col, wrong, key))


def maybe_repeated(df: DataFrame, sha: str, bloom: DataFrame, blocks: int, flag: str = "__maybe") -> DataFrame:
    """``df`` with boolean ``flag``: false only for rows whose ``sha`` the filter doesn't hold."""
    block, one, two = _bits(F.col(f"`{sha}`"), blocks)
    blk, bm = unused([*df.columns, flag], "blk", "bm")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bm), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, F.pmod(bit, F.lit(8))).bitwiseAND(1) == 1

    joined = df.withColumn(blk, block).join(F.broadcast(bloom.select(F.col("__blk").alias(blk), F.col("__bm").alias(bm))), blk, "left")
    return joined.withColumn(flag, F.col(bm).isNotNull() & is_set(one) & is_set(two)).drop(blk, bm)


def groups(maybe: DataFrame, id_col: str, sha: str, rows: int) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) of possibly repeated rows.

    A group of any size, of one id or of null ids too, is dealt out by (digest, salt): a salt is a hash of id and task."""
    salts = max(64, -(-rows // ROWS_PER_SALT))
    member = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    part = (
        maybe.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col), F.spark_partition_id()), F.lit(salts)))
        .groupBy(F.col(sha).alias("__sha"), "__salt")
        .agg(F.sort_array(F.collect_list(member)).alias("__members"))
        .withColumn("__first", F.element_at("__members", 1))
    )
    total = part.groupBy("__sha").agg(F.min("__first").alias("__keep"), F.sum(F.size("__members")).alias("__size"), F.min(F.struct("__first", "__salt")).alias("__at"))
    joined = part.join(total, "__sha")
    row = joined.select("__sha", "__keep", "__size", "__at", "__salt", F.posexplode("__members").alias("__pos", "__m"))
    kept = (F.col("__pos") == 0) & (F.col("__salt") == F.col("__at.__salt"))
    return row.select(
        F.col("__m.id").alias("id"), F.col("__keep.id").alias("keep_id"), F.col("__size").cast("long").alias("group_size"),
        kept.alias("kept"), F.col("__sha").alias("sha"),
    )


def _prepared(df: DataFrame, id_col: str, text_col: str):
    digests = written(df.select(F.col(f"`{id_col}`").alias("__id"), digest(F.col(f"`{text_col}`")).alias("__sha")), "digests")
    n = digests.count()
    blocks = _blocks(n)
    bloom = written(repeated_filter(digests, "__sha", blocks), "bloom")
    return digests, n, blocks, bloom


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha (see the module's docstring)."""
    digests, n, blocks, bloom = _prepared(df, id_col, text_col)
    tested = maybe_repeated(digests, "__sha", bloom, blocks)
    straight = tested.filter(~F.col("__maybe")).select(
        F.col("__id").alias("id"), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("sha")
    )
    return straight.unionByName(groups(tested.filter("__maybe"), "__id", "__sha", n))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without repeated texts: the row with the smallest id of each text stays."""
    digests, n, blocks, bloom = _prepared(df, id_col, text_col)
    key = lambda id_, sha: F.concat_ws(":", F.col(sha), F.col(id_).cast("string"))
    doubtful = written(maybe_repeated(digests, "__sha", bloom, blocks).filter("__maybe"), "doubtful")
    stay = written(groups(doubtful, "__id", "__sha", n).filter("kept").select(key("id", "sha").alias("key")), "stay")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(whole.alias("row"), F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("sha"))
    tested = maybe_repeated(rows, "sha", bloom, blocks)
    straight = tested.filter(~F.col("__maybe")).select("row")
    met = among(tested.filter("__maybe").select("row", key("id", "sha").alias("key")), "key", stay, "key")
    once = met.groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return straight.unionByName(once.select("row")).select("row.*")
