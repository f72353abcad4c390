"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after deleting ASCII white space. A Misra-Gries summary (Spark's
freqItems) names the few candidate digests that can be frequent (common.frequent_one_in); their rows are counted and their
winners found by partial aggregation, and the verified winners are broadcast, so the rows of large groups are decided
where they are read. All other digests go through one shuffle. Only digests, ids and lengths move, and each row has a number of its
own, so rows that repeat everything are told apart without meeting.

Defined results: a null text counts as empty and equals every text of white space only. Of equal texts the one
with the most code points stays, then the smallest id (null last); of rows that repeat its id and length, one.
An empty table gives an empty table. exact_dedup() gives id, `keep_id`, `group_size`, `kept` and `digest` (SHA-256,
binary) of every row; drop_copies() gives the rows that stay, with all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulore.llm.common import ASCII_SPACE, cut, frequent_one_in

#: Copies to drop that may be broadcast, about 50 bytes each; more are shuffled, and the texts with them.
FEW = 1 << 20


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for space in ASCII_SPACE:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rank = F.struct((-F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("short"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    found = cut(df.select(digest_of(F.col(text_col)).alias("digest"), rank.alias("rank")))
    winners = F.broadcast(cut(heavy_winners(found)))
    often = found.join(winners, "digest")
    rare = found.join(winners.select("digest"), "digest", "left_anti")
    every = Window.partitionBy("digest")
    rare = rare.withColumns({"keep": F.min("rank").over(every), "group_size": F.count("*").over(every)})
    out = often.unionByName(rare)
    return out.select(F.col("rank.id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("rank.row") == F.col("keep.row")).alias("kept"), "digest")


def heavy_winners(found: DataFrame) -> DataFrame:
    """digest, keep, group_size of every digest that is frequent."""
    total = found.count()
    one_in = frequent_one_in(total)
    # the summary compares its keys as objects, which byte arrays don't allow
    named = found.select(F.hex("digest").alias("name")).freqItems(["name"], 1 / one_in)
    candidates = named.select(F.explode("name_freqItems").alias("name")).distinct().select(F.unhex("name").alias("digest"))
    counted = found.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.min("rank").alias("keep"), F.count("*").alias("group_size"))
    return counted.filter(F.col("group_size") >= max(2, total // one_in))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay. Texts are shuffled only if there are more than FEW copies, other than rows that repeat an id."""
    decided = cut(exact_dedup(df, id_col, text_col).filter("group_size > 1"))
    same = F.col(id_col).eqNullSafe(F.col("keep_id"))
    lost = decided.filter(~F.col("kept") & ~same).select(F.col("digest").alias("_digest"), F.col(id_col).alias("_id")).distinct()
    # groups in which rows repeat the winner's id: one of them stays, that with the longest text
    again = decided.filter(~F.col("kept") & same).select(F.col("digest").alias("_digest")).distinct()
    lost, again = (F.broadcast(x) if x.count() <= FEW else x for x in (lost, again))
    rows = df.withColumn("_own", digest_of(F.col(text_col)))
    stay = rows.join(lost, (F.col("_own") == F.col("_digest")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
    once = stay.join(again, F.col("_own") == F.col("_digest"), "left_anti").select(df.columns)
    every = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    longest = stay.join(again, F.col("_own") == F.col("_digest"), "left_semi").groupBy("_own").agg(F.max_by(every, F.length(F.col(text_col))).alias("row"))
    return once.unionByName(longest.select("row.*"))
