"""Exact dedup by a heavy-hitter split, with built-in functions only.

Misra-Gries counters over blocks of digests name the candidates for frequent digests;
their exact counts are taken with map-side combining, and those winners (at most
``counters`` of them) are broadcast, so rows of hot groups never move. All other
digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, lower_ascii, materialize

#: One Misra-Gries summary holds at most this many counters: a digest with more than 1/(COUNTERS+1) of all rows can't be missed.
COUNTERS = 256
#: Rows that one summary is folded over.
BLOCK = 8192


def frequent_digests(digests: DataFrame, counters: int = COUNTERS, block: int = BLOCK) -> DataFrame:
    """(digest, keep_id, group_size) of every digest with more than 1/(counters+1) of the rows; at most ``counters`` rows.

    Each block is first counted by digest, then folded: a known digest adds its count,
    a new one takes a free counter, else the least counter's amount is taken from all.
    Block summaries are added up and only the largest ``counters`` stay; none of
    the digests above the bound can be lost (summaries of this kind are mergeable). Counts
    are then taken exactly.
    """
    k = counters
    step = f"""
      case when size(acc) < {k} then array_append(acc, x)
           else filter(transform(array_append(acc, x), y -> struct(y.h as h, y.c - array_min(transform(array_append(acc, x), z -> z.c)) as c)), y -> y.c > 0) end
    """
    blocks = (
        digests.select(F.xxhash64("digest").alias("h"), F.expr(f"monotonically_increasing_id() div {block}").alias("b"))
        .groupBy("b", "h").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("b").agg(F.collect_list(F.struct("h", "c")).alias("xs"))
    )
    summaries = blocks.select(F.explode(F.expr(f"aggregate(xs, cast(array() as array<struct<h:bigint,c:bigint>>), (acc, x) -> {step})")).alias("s"))
    merged = summaries.groupBy("s.h").agg(F.sum("s.c").alias("c")).orderBy(F.desc("c"), "h").limit(k).select("h")
    exact = (
        digests.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(merged), "h", "left_semi")  # at most k rows
        .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return exact.orderBy(F.desc("group_size"), "digest").limit(k)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the largest id
    stays (on repeated ids every row with that id counts as kept). Null text is empty text. Ids that
    are null are never kept beside a real one. An empty table gives no rows; other columns of the
    input are not read.
    """
    digests = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(lower_ascii(F.col(text)).cast("binary"), 256)).alias("digest")), "digests"
    )
    heavy = materialize(frequent_digests(digests, counters), "winners")  # at most `counters` rows
    hot = digests.join(F.broadcast(heavy), "digest")
    cold = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))  # combined before the shuffle
    rest = cold.join(groups, "digest").select("digest", "doc_id", "keep_id", "group_size")
    return hot.select(rest.columns).unionByName(rest).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of rows with equal texts exactly one, that with the largest id.

    Decided by row: a repeated id goes only with the text that has a larger one, a null id stays where no equal text has a real one. Where that id repeats
    with the text, the greatest row stays.
    """
    pairs = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    change = materialize(pairs.where("not kept or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), "kept"), "copies")
    keyed = docs.withColumn("_text", F.sha2(lower_ascii(F.col("text")).cast("binary"), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest"))
    out = keyed.join(change, same, "left_anti").select(docs.columns)
    again = change.where("kept")
    if again.isEmpty():
        return out
    row = F.max(F.struct(*docs.columns)).alias("row")
    return out.unionByName(keyed.join(again, same, "left_semi").groupBy("doc_id", "_text").agg(row).select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
"""
