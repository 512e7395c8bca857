"""Mixing sources to target weights by a low-discrepancy schedule (operator 7).

DataFrame functions only. Each source's documents, in the order of a hash, form
one stream of words that is cut into blocks of equal length. The schedule is drawn
slot by slot: the golden-ratio point of slot t is mapped through the sources'
cumulative weights, slots are ranked within their source, and the slot of rank k takes
block k modulo the number of blocks. It ends where its words reach the total, so
the sequence decides how often each source and each block is taken, and when.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelq.llm.common import materialise, maybe_broadcast, table, text_key

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks that all words together are cut into, and blocks of a small source at least.
BLOCKS, LEAST_BLOCKS = 1 << 16, 256
#: Rows that one bucket of a source's stream holds on average, and buckets of one group.
BUCKET_ROWS, GROUP_BUCKETS = 512, 1024
MAX_REPEATS = 3
#: Golden-ratio points: t * GOLDEN modulo 2^32, over 2^32. Slots drawn for each that is expected,
#: so that the words reach the total, and slots whose words are summed up in one task.
GOLDEN, SPARE, GROUP_SLOTS = 2654435769, 1.0625, 4096


@dataclass
class Mix:
    sources: DataFrame    #: source, size, weight, target, blocks, uses, first_point
    schedule: DataFrame   #: slot, src, source, rank, block, epoch, words
    blocks: DataFrame     #: a row for each document and block it overlaps, with both ranges
    taken: DataFrame      #: a row for each document: doc_id, text_key, size, source_size, target, taken, first_slot


def _targets(sized: DataFrame, weights) -> DataFrame:
    """One row per source. Windows here run over sources, not over documents."""
    total = Window.partitionBy()
    by_name = total.orderBy(F.col("source").asc_nulls_last())
    by_ratio = total.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = sized.groupBy("source").agg(F.sum("size").alias("size"))
    s = s.withColumn("src", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("size") * MAX_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumns({"all_size": F.sum("size").over(total), "all_weight": F.sum("weight").over(total),
                       "cap_before": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)),
                       "weight_before": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))})
    # sources in order of cap / weight: those that stop at their cap come first
    capped = F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("all_size") - F.col("cap_before"))
    s = s.withColumn("capped", capped)
    open_size = F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(total)
    open_weight = F.col("all_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(total)
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.try_divide(open_size.cast("double"), open_weight)))


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), seed="7:") -> Mix:
    """Plan a mix with the total size of ``docs``.

    A document's size is its number of words; null and empty texts have none and
    are taken zero times. A null source is a source of its own, the last. Equal
    rows are taken alike up to their order in the stream, which is that of
    md5(seed + id); reruns agree. Empty tables give empty results; other columns
    are ignored. No document is taken more than three times its size: a source whose blocks
    have all come up that often is passed over. first_slot is the slot that a document's
    words first come in, -1 if none does."""
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"), text_key(text_col).alias("text_key")))
    n_docs, n_sources = sized.agg(F.count("*"), F.count_distinct(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))).first()

    length = F.greatest(F.col("all_size") / BLOCKS, F.lit(1.0))
    s = _targets(sized, weights)
    s = s.withColumn("blocks", F.least("size", F.greatest(F.lit(LEAST_BLOCKS), F.round(F.col("size") / length))).cast("long"))
    s = s.withColumn("uses", F.when(F.col("size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("size"))).otherwise(0).cast("long"))
    before = Window.partitionBy().orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("first_point", F.coalesce(F.sum("uses").over(before), F.lit(0)))
    s = s.withColumn("all_uses", F.sum("uses").over(Window.partitionBy()))
    s = materialise(s.select("src", "source", "size", "weight", "target", "blocks", "uses", "first_point", "all_uses"))

    # The point of a slot falls on one of all_uses equal parts of the unit interval; a source has
    # as many parts, next to each other, as it is to have slots.
    parts_of = s.where("uses > 0").select("src", "source", "blocks", F.col("size").alias("source_size"),
                                          F.explode(F.sequence("first_point", F.col("first_point") + F.col("uses") - 1)).alias("part"))
    all_uses, all_size = s.agg(F.coalesce(F.max("all_uses"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    drawn = docs.sparkSession.range(0, math.ceil(all_uses * SPARE) + 65).withColumnRenamed("id", "slot")
    point = F.pmod(F.col("slot") % (1 << 31) * GOLDEN, F.lit(1 << 32)) / float(1 << 32)
    slots = drawn.withColumn("part", F.floor(point * F.lit(all_uses)).cast("long")).join(parts_of, "part")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("slot")) - 1  # slots of a source: at most 3 * BLOCKS or so
    slots = slots.withColumn("rank", rank.cast("long")).where(F.col("rank") < MAX_REPEATS * F.col("blocks"))
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cut = lambda b: F.expr(f"({b}) * (source_size div blocks) + (({b}) * (source_size % blocks)) div blocks")
    slots = materialise(slots.withColumn("words", cut("block + 1") - cut("block")).withColumn("grp", F.floor(F.col("slot") / GROUP_SLOTS)))
    sums = slots.groupBy("grp").agg(F.sum("words").alias("w"))  # a row for each GROUP_SLOTS slots
    sums = sums.select("grp", F.coalesce(F.sum("w").over(up_to(Window.partitionBy().orderBy("grp"))), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("words").over(up_to(Window.partitionBy("grp").orderBy("slot"))), F.lit(0))
    schedule = slots.withColumn("before", before).join(sums, "grp").where(F.col("before") + F.col("base") < F.lit(all_size))
    schedule = schedule.select("slot", "src", "source", "rank", "block", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), "words")
    block_uses = schedule.groupBy("src", "block").agg(F.count("*").alias("times"), F.min("slot").alias("first_slot"))

    # Where each document starts in its source's stream: sums within buckets of the
    # hash, then over buckets, then over groups of them, so that no task gets a whole source.
    buckets = -(-max(n_docs, 1) // BUCKET_ROWS)
    rows = sized.join(maybe_broadcast(s.select("src", F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "blocks"), n_sources, 256), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("grp", F.floor(F.col("bucket") / GROUP_BUCKETS))
    groups = sums.groupBy("src", "grp").agg(F.sum("words").alias("words"))
    groups = groups.select("src", "grp", F.coalesce(F.sum("words").over(up_to(Window.partitionBy("src").orderBy("grp"))), F.lit(0)).alias("base"))
    sums = sums.join(groups, ["src", "grp"]).select("src", "bucket", (F.col("base") + F.coalesce(F.sum("words").over(up_to(Window.partitionBy("src", "grp").orderBy("bucket"))), F.lit(0))).alias("base"))
    stream = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size")
    rows = rows.withColumns({"n": F.row_number().over(stream), "start": F.coalesce(F.sum("size").over(up_to(stream)), F.lit(0))})
    rows = rows.join(sums, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("base")).withColumn("end", F.col("start") + F.col("size"))

    of = lambda p: F.expr(f"(({p} + 1) * blocks - 1) div source_size")  # noqa: E731  the block that holds word p
    parts = rows.where("size > 0").select("doc_id", "text_key", "src", "bucket", "n", "size", "source_size", "target", "start", "end", "blocks",
                                          F.explode(F.sequence(of("start"), of("end - 1"))).alias("block"))
    parts = parts.withColumns({"block_start": cut("block"), "block_end": cut("block + 1")})
    words = F.least("end", "block_end") - F.greatest("start", "block_start")
    used = parts.join(block_uses, ["src", "block"], "left").groupBy("src", "bucket", "n", "doc_id", "text_key", "size", "source_size", "target").agg(
        F.sum(words * F.coalesce("times", F.lit(0))).alias("taken"), F.coalesce(F.min("first_slot"), F.lit(-1)).alias("first_slot"))
    cols = ["doc_id", "text_key", "size", "source_size", "target", "taken", "first_slot"]
    taken = used.select(cols).union(rows.where("size = 0").select(*cols[:5], F.lit(0).cast("long"), F.lit(-1).cast("long")))
    return Mix(s, schedule, parts, taken.withColumn("target", F.coalesce("target", F.lit(0.0))))


def op7_source_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).taken.drop("text_key")


ORACLE = rf"""
with d as (select doc_id, source, md5('7:' || coalesce(cast(doc_id as varchar), '')) as key,
    cast(coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0) as bigint) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as size, row_number() over (order by source nulls last) as src from d group by source),
s1 as (select *, (src - 1) % 3 + 1 as weight, size * {MAX_REPEATS} as cap from s0),
s2 as (select *, sum(size) over () as all_size, sum(weight) over () as all_weight,
    coalesce(sum(cap) over (order by cast(cap as double) / weight, src rows between unbounded preceding and 1 preceding), 0) as cap_before,
    coalesce(sum(weight) over (order by cast(cap as double) / weight, src rows between unbounded preceding and 1 preceding), 0) as weight_before from s1),
s3 as (select *, cap * (all_weight - weight_before) <= weight * (all_size - cap_before) as capped from s2),
s4 as (select *, case when capped then cast(cap as double) else weight * (cast(all_size - sum(case when capped then cap else 0 end) over () as double)
    / (all_weight - sum(case when capped then weight else 0 end) over ())) end as target from s3),
s5 as (select *, cast(least(size, greatest({LEAST_BLOCKS}, round(size / greatest(cast(all_size as double) / {BLOCKS}, 1.0)))) as bigint) as blocks from s4),
s6 as (select *, cast(case when size > 0 then round(target * blocks / size) else 0 end as bigint) as uses from s5),
s as (select *, cast(sum(uses) over (order by src rows unbounded preceding) - uses as bigint) as first_point, cast(sum(uses) over () as bigint) as all_uses from s6),
q as (select unnest(range(0, cast(ceil((select max(all_uses) from s) * {SPARE}::double) as bigint) + 65)) as slot),
q1 as (select slot, cast(floor(((slot * {GOLDEN}) % 4294967296) / 4294967296.0::double * (select max(all_uses) from s)) as bigint) as part from q),
q2 as (select slot, s.*, row_number() over (partition by src order by slot) - 1 as rank from q1 join s on part >= first_point and part < first_point + uses),
q3 as (select *, rank % blocks as b from q2 where rank < {MAX_REPEATS} * blocks),
q4 as (select *, sum(((b + 1) * size) // blocks - (b * size) // blocks) over (order by slot rows between unbounded preceding and 1 preceding) as words_before from q3),
u as (select src, b, count(*) as times, min(slot) as first_slot from q4 where coalesce(words_before, 0) < all_size group by src, b),
r as (select d.doc_id, d.size, s.src, s.size as source_size, s.target, s.blocks, row_number() over () as row_no,
    cast(sum(d.size) over (partition by s.src order by d.key, d.doc_id, d.size rows unbounded preceding) - d.size as bigint) as w0
    from d join s on d.source is not distinct from s.source),
p as (select *, unnest(range(((w0 + 1) * blocks - 1) // source_size, ((w0 + size) * blocks - 1) // source_size + 1)) as b from r where size > 0),
t as (select row_no, sum((least(w0 + size, ((b + 1) * source_size) // blocks) - greatest(w0, (b * source_size) // blocks)) * coalesce(times, 0)) as taken,
    min(first_slot) as first_slot from p left join u using (src, b) group by row_no)
select doc_id, size, source_size, coalesce(target, 0.0) as target, cast(coalesce(taken, 0) as bigint) as taken, coalesce(first_slot, -1) as first_slot from r left join t using (row_no)
"""
