"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a keyed hash and queue up, once per epoch, in packets of at most
``PACKET`` words. A packet's virtual finish time is the words its source has sent by its end, divided by
the source's target. All packets are sorted by finish time, and the mix is cut where the running total of
their words reaches the budget. Since the targets add up to the budget, the cut lies about virtual time 1,
so a source's words come within a packet of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, sent

#: Words, as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"

#: Words of a packet. Smaller ones bring sources closer to their targets and cost more rows.
PACKET = 256
#: Documents that one slice of a source's queue should hold, and words of a range of finish times.
SLICE_ROWS, RANGE_WORDS = 200_000, 4_000_000


def word_count(text: Column) -> Column:
    """Number of ``WORD`` matches; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Add ``weight`` and ``target`` to ``sources(source, source_size)``.

    Sources by code point, null last, take ``weights`` in turn. The budget is the sum of all sizes; a
    target stops at ``most`` times its source's size and the excess is shared again by weight until none
    is above. In order of capacity per weight, a source is full exactly when its capacity is at most its
    weight's share of what the sources before it leave. One row per source; a table of corpus sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumn("left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    key = [(F.col("cap") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c")]
    first = F.min(F.when(~F.col("full"), F.struct(*key, "left", "open"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * first["left"] / first["open"])
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def place(docs: DataFrame, seed: int) -> Column:
    """A document's place in the shuffle of its source: a keyed hash of its id and text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit("")))))


def _queued(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    """doc_id, source, size, h, source_size, target, begin: the source's running total before the document in its first epoch.

    The running totals are two-level: a source's queue is cut into slices of the hash range, slices are
    summed first, and windows run within a (source, slice), so a source with a third of all rows is spread
    like the rest.
    """
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(docs, seed).alias("h")), "queue")
    slices = max(1, rows.count() // SLICE_ROWS)
    digits = max(2, -(-max(slices - 1, 1).bit_length() // 4))
    rows = rows.withColumn("slice", F.substring("h", 1, digits) if slices > 1 else F.lit("0"))
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sources = targets(by_slice.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    plan = by_slice.select("source", "slice", "base").alias("a").join(sources.alias("b"), F.expr("a.source <=> b.source"))
    plan = plan.select(F.col("a.source").alias("s"), F.col("slice").alias("sl"), "base", "source_size", "target")
    queue = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("within", F.sum("size").over(queue)).join(plan, F.expr("source <=> s and slice = sl"))
    begin = F.col("base") + F.col("within") - F.col("size")
    return materialize(placed.select("doc_id", "source", "size", "h", "source_size", "target", begin.alias("begin")), "placed")


_DOC = ["doc_id", "source", "size", "h", "source_size", "target", "begin"]


def _served(queued: DataFrame, most: int) -> DataFrame:
    """The packets of ``queued`` with their finish times and ``served``, the words of each that the budget still holds.

    A packet that would begin after virtual time 1 isn't queued, for the budget is spent by then. Up to
    time 1 all sources together send evenly, so ranges of equal width in finish time hold about equally many
    words: they are summed first, and the running total in order of finish runs within a range.
    """
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(1, budget // RANGE_WORDS)
    each = F.ceil(F.col("size") / PACKET).cast("int")
    packets = queued.filter("size > 0 and begin < target").withColumn("i", F.explode(F.sequence(F.lit(0), most * each - 1)))
    packets = packets.withColumn("epoch", F.floor(F.col("i") / each).cast("int")).withColumn("packet", (F.col("i") % each).cast("int")).drop("i")
    start = F.col("begin") + F.col("epoch") * F.col("source_size") + F.col("packet") * PACKET
    packets = packets.withColumn("start", start).filter("start < target").withColumn("words", F.least(F.lit(PACKET), F.col("size") - F.col("packet") * PACKET))
    packets = packets.withColumn("finish", (F.col("start") + F.col("words")).cast("double") / F.col("target"))
    packets = packets.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges)).cast("int"))
    sums = packets.groupBy("range").agg(F.sum("words").alias("n"))
    sums = sums.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("range").orderBy("finish", "doc_id", "source", "epoch", "packet", "start").rowsBetween(Window.unboundedPreceding, 0)
    packets = packets.withColumn("upto", F.sum("words").over(order)).join(sent(materialize(sums, "ranges")), F.expr("range = r"))
    left = F.lit(budget) - F.col("before") - F.col("upto") + F.col("words")
    return packets.withColumn("served", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long"))


def _taken(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    queued = _queued(docs, weights, most, seed)
    reached = _served(queued, most).groupBy(*_DOC).agg(F.sum("served").alias("taken"))
    rest = queued.filter("not (size > 0 and begin < target)").withColumn("taken", F.lit(0).cast("long"))
    return reached.select(*_DOC, "taken").unionByName(rest.select(*_DOC, "taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken.

    ``docs`` has doc_id, text and source; a null or empty text has size 0 and is never taken, a very long
    one is many packets, a null source is a source like any other, null or repeated ids are rows like any
    other (ties in the shuffle, which rows alike in id and text have, are broken by size; equal rows are
    interchangeable), other columns are ignored, an empty table gives no rows. ``taken`` counts repeats and
    is at most ``most`` times the size; all of them together are the size of ``docs``.

    Only (doc_id, source, size, hash) leave the scan, and words are counted once.
    """
    return _taken(docs, weights, most, seed).select("doc_id", "size", "source_size", "target", "taken")


def finish_times(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The mix as served: one row per packet, sorted by virtual finish time, the last one cut at the budget.

    Columns doc_id, source, epoch, packet, finish, words. For writing a mix in order.
    """
    rows = _served(_queued(docs, weights, most, seed), most).filter("served > 0")
    return rows.select("doc_id", "source", "epoch", "packet", "finish", F.col("served").alias("words")).orderBy("finish", "doc_id", "source", "epoch", "packet")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """``docs``, all columns whatever their names, each row as often as the mix takes it, half or more of it counting as whole.

    What a source sends is a prefix of its queue, so a source's mix is told by the number of whole epochs and
    the place where the next one ends. Those are joined with ``docs`` (sent to the tasks if sources are
    few), and texts stay where they are. Documents without words go; a null source, null or repeated ids
    are as in :func:`mix`, and rows alike in id and text are taken alike; an empty table gives no rows.
    """
    taken = _taken(docs, weights, most, seed).filter("size > 0")
    copies = sum((F.col("taken") * 2 >= (2 * e + 1) * F.col("size")).cast("int") for e in range(most))
    by_source = taken.withColumn("copies", copies).select("source", "h", "copies")
    whole, last, source, n = (free_name(docs, x) for x in ("__epochs", "__last", "__source", "__copy"))
    # the copies of a source are k + 1 up to a place in its queue and k after it
    places = by_source.groupBy("source", "copies").agg(F.max("h").alias("h"))
    cuts = places.groupBy(F.col("source").alias(source)).agg(F.min("copies").alias(whole), F.max_by("h", "copies").alias(last), F.max("copies").alias(n))
    cuts = materialize(cuts.select(source, whole, F.when(F.col(n) > F.col(whole), F.col(last)).alias(last)), "cuts")
    wide = docs.join(sent(cuts, 256), docs["source"].eqNullSafe(cuts[source])).filter(F.coalesce(docs["text"].rlike(WORD), F.lit(False)))
    more = F.coalesce(place(docs, seed) <= F.col(last), F.lit(False)).cast("int")
    wide = wide.withColumn(n, F.col(whole) + more).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return wide.select(*[docs[c] for c in docs.columns])


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('17:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))) as h
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, list_extract([5.0::double, 2.0::double, 1.0::double], ((row_number() over (order by source collate "C" nulls last) - 1) % 3 + 1)::int) as weight, source_size::double * 3 as cap from src),
r as (select *, sum(source_size::double) over () - coalesce(sum(cap) over o, 0) as room, sum(weight) over () - coalesce(sum(weight) over o, 0) as open,
             row_number() over (order by cap / weight, source nulls last) as k
      from w window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap * open <= room * weight as is_full from r),
g as (select *, arg_min(room, k) filter (where not is_full) over () as room1, arg_min(open, k) filter (where not is_full) over () as open1 from f),
t as (select source, source_size, case when is_full then cap else weight * room1 / open1 end as target from g),
q as (select s.*, t.source_size, t.target, row_number() over () as r,
             (sum(size) over (partition by s.source order by h, doc_id nulls first, size rows unbounded preceding) - size)::bigint as start_at
      from sized s join t on s.source is not distinct from t.source),
p as (select *, unnest(range(0, 3 * ((size + 255) // 256))) as i from q where size > 0),
e as (select *, (i // ((size + 255) // 256))::bigint as epoch, (i % ((size + 255) // 256))::bigint as packet from p),
z as (select *, start_at + epoch * source_size + packet * 256 as start, least(256, size - packet * 256) as words from e),
y as (select *, (start + words)::double / target as finish from z where start < target),
x as (select *, sum(words) over (order by finish, doc_id nulls first, source nulls first, epoch, packet, start rows unbounded preceding) as upto from y),
c as (select r, sum(greatest(0, least(words, (select sum(size) from sized) - upto + words)))::bigint as taken from x group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from q left join c using (r)
"""
