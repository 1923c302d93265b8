"""Mixing sources to target weights by a low-discrepancy source schedule.

The mix is a sequence of slots of about equally many words. Slot t takes its source from the t-th
van der Corput point, read against the cumulative targets, so every stretch of the mix is
close to the targets. Points below a bound form arithmetic progressions in t, so a slot's rank
among its source's slots is a short sum, without sorting or bounding the slots. Each source's
documents, in shuffled order and repeated up to max_epochs times, are cut into as many equal
blocks as the source has slots; the r-th slot of a source is joined to the r-th block. A source
that no point meets gets one slot, so no source is left out, however small its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Words of a slot. The number of slots grows with the corpus; they are made and joined in parallel.
SLOT_WORDS = 64
#: Shuffled documents of one source fall into this many (16 ** 4) groups, summed separately; their sums
#: are added up within 16 ** 2 parts first.
HEX_DIGITS, COARSE_DIGITS = 4, 2
#: The tables of sources are broadcast up to this many rows; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets by weight, none above max_epochs times its source's size.

    sizes: (_source, source_size), one row per source. Sources take the weights in turn by code
    point, null last. With sources ordered by the ratio cap / weight, the level (words per unit
    of weight) is the largest that any number of capped sources leaves to the others.
    One row per source runs through single-partition windows: the table of sources is small.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    capped = sizes.select("_source", "source_size", F.row_number().over(order).alias("_src"), weight.alias("_weight")).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    rising = Window.orderBy(F.col("_cap") / F.col("_weight"), "_src")
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    leveled = capped.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return leveled.select("_source", "_src", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_weight")).alias("target"))


def van_der_corput(t: Column, bits: int) -> Column:
    """The bits of t in reverse order: the t-th van der Corput point times 2 ** bits."""
    return reduce(lambda a, b: a + b, (F.shiftleft(F.shiftright(t, i).bitwiseAND(F.lit(1).cast("long")), bits - 1 - i) for i in range(bits)), F.lit(0).cast("long"))


def _progressions(edge: Column, bits: int) -> Column:
    """The slots whose points lie below the edge, as progressions first, first + 2 ** power, ...:
    one for each bit of the edge, of the points that agree with it up to there."""
    one = F.lit(1).cast("long")
    turned = van_der_corput(edge, bits)
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", edge, F.lit(bits - 1) - i).bitwiseAND(one) == 1), lambda i: F.struct(turned.bitwiseAND(F.call_function("shiftleft", one, i) - 1).alias("first"), (i + 1).alias("power")))
    return F.when(edge == 1 << bits, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).alias("power")))).otherwise(parts)


def _members_before(slot: Column, progressions: Column) -> Column:
    """How many numbers of the progressions are below `slot`."""
    one = F.lit(1).cast("long")
    return F.aggregate(progressions, F.lit(0).cast("long"), lambda n, p: n + F.call_function("shiftright", slot - p["first"] - 1 + F.call_function("shiftleft", one, p["power"]), p["power"]))


def source_slots(targets: DataFrame, n_slots: int) -> DataFrame:
    """targets with each source's words (the target as a whole number), its interval of points and
    how many slots it has: at least 1, if it has words, and at most its words. One row a source."""
    bits = max(1, (n_slots - 1).bit_length())
    order = Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    # A source's points are those at or above its lower edge and below its upper edge.
    upper = F.when(total > 0, F.ceil(F.sum("target").over(order) / total * (1 << bits))).otherwise(0).cast("long")
    spans = targets.withColumn("_words", F.round("target").cast("long")).withColumn("_hi", F.least(upper, F.lit(1 << bits).cast("long"))).withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("_src")), F.lit(0).cast("long")))
    spans = spans.withColumn("_below_hi", _progressions(F.col("_hi"), bits)).withColumn("_below_lo", _progressions(F.col("_lo"), bits))
    met = _members_before(F.lit(n_slots).cast("long"), F.col("_below_hi")) - _members_before(F.lit(n_slots).cast("long"), F.col("_below_lo"))
    return spans.withColumn("_met", met).withColumn("_slots", F.least(F.greatest("_met", F.lit(1)), "_words"))


def slot_schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """(_src, _r, slot): the slots 0 to n_slots - 1 with their source and their rank in it.

    A source that no point meets (see source_slots) shares the slot whose point is at its interval.
    """
    bits = max(1, (n_slots - 1).bit_length())
    coarse = min(10, bits)
    spans = sources.filter("_words > 0")
    cells = spans.filter("_met > 0").withColumn("_cell", F.explode(F.sequence(F.shiftright("_lo", bits - coarse), F.shiftright(F.col("_hi") - 1, bits - coarse))))
    points = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id"), bits).alias("_point")).withColumn("_cell", F.shiftright("_point", bits - coarse))
    rank = _members_before(F.col("slot"), F.col("_below_hi")) - _members_before(F.col("slot"), F.col("_below_lo"))
    slots = points.join(cells, "_cell").filter("_point >= _lo and _point < _hi").withColumn("_r", rank).filter("_r < _slots").select("_src", "_r", "slot")
    nearest = van_der_corput(F.least(F.col("_lo"), F.lit((1 << bits) - 1)), bits) % F.lit(n_slots)
    return slots.unionByName(spans.filter("_met = 0").select("_src", F.lit(0).cast("long").alias("_r"), nearest.alias("slot")))


def _placed(records: DataFrame, targets: DataFrame, max_epochs: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records with their first word's place in their source's shuffled sequence, and a row number in it.

    Rows that agree in everything are placed as one and taken apart afterwards, so that any number
    of copies of a row is one row of a window.
    """
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    known = targets.select(F.col("_source").alias("_named"), "_src", "source_size", "target", "_words", "_slots")
    distinct = records.groupBy("_source", "_key", "_id", "size", *keep).agg(F.count("*").alias("_m"))
    named = distinct.join(F.broadcast(known) if few else known, F.col("_source").eqNullSafe(F.col("_named"))).drop("_named").withColumn("_group", F.substring("_key", 1, HEX_DIGITS)).withColumn("_all", F.col("size") * F.col("_m"))
    sums = named.groupBy("_src", "_group").agg(F.sum("_all").alias("_sum"))
    sums = sums.withColumn("_part", F.substring("_group", 1, COARSE_DIGITS))
    before = lambda keys, order: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = sums.groupBy("_src", "_part").agg(F.sum("_sum").alias("_sum")).select("_src", "_part", before(["_src"], "_part").alias("_far"))
    sums = sums.withColumn("_near", before(["_src", "_part"], "_group")).join(coarse, ["_src", "_part"]).select("_src", "_group", (F.col("_near") + F.col("_far")).alias("_base"))
    inside = Window.partitionBy("_src", "_group").orderBy("_key", "_id", "size", *keep)
    counted = named.withColumn("_row", F.row_number().over(inside)).withColumn("_upto", F.sum("_all").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    apart = counted.join(sums, ["_src", "_group"]).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    return apart.withColumn("_start", F.col("_base") + F.col("_upto") - F.col("_all") + F.col("_copy") * F.col("size")).drop("_base", "_upto", "_all", "_m")


def mix_pieces(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """The mix itself, piece by piece, and documents that it leaves out.

    Returns (*keep, _id, _src, _group, _row, _copy, size, source_size, target, slot, from_word, words): words
    of the document from from_word on stand in that slot; documents outside the mix have a null slot
    and no words. (_src, _group, _row, _copy) identifies the row of docs, whose columns keep are
    carried along and settle the order of rows with equal ids and texts.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(name, F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    records = stored(docs.select(*keep, F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(F.col(text_col)).alias("size"), key.alias("_key")))
    total = records.agg(F.sum("size")).first()[0] or 0
    n_slots = max(1, -(-total // SLOT_WORDS))
    targets = stored(source_slots(source_targets(records.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, max_epochs), n_slots))
    placed = stored(_placed(records, targets, max_epochs, keep))
    # Blocks of a source have _words div _slots words, the first ones one more.
    short, longer = F.expr("_words div _slots"), F.col("_words") % F.col("_slots")
    begin_of = lambda r: r * short + F.least(r, longer)
    block_of = lambda at: F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / short))
    epochs = placed.filter("size > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("_at", F.col("_epoch") * F.col("source_size") + F.col("_start")).filter("_at < _words")
    epochs = epochs.withColumn("_end", F.least(F.col("_at") + F.col("size"), "_words"))
    pieces = epochs.withColumn("_r", F.explode(F.sequence(block_of(F.col("_at")), block_of(F.col("_end") - 1))))
    begin, end = F.greatest(F.col("_at"), begin_of(F.col("_r"))), F.least(F.col("_end"), begin_of(F.col("_r") + 1))
    columns = [*keep, "_id", "_src", "_group", "_row", "_copy", "size", "source_size", "target"]
    pieces = pieces.select(*columns, "_r", (begin - F.col("_at")).alias("from_word"), (end - begin).alias("words"))
    joined = pieces.join(slot_schedule(targets, n_slots), ["_src", "_r"], "left")
    used = joined.select(*columns, "slot", "from_word", F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0).cast("long").alias("words"))
    unused = placed.filter("size = 0 or _start >= _words").select(*columns, F.lit(None).cast("long").alias("slot"), F.lit(0).cast("long").alias("from_word"), F.lit(0).cast("long").alias("words"))
    return used.unionByName(unused)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (*keep, id_col, size, source_size, target, taken, first_slot).

    size counts words (null text: 0), taken the document's words in the mix, repeats included
    (at most max_epochs * size), first_slot where it first stands. The words taken of a source are
    its target, as a whole number. Sources with no words have the target 0; a null source is a
    source; repeated rows (ties in every respect) are documents of their own; rows with a null id
    are kept; a very long text spans many slots. Columns of docs not in keep are ignored. An empty
    table gives an empty result.
    """
    pieces = mix_pieces(docs, weights, max_epochs, id_col, text_col, source_col, keep)
    out = pieces.groupBy(*keep, "_src", "_group", "_row", "_copy", "_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return out.select(*keep, F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")


#: The digest in DuckDB: the same targets, each document's share of its source's words, and the slot in which it
#: first stands, from a schedule that ranks all points one by one.
SCHEDULE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s),
c AS (SELECT *, [5.0, 2.0, 1.0][((src - 1) % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM w),
l AS (
  SELECT *, ((sum(source_size::DOUBLE) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM c),
t AS (SELECT source, src, source_size, least(cap, max(lv) OVER () * weight) AS target FROM l),
n AS (SELECT greatest(1, ceil(sum(source_size) / 64.0))::BIGINT AS n_slots FROM s),
bt AS (SELECT n_slots, length(bin(n_slots - 1)) AS bits FROM n),
h AS (SELECT t.*, round(target)::BIGINT AS words, n_slots, bits, least(ceil(sum(target) OVER (ORDER BY src) / sum(target) OVER () * (1 << bits)), 1 << bits)::BIGINT AS hi FROM t, bt),
e AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM h),
pt AS (SELECT t, list_sum(list_transform(range(bits), lambda i: ((t >> i) & 1) << (bits - 1 - i)))::BIGINT AS point FROM (SELECT unnest(range(n_slots)) AS t, bits FROM bt)),
sl AS (SELECT src, t AS slot, row_number() OVER (PARTITION BY src ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY src) AS met FROM pt JOIN e ON point >= lo AND point < hi),
m AS (SELECT e.*, least(greatest(coalesce(met, 0), 1), words) AS slots, list_sum(list_transform(range(bits), lambda i: ((least(lo, (1 << bits) - 1) >> i) & 1) << (bits - 1 - i)))::BIGINT % n_slots AS lone, met
  FROM e LEFT JOIN (SELECT DISTINCT src, met FROM sl) USING (src)),
p AS (
  SELECT d.doc_id, d.size, m.src, m.source_size, m.target, words AS reach, met, lone, words // nullif(slots, 0) AS short, words % nullif(slots, 0) AS longer,
         sum(d.size) OVER (PARTITION BY m.src ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
q AS (SELECT *, CASE WHEN start < longer * (short + 1) THEN start // (short + 1) ELSE longer + (start - longer * (short + 1)) // short END AS r FROM p)
SELECT doc_id, size, source_size, target,
       list_sum(list_transform([0, 1, 2], lambda x: least(size, greatest(0, reach - x * source_size - start))))::BIGINT AS taken,
       CASE WHEN size > 0 AND start < reach THEN CASE WHEN q.met IS NULL THEN lone ELSE slot END END AS first_slot
FROM q LEFT JOIN sl ON sl.src = q.src AND sl.r = q.r
"""

#: The digest without the schedule.
MIX_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({SCHEDULE_SQL})"
