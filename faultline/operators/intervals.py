"""Interval join to an event calendar that is a table (JN-04, JN-05).

A row takes the tags of the last calendar entry (by ``seq``) whose ``start <= ts <=
end`` holds it.  Entries may overlap by the thousand, so rows are not joined to all
entries that hold them.  The calendar is first cut at all its starts and ends into
disjoint segments, each with the one entry that wins there:

* an entry covers a run of consecutive segments, which is a union of at most two
  blocks per power of two; of all entries on one block only the last is kept;
* a segment lies in one block per power of two, and the last of those blocks' winners
  is its winner.

So the work is (entries + segments) x log(segments).  Then rows and segment starts are
range-partitioned by time together, and a running maximum of segment numbers gives
every row its segment: one shuffle, whatever the skew in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import series
from faultline.session import broadcast_if_small, reliable_checkpoint

TAGS = {"event_label": "normal", "error_rate_boost": 0.0, "rt_multiplier": 1.0}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def winning_segments(calendar: DataFrame, start: str = "start", end: str = "end", seq: str = "seq", key: str | None = None) -> DataFrame:
    """Disjoint segments (_key, _no, _from in microseconds) of the calendar, in
    order, with the entry ``_seq`` that wins there (null between entries).  An entry
    that ends before it starts, or lacks one of the two, holds nothing."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    cal = calendar.select(name.alias("_key"), F.col(seq).cast("long").alias("_seq"), _micros(F.col(start)).alias("_a"), (_micros(F.col(end)) + 1).alias("_b"))
    cal = reliable_checkpoint(cal.where("_a < _b and _seq is not null"))
    cuts = cal.select("_key", F.explode(F.array("_a", "_b")).alias("_from")).distinct().withColumn("_one", F.lit(1).cast("long"))
    cuts = reliable_checkpoint(series.cumulative(cuts, "_key", ["_from"], ["_one"]).select("_key", "_from", (F.col("cum__one") - 1).alias("_no")))
    levels = max(1, int(cuts.agg(F.coalesce(F.max("_no"), F.lit(0))).first()[0]).bit_length())
    # sides that grow with the calendar: by their size on disk the planner would broadcast them
    spans = (cal.hint("merge").join(cuts.select("_key", F.col("_from").alias("_a"), F.col("_no").alias("i")), ["_key", "_a"])
             .join(cuts.select("_key", F.col("_from").alias("_b"), F.col("_no").alias("j")).hint("merge"), ["_key", "_b"]))

    def blocks(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        lo, hi = F.floor((F.col("i") + size - 1) / size), F.floor(F.col("j") / size)
        return F.array(F.when((lo < hi) & (lo % 2 == 1), F.struct(level.alias("level"), lo.cast("long").alias("block"))),
                       F.when((lo < hi) & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).cast("long").alias("block"))))

    every = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), blocks)), lambda x: x.isNotNull())
    won = spans.select("_key", "_seq", F.explode(every).alias("x")).groupBy("_key", "x.level", "x.block").agg(F.max("_seq").alias("_seq"))
    home = cuts.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    home = home.withColumn("block", F.floor(F.col("_no") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    best = home.hint("merge").join(won, ["_key", "level", "block"]).groupBy("_key", "_no").agg(F.max("_seq").alias("_seq"))
    return reliable_checkpoint(cuts.hint("merge").join(best, ["_key", "_no"], "left").select("_key", "_no", "_from", "_seq"))


def last_match(df: DataFrame, calendar: DataFrame, columns: list[str], ts: str = "timestamp", key: str | None = None, calendar_key: str | None = None,
               start: str = "start", end: str = "end", seq: str = "seq") -> DataFrame:
    """``df`` with the calendar's ``columns`` as struct ``_event`` of the last entry
    that holds the row's time (of its ``key``, if given); null where none does."""
    segments = winning_segments(calendar, start, end, seq, calendar_key)
    name = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    rows = df.select(F.struct(*df.columns).alias("_row"), name.alias("_key"), _micros(F.col(ts)).alias("_at"), F.lit(1).alias("_kind"),
                     F.lit(None).cast("long").alias("_no"))
    marks = segments.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_key", F.col("_from").alias("_at"), F.lit(0).alias("_kind"), "_no")
    placed = series.cumulative(rows.unionByName(marks), "_key", ["_at", "_kind"], ["_no"], agg="max").where("_kind = 1")
    entry = calendar.select(F.col(seq).cast("long").alias("_seq"), F.struct(*columns).alias("_event"))
    tags = segments.hint("merge").join(entry, "_seq").select(F.col("_key").alias("_k"), F.col("_no").alias("_n"), "_event")
    out = placed.join(broadcast_if_small(reliable_checkpoint(tags)), (F.col("_key") == F.col("_k")) & (F.col("cum__no") == F.col("_n")), "left")
    return out.select("_row.*", "_event")


def tag_from_calendar(df: DataFrame, calendar: DataFrame, ts: str = "timestamp", api: str = "api_name") -> DataFrame:
    """JN-05 with calendar rows (seq, api_name or null for all APIs, start, end,
    event_label, error_rate_boost, rt_multiplier): the API's own label unless there
    is none, the greater boost and multiplier of the two.  ``seq`` is unique; a row
    without a time is normal."""
    cols = list(TAGS)
    wide = last_match(df, calendar.where(F.col(api).isNull()), cols, ts).withColumnRenamed("_event", "_all")
    both = last_match(wide, calendar.where(F.col(api).isNotNull()), cols, ts, api, api).withColumnRenamed("_event", "_own")

    def tag(c: str, of: str) -> Column:
        return F.coalesce(F.col(f"{of}.{c}"), F.lit(TAGS[c]))

    return both.select(*df.columns, F.when(tag("event_label", "_own") != "normal", tag("event_label", "_own")).otherwise(tag("event_label", "_all")).alias("event_label"),
                       *[F.greatest(tag(c, "_all").cast("double"), tag(c, "_own").cast("double")).alias(c) for c in cols[1:]])
