"""Interval algebra over (contig, start, end): positions from 1, both ends included.

Contigs are ordered by a table (idx, name, length), never by name. Operators take and give DataFrames; those over whole lists
partition by contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL, OVERLAPPING_ONLY = "ALL", "OVERLAPPING_ONLY"
#: Bins by which overlap joins are dealt are so many times as wide as the right side's mean interval, and this wide at least.
BIN_RATIO, LEAST_BIN = 4, 128
#: Width of the bins in which intervals are merged.
MERGE_BIN = 1_000_000
#: Interval tables of up to so many rows are broadcast to the other side.
BROADCAST_ROWS = 100_000
#: Running totals are made within bins of so many positions; those of up to so many positions are broadcast (some 10 MB).
TOTALS_BIN, BROADCAST_TOTALS = 16_384, 200_000


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def size(start: Column, end: Column) -> Column:
    return end - start + 1


def is_valid(start: Column, end: Column) -> Column:
    return (start > 0) & (end >= start)


def merge(intervals: DataFrame, rule: str = ALL, by: tuple[str, ...] = ("contig",), width: int = MERGE_BIN) -> DataFrame:
    """(by, start, end): islands of overlapping intervals, and under ALL of abutting ones too.

    Intervals are merged within bins of their starts first, then the islands of all bins; only these are put in order by contig as a whole.
    """

    def islands(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        apart = F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + (1 if rule == ALL else 0)
        marked = rows.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")

    binned = intervals.select(*by, "start", "end", F.floor(F.col("start") / width).alias("bin"))
    return islands(islands(binned, *by, "bin").drop("bin"), *by)


def clamp(intervals: DataFrame, contigs: DataFrame, padding: int = 0) -> DataFrame:
    """Each interval grown by padding and cut to its contig; those wholly outside are dropped, other columns kept."""
    sized = intervals.join(F.broadcast(contigs.select(F.col("name").alias("contig"), "length")), "contig")
    start, end = F.col("start") - padding, F.col("end") + padding
    kept = sized.where((start <= F.col("length")) & (end >= 1))
    return kept.withColumns({"start": F.greatest(F.lit(1), start), "end": F.least("length", end)}).select(*intervals.columns)


def pad(intervals: DataFrame, contigs: DataFrame, padding: int) -> DataFrame:
    """A padding of 0 leaves intervals as they are, even beyond their contig."""
    return clamp(intervals, contigs, padding) if padding else intervals


def with_flanks(intervals: DataFrame, contigs: DataFrame, padding: int) -> DataFrame:
    """Padded, then merged with abutting ones, whatever rule made the intervals."""
    return merge(pad(intervals, contigs, padding), ALL)


def union(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("contig", "start", "end")
    for other in lists[1:]:
        out = out.unionByName(other.select("contig", "start", "end"))
    return out


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", width: int | None = None, small: bool | None = None) -> DataFrame:
    """Pairs of overlapping rows of left and right (contig, start, end, others); right's columns get the prefix r_.

    how is inner, left, left_semi or left_anti. Rows meet by contig and bin, bins as wide as right's intervals ask for. A left row goes to the bin of its
    start alone, and right rows to their bins and the one before, so a pair meets once; left rows longer than a bin go to all
    of theirs, a pair counting where its overlap begins. A small right side, BROADCAST_ROWS at most unless stated, is broadcast, so that left isn't shuffled.
    """
    if small is None or width is None:
        told = right.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("end") - F.col("start") + 1).alias("mean")).first()
        small = told["n"] <= BROADCAST_ROWS if small is None else small
        width = max(LEAST_BIN, int(BIN_RATIO * (told["mean"] or 1))) if width is None else width
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    bins = lambda a, b, before=0: F.sequence(F.floor(a / width) - before, F.greatest(F.floor(b / width), F.floor(a / width)))
    dealt = r.withColumn("r_bin", F.explode(bins(F.col("r_start"), F.col("r_end"), 1)))
    dealt = F.broadcast(dealt) if small else dealt
    start, end = F.col("start"), F.col("end")
    long = end - start >= width
    hit = (F.col("contig") == F.col("r_contig")) & (F.col("bin") == F.col("r_bin")) & overlaps(start, end, F.col("r_start"), F.col("r_end"))
    owner = F.col("bin") == F.floor(F.greatest("start", "r_start") / width)
    if how == "inner":
        own = left.withColumn("bin", F.explode(F.when(long, bins(start, end)).otherwise(F.array(F.floor(start / width)))))
        return own.join(dealt, hit & (~long | owner)).drop("bin", "r_bin")
    brief = left.where(F.coalesce(~long, F.lit(True))).withColumn("bin", F.floor(start / width)).join(dealt, hit, how).drop("bin", "r_bin")
    rows = left.where(long).withColumn("__id", F.monotonically_increasing_id())
    pairs = rows.withColumn("bin", F.explode(bins(start, end))).join(dealt, hit & owner).drop("bin", "r_bin")
    met = pairs.select("__id").distinct()
    if how == "left":
        return brief.unionByName(pairs.drop("__id")).unionByName(rows.join(met, "__id", "left_anti").drop("__id"), allowMissingColumns=True)
    return brief.unionByName(rows.join(met, "__id", how).drop("__id"))


def overlap_totals(left: DataFrame, right: DataFrame, by: tuple[str, ...], sums: tuple[str, ...] = (), small: bool | None = None) -> DataFrame:
    """(by, n, sum_<c>): over the right rows of each group by, how many left rows overlap them, and the sums of these rows' columns (integers).

    The same as overlap_join(left, right) grouped by right's columns, without making the pairs: left rows that overlap [s, e] are those that start at e or
    before, less those that end before s. Both come from running totals over positions, a row each, so work grows with the rows of both sides and
    not with their pairs. A left row that ends more than one position before its start raises an error; right rows that end before they start are joined.
    """
    place = right.where("contig is not null and start is not null and end is not null")
    span = F.when(F.count_if(F.col("end") >= F.col("start")) > 0, F.least(2 * F.count(F.lit(1)), F.max("end").cast("long") - F.min("start") + 2))
    told = place.groupBy("contig").agg(span.alias("n"), F.count_if(F.col("end") < F.col("start")).alias("odd")).agg(F.sum("n").alias("n"), F.sum("odd").alias("odd")).first()
    small = (told["n"] or 0) <= BROADCAST_TOTALS if small is None else small
    long = lambda c: F.col(c).cast("long")
    parts = [("n", F.lit(1))] + [x for c in sums for x in ((f"sum_{c}", F.coalesce(long(c), F.lit(0))), (f"has_{c}", F.col(c).isNotNull().cast("int")))]
    names = [n for n, _ in parts]

    def mark(pos: Column, kind: int) -> Column:
        return F.struct(pos.cast("long").alias("pos"), *[(v if kind == k else F.lit(0)).cast("long").alias(f"{side}_{n}") for k, side in enumerate("se") for n, v in parts])

    error = F.raise_error(F.concat(F.lit("a row ends before its start: "), F.col("start").cast("string"))).cast("long")
    end = F.when(long("end") < long("start") - 1, error).otherwise(long("end"))
    marks = left.where("contig is not null and start is not null and end is not null").select("contig", F.explode(F.array(mark(F.col("start"), 0), mark(end, 1))).alias("m")).select("contig", "m.*", F.lit(False).alias("asked"))
    even = place.where("end >= start")
    asks = even.select("contig", *by, F.explode(F.array(F.struct(long("end").alias("pos"), F.lit(True).alias("upper")), F.struct((long("start") - 1).alias("pos"), F.lit(False).alias("upper")))).alias("a")).select("contig", *by, "a.*")
    totals = [f"{side}_{n}" for side in "se" for n in names]
    points = marks.unionByName(asks.select("contig", "pos", *[F.lit(0).cast("long").alias(c) for c in totals], F.lit(True).alias("asked")))
    held = points.groupBy("contig", "pos").agg(*[F.sum(c).alias(c) for c in totals], F.max("asked").alias("asked")).withColumn("bin", F.floor(F.col("pos") / TOTALS_BIN))
    within = Window.partitionBy("contig", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = held.groupBy("contig", "bin").agg(*[F.sum(c).alias(c) for c in totals], F.max("asked").alias("asked"))
    carried = bins.select("contig", "bin", "asked", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in totals]).where("asked").drop("asked")
    run = held.select("contig", "bin", "pos", "asked", *[F.sum(c).over(within).alias(c) for c in totals]).where("asked").join(carried, ["contig", "bin"])
    run = run.select("contig", "pos", *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in totals])
    met = asks.join(F.broadcast(run) if small else run, ["contig", "pos"])
    out = met.select(*by, *[F.when(F.col("upper"), F.col(f"s_{n}")).otherwise(-F.col(f"e_{n}")).alias(n) for n in names])
    if told["odd"]:
        pairs = overlap_join(left, place.where("end < start"))
        out = out.unionByName(pairs.select(*[F.col(f"r_{c}").alias(c) for c in by], *[v.cast("long").alias(n) for n, v in parts]))
    summed = out.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names]).where("n > 0")
    return summed.select(*by, "n", *[F.when(F.col(f"has_{c}") > 0, F.col(f"sum_{c}")).alias(f"sum_{c}") for c in sums])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common parts of each overlapping pair; sort and merge them for a list."""
    pairs = overlap_join(a.select("contig", "start", "end"), b.select("contig", "start", "end"))
    return pairs.select("contig", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


def subtract(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Pieces of each include interval outside all exclude intervals; pieces aren't merged.

    Of each merged exclude interval that an interval meets comes the piece up to the next one; the first also gives the piece before it.
    """
    w = Window.partitionBy("contig").orderBy("start")
    holes = merge(exclude, ALL).withColumns({"before": F.lag("end").over(w), "after": F.lead("start").over(w)})
    met = overlap_join(include.select("contig", "start", "end"), holes, "left")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    first = F.coalesce(F.col("r_before") < F.col("start"), F.lit(True))
    pieces = F.array(
        F.when(F.col("r_start").isNull(), span(F.col("start"), F.col("end"))),
        F.when(first, span(F.col("start"), F.col("r_start") - 1)),
        span(F.col("r_end") + 1, F.least("end", F.col("r_after") - 1)),
    )
    cut = met.select("contig", F.explode(F.filter(pieces, lambda p: p["start"] <= p["end"])).alias("p"))
    return cut.select("contig", "p.start", "p.end")


def resolve(include: DataFrame | None, exclude: DataFrame | None, contigs: DataFrame, padding: int = 0, exclude_padding: int = 0, rule: str = ALL) -> DataFrame:
    """The intervals of a traversal: include (whole contigs if None), padded and merged, less exclude, padded and merged.

    Raises ValueError if nothing is left.
    """
    if include is None and exclude is None:
        raise ValueError("intervals to include or to exclude are needed")
    inner = whole_reference(contigs) if include is None else merge(pad(include, contigs, padding), rule)
    out = inner if exclude is None else subtract(inner, merge(pad(exclude, contigs, exclude_padding), rule))
    if out.isEmpty():
        raise ValueError("no intervals are left")
    return out


def whole_reference(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.col("name").alias("contig"), F.lit(1).alias("start"), F.col("length").cast("int").alias("end"))


def shards(intervals: DataFrame, length: int) -> DataFrame:
    """Pieces of at most length positions, counted from each interval's start, with shard from 0; other columns kept."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) / length).cast("int")))
    cut = intervals.withColumn("shard", pieces)
    start = F.col("start") + F.col("shard") * length
    return cut.withColumns({"start": start, "end": F.least("end", start + length - 1)})


def loci(intervals: DataFrame) -> DataFrame:
    """(contig, pos): a row for each position of each interval."""
    return intervals.select("contig", F.explode(F.sequence("start", "end")).alias("pos"))


def ordered(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sorted by contig index, start and end; contigs that aren't in the table raise an error."""
    with_idx = intervals.join(F.broadcast(contigs.select(F.col("name").alias("contig"), "idx")), "contig", "left")
    checked = with_idx.withColumn("idx", F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("unknown contig "), F.col("contig"))).cast("int")).otherwise(F.col("idx")))
    return checked.orderBy("idx", "start", "end").drop("idx")


def compare(a_idx: Column, a_start: Column, a_end: Column, b_idx: Column, b_start: Column, b_end: Column) -> Column:
    """-1, 0 or 1 by contig index, start, end."""
    a, b = F.struct(a_idx.alias("i"), a_start.alias("s"), a_end.alias("e")), F.struct(b_idx.alias("i"), b_start.alias("s"), b_end.alias("e"))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def position_against(start: Column, end: Column, q_start: Column, q_end: Column) -> Column:
    """How a record lies to a query interval on its contig: before, after, contained or overlapping."""
    return F.when(end < q_start, "before").when(start > q_end, "after").when((start >= q_start) & (end <= q_end), "contained").otherwise("overlapping")


def novel_features(features: DataFrame, intervals: DataFrame) -> DataFrame:
    """Features by query interval, each given for an interval only if it doesn't overlap the interval before it in the list."""
    w = Window.partitionBy("contig").orderBy("start", "end")
    listed = intervals.select("contig", "start", "end").withColumns({"prev_start": F.lag("start").over(w), "prev_end": F.lag("end").over(w)})
    pairs = overlap_join(features, listed)
    seen = overlaps(F.col("start"), F.col("end"), F.col("r_prev_start"), F.col("r_prev_end"))
    return pairs.where(~F.coalesce(seen, F.lit(False))).drop("r_contig", "r_prev_start", "r_prev_end")


def windows(intervals: DataFrame, contigs: DataFrame, leading: int, trailing: int) -> DataFrame:
    """Adds window_start and window_end: the reference window around each interval, cropped at the contig's ends."""
    sized = intervals.join(F.broadcast(contigs.select(F.col("name").alias("contig"), "length")), "contig")
    return sized.withColumns({"window_start": F.greatest(F.lit(1), F.col("start") - leading), "window_end": F.least(F.col("length"), F.col("end") + trailing)}).drop("length")


def feature_windows(intervals: DataFrame, leading: int, trailing: int) -> DataFrame:
    """Query windows for features: clamped at 1 before, unclamped behind."""
    return intervals.withColumns({"start": F.greatest(F.lit(1), F.col("start") - leading), "end": F.col("end") + trailing})


def parse_text(text: DataFrame, contigs: DataFrame, column: str = "text") -> DataFrame:
    """Adds contig, start, end from `name`, `name:p`, `name:a-b` or `name:a+`, with commas allowed in numbers.

    A text may be read with its whole as the contig or with what precedes the last colon; both being contigs is ambiguous. reason says why a
    row has no interval: unknown, ambiguous or invalid.
    """
    names = F.broadcast(contigs.select("name", "length"))
    t = F.trim(F.col(column))
    head = F.regexp_extract(t, r"^(.*):([0-9,]+)(\+|-[0-9,]+)?$", 1)
    first = F.regexp_replace(F.regexp_extract(t, r"^(.*):([0-9,]+)(\+|-[0-9,]+)?$", 2), ",", "").try_cast("int")
    rest = F.regexp_extract(t, r"^(.*):([0-9,]+)(\+|-[0-9,]+)?$", 3)
    out = text.join(names.toDF("__whole", "__whole_length"), t == F.col("__whole"), "left").join(names.toDF("__head", "__head_length"), head == F.col("__head"), "left")
    both = F.col("__whole").isNotNull() & F.col("__head").isNotNull()
    end = F.when(F.col("__whole").isNotNull(), F.col("__whole_length")).when(rest == "", first).when(rest == "+", F.col("__head_length")).otherwise(F.regexp_replace(rest, "[-,]", "").try_cast("int"))
    start = F.when(F.col("__whole").isNotNull(), F.lit(1)).otherwise(first)
    out = out.withColumns({"contig": F.coalesce("__whole", "__head"), "start": start.cast("int"), "end": end.cast("int")})
    reason = F.when(both, "ambiguous").when(F.col("contig").isNull(), "unknown").when(~F.coalesce(is_valid(F.col("start"), F.col("end")), F.lit(False)), "invalid")
    out = out.withColumn("reason", reason).drop("__whole", "__whole_length", "__head", "__head_length")
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("contig", "start", "end")})
