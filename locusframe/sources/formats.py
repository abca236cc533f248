"""Text formats of intervals, variants and sequences as DataFrames, and reads written for pruned scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.scalar import flatten_bases
from locusframe.operators import intervals
from locusframe.operators import reads as rd

#: Positions in a bin of the written layout.
BIN = 1_000_000
REACH = "_reach"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, name) from BED, whose starts count from 0; comment, track and browser lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    f = F.split("value", r"\t")
    return lines.select(f[0].alias("contig"), (f[1].cast("int") + 1).alias("start"), f[2].cast("int").alias("end"), F.get(f, F.lit(3)).alias("name"))


def read_interval_list(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, strand, name) after a header of @ lines; positions count from 1."""
    f = F.split("value", r"\t")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(@|\s*$)"))
    return lines.select(f[0].alias("contig"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), F.get(f, F.lit(3)).alias("strand"), F.get(f, F.lit(4)).alias("name"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, id, ref, alts, qual, filter, info); end follows from INFO's END or the reference bases."""
    f = F.split("value", r"\t")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|\s*$)"))
    raw = lines.select(f[0].alias("contig"), f[1].cast("int").alias("start"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), F.when(f[5] != ".", f[5].cast("double")).alias("qual"), f[6].alias("filter"), F.when(f[7] != ".", F.expr(r"str_to_map(split(value, '\\t')[7], ';', '=')")).alias("info"))
    return raw.withColumn("end", F.coalesce(F.col("info")["END"].cast("int"), F.col("start") + F.length("ref") - 1))


def read_interval_lines(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """Intervals, one to a line; an empty file raises ValueError."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("text"))
    if lines.isEmpty():
        raise ValueError(f"{path} holds no intervals")
    return intervals.parse_text(lines, contigs)


def load_intervals(spark: SparkSession, arguments: list[str], contigs: DataFrame) -> DataFrame:
    """(contig, start, end) of interval arguments: literals, or files by their endings. A literal without an interval raises ValueError."""
    readers = {".bed": read_bed, ".vcf": read_vcf, ".interval_list": read_interval_list, ".list": None, ".intervals": None}
    out, literals = [], []
    for a in arguments:
        ending = next((e for e in readers if a.endswith(e)), None)
        if ending is None:
            literals.append((a,))
        else:
            found = readers[ending](spark, a) if readers[ending] else read_interval_lines(spark, a, contigs)
            out.append(found.select("contig", "start", "end"))
    if literals:
        parsed = intervals.parse_text(spark.createDataFrame(literals, "text string"), contigs)
        for r in parsed.where("reason is not null").collect():
            raise ValueError(f"{r['text']}: {r['reason']}")
        out.append(parsed.select("contig", "start", "end"))
    return intervals.union(*out)


def program_record(known: list[str], name: str, version: str, command: str) -> dict[str, str]:
    """Header entry of a run: an id that no known one has (with .1, .2 and so on if need be), then version and command line."""
    n, taken = 0, set(known)
    while (own := name if not n else f"{name}.{n}") in taken:
        n += 1
    return {"ID": own, "VN": version, "CL": command, "PN": name}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, line, bases): sequence lines numbered within their contig, upper-case with ambiguity codes as N.

    A file is one record of Spark's whole-text reader for each contig, cut at `>`.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    body = F.split("value", r"\r?\n")
    named = records.select(F.split(body[0], r"\s+")[0].alias("contig"), F.filter(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), lambda x: x != "").alias("l"))
    return named.select("contig", F.posexplode("l").alias("line", "b")).select("contig", "line", flatten_bases(F.col("b")).alias("bases"))


def sequence(fasta: DataFrame, contig: str, start: int, end: int) -> str:
    """The bases start to end of a contig. Raises ValueError if it doesn't have them."""
    rows = fasta.where(F.col("contig") == contig)
    joined = rows.groupBy("contig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "bases"))), lambda x: x["bases"]), "").alias("s"))
    got = joined.select(F.substring("s", start, end - start + 1).alias("b")).first()
    if start < 1 or end < start or got is None or len(got["b"]) < end - start + 1:
        raise ValueError(f"{contig}:{start}-{end} is not in the reference")
    return got["b"]


def write_reads(reads: DataFrame, path: str) -> None:
    """Reads by contig and bin, in coordinate order within files, so that interval scans prune folders and row groups.

    Beside them stands how far the reads of each bin reach.
    """
    spark = reads.sparkSession
    keyed = reads.withColumn("bin", F.floor(F.col("start") / BIN).cast("int"))
    keyed.repartition("contig", "bin").sortWithinPartitions("contig", "bin", "start", "name").write.partitionBy("contig", "bin").parquet(path)
    spark.read.parquet(path).groupBy("contig", "bin").agg(F.max(rd.end()).alias("reach")).coalesce(1).write.parquet(f"{path}/{REACH}")


def scan_reads(spark: SparkSession, path: str, contig: str | None = None, start: int = 1, end: int = 2**31 - 1) -> DataFrame:
    """All reads, or those that overlap a span of a contig, from the bins that reach it, however long their reads."""
    out = spark.read.parquet(path)
    if contig is None:
        return out
    known = spark.read.parquet(f"{path}/{REACH}").where((F.col("contig") == contig) & (F.col("reach") >= start) & (F.col("bin") <= end // BIN))
    bins = [r["bin"] for r in known.select("bin").collect()]  # a contig's bins
    return out.where((F.col("contig") == contig) & F.col("bin").isin(bins) & (F.col("start") <= end) & (rd.end() >= start))


def unmapped_tail(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("ref_idx") == rd.NO_REFERENCE)
