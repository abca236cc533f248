"""Reads, intervals, genotypes and likelihoods made from the star-schema tables by SQL that both engines take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = """
select concat('r', cast(l_orderkey as string), '_', cast(l_partkey % 7 as string)) as name,
 concat('chr', cast(1 + l_suppkey % 5 as string)) as contig,
 cast(case when l_orderkey % 43 = 0 then -1 else l_suppkey % 5 end as int) as ref_idx,
 cast(case when l_orderkey % 41 = 0 then 0 else 1 + (l_partkey*37 + l_orderkey*11 + l_linenumber*101) % 20000 end as int) as start_pos,
 cast((l_orderkey % 2)*1 + (l_partkey % 2)*2 + (case when l_orderkey % 19 = 0 then 4 else 0 end) + (case when l_suppkey % 5 = 0 then 8 else 0 end) + (l_linenumber % 2)*16 + (l_partkey % 3 % 2)*32 + (l_linenumber % 3 % 2)*64
  + (l_partkey % 4 % 2)*128 + (case when l_orderkey % 11 = 0 then 256 else 0 end) + (case when l_partkey % 31 = 0 then 512 else 0 end) + (case when l_orderkey % 23 = 0 then 1024 else 0 end) + (case when l_partkey % 37 = 0 then 2048 else 0 end) as int) as flags,
 cast(case when l_orderkey % 17 = 0 then 255 when l_orderkey % 13 = 0 then 0 else l_quantity end as int) as mapq,
 case l_linenumber % 7 when 0 then '50M' when 1 then '5S45M' when 2 then '20M3I27M' when 3 then '20M4D30M' when 4 then '3H47M3S' when 5 then case when l_partkey % 2 = 0 then '10M100N40M' else '2S3D48M' end else case when l_partkey % 3 = 0 then '10I2D40M' else '*' end end as cigar,
 cast(case when l_partkey % 9 = 0 then -1 else (l_suppkey + l_partkey) % 5 end as int) as mate_ref,
 cast(case when l_partkey % 47 = 0 then 0 else 1 + (l_partkey*41 + l_orderkey*13) % 20000 end as int) as mate_start,
 cast(l_partkey % 800 - 200 as int) as isize,
 substr(repeat('ACGTTGCATTNACGGA', 8), cast(1 + l_partkey % 16 as int), cast(case when l_orderkey % 97 = 0 then 0 when l_orderkey % 29 = 0 then 49 else 50 end as int)) as bases,
 cast(case when l_orderkey % 97 = 0 then 0 when l_partkey % 61 = 0 then 48 when l_orderkey % 29 = 0 then 49 else 50 end as int) as n_quals,
 cast(l_partkey % 40 + 2 as int) as q0,
 case when l_orderkey % 53 = 0 then null when l_orderkey % 59 = 0 then 'rgX' else concat('rg', cast(l_suppkey % 3 as string)) end as rg,
 case when l_partkey % 5 = 0 then null else concat('chr', cast(1 + l_partkey % 3 as string), ',100,+,50M,60,0;') end as oa,
 case when l_partkey % 7 = 0 then null else concat('chr', cast(1 + l_suppkey % 3 as string)) end as xm,
 case l_orderkey % 6 when 0 then '0' when 1 then '2' when 2 then 'x' else null end as od,
 case l_linenumber % 5 when 0 then '0' when 1 then '1' when 2 then '3.5' when 3 then 'abc' else null end as nm
from lineitem
"""
INTERVALS = "select o_orderkey as iv_id, concat('chr', cast(1 + o_custkey % 5 as string)) as contig, cast(1 + (o_orderkey*53) % 20000 as int) as s, cast(20 + (o_orderkey*53) % 20000 + o_custkey % 40 as int) as e from orders"
EXCLUDED = "select o_orderkey as iv_id, concat('chr', cast(1 + o_custkey % 4 as string)) as contig, cast(1 + (o_orderkey*71) % 20000 as int) as s, cast(5 + (o_orderkey*71) % 20000 + o_custkey % 25 as int) as e from orders"
GENOTYPES = "select site, sample, case when site % 8 = 3 and sample = 's1' then '0/1' when site % 16 = 3 and sample = 's0' then '0/1' when site % 8 = 3 then '0/0' when k % 7 = 0 then '1/1' when k % 7 in (1, 2) then '0/1' when k % 7 = 3 then './.' else '0/0' end as gt, cast(case when k % 5 = 0 then null else (k*13) % 60 end as int) as gq, cast((k*7) % 50 as int) as dp, cast(k % 9 as int) as ad0, cast(k % 4 as int) as ad1 from (select cast(o_custkey % 400 as int) as site, concat('s', cast(o_orderkey % 12 as string)) as sample, min(o_orderkey) as k from orders group by 1, 2) t"
LOGLIK = "select site, sample, ev, allele, max(ll) as ll from (select cast(l_partkey % 300 as int) as site, concat('s', cast(l_suppkey % 3 as string)) as sample, l_orderkey as ev, a.allele as allele, cast(0 - ((l_orderkey*7 + l_partkey*3 + a.allele*a.allele*5) % 40) as double) / 10.0e0 as ll from lineitem cross join (select 0 as allele union all select 1 union all select 2) a) t group by 1, 2, 3, 4"
#: Columns that evidence carries besides its likelihoods.
EVIDENCE = [
    "cast((ev*7 + site) % 61 as int) as mapq",
    "(ev % 3 = 0) as is_reverse",
    "cast((ev*13) % 45 as int) as qual",
    "cast((ev*3) % 70 as int) as read_pos",
    "cast(ev % 500 - 100 as int) as isize",
    "cast(ev % 900 as int) as start",
    "cast(ev % 4 as int) as hard_clipped",
    "substr('ACGTN', cast(1 + ev % 5 as int), 1) as base",
    "concat('f', cast(ev % 50 as string)) as name",
    "3 as n_alleles",
    "concat('chr', cast(1 + ev % 2 as string)) as contig",
    "concat('chr', cast(1 + ev % 3 as string)) as oa_contig",
    "(ev % 2 = 0) as is_first",
]
CONTIGS = [(i, f"chr{i + 1}", 20_000) for i in range(5)]


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables or ("lineitem", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTIGS, "idx int, name string, length int")


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, READS, "lineitem")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads in the engine's own schema."""
    raw = raw_reads(spark, sf_dir)
    named = [(t, F.col(c)) for t, c in (("RG", "rg"), ("OA", "oa"), ("XM", "xm"), ("OD", "od"), ("NM", "nm"))]
    entries = F.array(*[F.struct(F.lit(t).alias("key"), F.struct(F.lit("Z").alias("type"), c.alias("text")).alias("value")) for t, c in named])
    tags = F.map_from_entries(F.filter(entries, lambda e: e["value"]["text"].isNotNull()))
    quals = F.when(F.col("n_quals") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_quals") - 1, F.lit(0))), lambda i: (F.col("q0") + i * 7) % 41)).otherwise(F.array().cast("array<int>"))
    return raw.select("name", "flags", "ref_idx", "contig", F.col("start_pos").alias("start"), "mapq", "cigar", "mate_ref", "mate_start", "isize", "bases", quals.alias("quals"), tags.alias("tags"))


def intervals(spark: SparkSession, sf_dir: str, sql: str = INTERVALS) -> DataFrame:
    return view(spark, sf_dir, sql, "orders").select("iv_id", "contig", F.col("s").alias("start"), F.col("e").alias("end"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, GENOTYPES, "orders")
    gt = F.transform(F.split("gt", "/"), lambda a: F.when(a == ".", -1).otherwise(a.try_cast("int")))
    return g.select("site", "sample", gt.alias("gt"), F.array("ad0", "ad1").alias("ad"), F.array().cast("array<int>").alias("pl"), "gq", "dp")


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LOGLIK, "lineitem")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locusframe.operators.likelihood import best_alleles

    return best_alleles(likelihoods(spark, sf_dir)).selectExpr("site", "sample", "ev", "best", "best_ll", "is_informative", *EVIDENCE)
