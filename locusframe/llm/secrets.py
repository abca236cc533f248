"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import documents

# The base patterns in the order of their kinds, and how long what they find must be. A pattern of a fixed
# length class finds the same as its looser form followed by the test, since its run of characters ends where the looser one's does.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: What the models score: runs of at least so many of these characters.
LEAST = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Log-likelihood ratio, in nats, from which a run counts as random; the mean over its characters must reach the other bound too.
MIN_RATIO = 12.0
MIN_MEAN = 0.45
#: The ordinary model learns words from about so many documents, chosen by a hash of doc_id.
SAMPLE_DOCS = 500
RANDOM_SAMPLES = 2000

# Words that identifiers are made of.
WORDS = (
    "account action active address admin agent alert array async author base batch binary block buffer build button byte cache call case change channel char check child class clean client close code"
    " color column command comment commit config connect content context control copy count create current cursor data date debug default define delete depth detail device digest domain download driver edit element"
    " enable encode engine entry error event example export factory feature field file filter final find first flag format frame function get global graph group handle hash header height helper host image"
    " import index info init input insert instance int item iterator java job join json key kind label language layer layout length level library limit line link list listener load local lock log login loop main"
    " manager map match max memory menu merge message method min mode model module name network new next node null number object offset open option order output owner package page panel parent parse"
    " password path pattern point policy pool port position prefix print process profile project property provider proxy public query queue random range read record reference register remote remove render report request reset"
    " resource response result return role root route row rule run sample save scale schema scope script search secret section select sequence server service session set shared show signal simple single size sort source"
    " space spec stack start state static status step stop storage store stream string style submit suffix support switch sync system table tag target task template test text thread time title token tool total trace type"
    " update upload user util valid value vector version view visible weight width window worker write"
)


def training_samples(docs: DataFrame) -> DataFrame:
    """(text, random): labelled strings. Random ones are digests in several alphabets; ordinary ones are identifiers of
    two to four common words in several spellings, and words of about SAMPLE_DOCS documents.
    """
    spark = docs.sparkSession
    n = F.col("id").cast("string")
    digest = F.unhex(F.sha2(n, 256))
    b64 = F.base64(digest)
    kinds = [b64, F.translate(b64, "+/=", "-_"), F.translate(b64, "+/=", "xK7"), F.substring(F.sha2(n, 256), 1, 40), F.substring(F.upper(F.translate(b64, "+/=", "Q4Z")), 1, 32), F.substring(F.lower(F.translate(b64, "+/=", "q4z")), 1, 32)]
    made = spark.range(RANDOM_SAMPLES, numPartitions=1).select(F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int")).alias("text"), F.lit(True).alias("random"))
    words = F.split(F.lit(WORDS), " ")
    pick = [F.element_at(words, (F.pmod(F.xxhash64(F.lit(i), "id"), F.size(words)) + 1).cast("int")) for i in range(4)]
    take = F.slice(F.array(*pick), 1, (2 + F.col("id") % 3).cast("int"))
    named = spark.range(RANDOM_SAMPLES, numPartitions=1).select(
        F.when(F.col("id") % 4 == 0, F.array_join(take, "_")).when(F.col("id") % 4 == 1, F.array_join(take, "-")).when(F.col("id") % 4 == 2, F.array_join(F.transform(take, F.initcap), "")).otherwise(F.upper(F.array_join(take, "_"))).alias("text"),
        F.lit(False).alias("random"),
    )
    total = docs.count()
    unit = F.xxhash64(F.lit("identifier sample"), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    heard = docs.where(unit < F.lit(min(1.0, SAMPLE_DOCS / max(1, total)))).select(F.explode(F.regexp_extract_all(F.regexp_replace("text", ASSIGN, " "), F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("text"), F.lit(False).alias("random"))
    return made.union(named).union(heard)


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, row by row for ALPHABET with a row for the start.

    samples: (text, random). Counts are smoothed by one; null and empty strings, and null labels, teach nothing.
    """
    at = F.concat(F.lit("^"), "text")
    pairs = samples.where("random is not null and length(text) > 0").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substr(at, i, F.lit(2)))).alias("pair"))
    size = len(ALPHABET)
    counts = {True: [[1.0] * size for _ in range(size + 1)], False: [[1.0] * size for _ in range(size + 1)]}
    for r in pairs.groupBy("random", "pair").count().where(F.col("pair").rlike(r"^[\^A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$")).collect():  # at most the alphabet squared
        counts[r["random"]][ALPHABET.find(r["pair"][0]) + 1][ALPHABET.find(r["pair"][1])] += r["count"]
    return [math.log(a / sum(ra)) - math.log(b / sum(rb)) for ra, rb in zip(counts[True], counts[False]) for a, b in zip(ra, rb)]


def score(run: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string over ALPHABET."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    code = F.lit(ALPHABET)

    def step(total: Column, i: Column) -> Column:
        before = F.when(i > 1, F.instr(code, F.substr(run, i - 1, F.lit(1)))).otherwise(F.lit(0))
        return total + F.element_at(ratios, (before * F.lit(len(ALPHABET)) + F.instr(code, F.substr(run, i, F.lit(1)))).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.length(run)), F.lit(0.0), step)


def _running(sizes: Column) -> Column:
    """Sums of an array up to and including each element, in pieces so that long arrays aren't copied at every step."""
    piece = 128

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("a")), lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"] + x)).alias("a")), lambda s: s["a"])

    pieces = F.transform(F.sequence(F.lit(0), (F.size(sizes) - 1).cast("int"), F.lit(piece)), lambda i: sums(F.slice(sizes, i + 1, F.lit(piece))))
    ends = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<array<bigint>>").alias("a")), lambda s, p: F.struct((s["t"] + F.element_at(p, -1)).alias("t"), F.concat(s["a"], F.array(F.transform(p, lambda x: x + s["t"]))).alias("a")), lambda s: s["a"])
    return F.flatten(ends)


def _matches(df: DataFrame, kind: str, pattern: str, gate: str) -> DataFrame:
    """Adds `kind`: an array of (start, end, group) of all leftmost matches, in code points.

    The lengths of what stands between the matches and of the matches themselves alternate; their running sums are the spans. Only
    texts that pass the gate are split.
    """
    has = F.col("text").rlike(gate)
    out = df.withColumns({"__gaps": F.when(has, F.transform(F.split("text", pattern, -1), F.length)), "__found": F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))})
    if kind == "assign":
        out = out.withColumn("__group", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(2))))
    else:
        out = out.withColumn("__group", F.col("__found"))
    both = F.flatten(F.transform(F.arrays_zip(F.slice("__gaps", F.lit(1), F.size("__found")).alias("g"), F.col("__found").alias("f")), lambda x: F.array(x["g"], F.length(x["f"]))))
    out = out.withColumn("__ends", F.when(F.size("__found") > 0, _running(both.cast("array<bigint>"))))
    span = F.transform(F.sequence(F.lit(1), F.size("__found")), lambda i: F.struct(F.element_at("__ends", 2 * i - 1).alias("start"), F.element_at("__ends", 2 * i).alias("end"), F.element_at("__group", i).alias("group")))
    return out.withColumn(kind, F.when(F.size("__found") > 0, span).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,group:string>>"))).drop("__gaps", "__found", "__group", "__ends")


def find_secrets(docs: DataFrame, table: list[float]) -> DataFrame:
    """docs (any columns, text among them) with n_assign, n_access, n_hex, n_random, base_sha256, spans and values.

    Base spans are the matches of the patterns in the whole text whose secret part is long enough. To these come runs of LEAST or more
    characters, apart from all base spans, that the models take for random. spans joins kind:start:end by start, then in the order
    of KINDS; positions are code points, ends exclusive. values holds the secret parts in that order. Null and empty text has none.
    Columns of docs with these names are replaced.
    """
    results = ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "values", *KINDS)
    own = [c for c in docs.columns if c not in results]
    out = docs.select(*own)
    for kind, pattern, gate in (("assign", ASSIGN, r"(?i:passw|secret|token|api_?key)"), ("access", ACCESS, ACCESS), ("hex", HEX, HEX), ("random", RUN, RUN)):
        out = _matches(out, kind, pattern, gate)
    out = out.withColumn("assign", F.filter("assign", lambda s: F.length(s["group"]) >= ASSIGN_LEAST))

    def ranked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["group"].alias("group")))

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = out.withColumn("__base", F.array_sort(F.concat(*[ranked(k) for k in KINDS[:3]])))
    apart = F.filter("random", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("random", F.when(F.size("random") > 0, apart).otherwise(F.col("random")))
    out = out.withColumn("random", F.when(F.size("random") > 0, F.filter("random", lambda s: score(s["group"], table) >= F.greatest(F.lit(MIN_RATIO), F.length(s["group"]) * F.lit(MIN_MEAN)))).otherwise(F.col("random")))
    out = out.withColumn("__all", F.when(F.size("random") > 0, F.array_sort(F.concat("__base", ranked("random")))).otherwise(F.col("__base")))
    return out.select(*own, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text_of(F.col("__base")), 256).alias("base_sha256"), text_of(F.col("__all")).alias("spans"), F.transform("__all", lambda s: s["group"]).alias("values"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return find_secrets(docs, fit(training_samples(docs))).drop("text", "values")


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
