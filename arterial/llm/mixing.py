"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of all characters over the characters that it
has. A document's number of copies is the inverse of the Poisson distribution with
that mean at a uniform number made from a hash of seed, id and text: rerunning a lost
task gives the same copies, and copies need no coordination. Large means are split into
parts of at most 32, each with a hash of its own, so exp() can't underflow.

A null source is the source ''; a null text has no characters and is drawn like any
other, also if it is empty or very long. Rows that agree in id and text draw the same
number and tie in order_key. A source with no characters has the rate 0. An empty table
stays empty. Other columns may have any name.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import pieces
from .frames import whole_row

PART = 32
MAX_BROADCAST_SOURCES = 10_000
#: Weights of the check queries; a source that isn't named has the weight 1.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint")
    return (digits.cast("double") + 0.5) / float(1 << 52)


def rates(df: DataFrame, weights: Mapping[str, float], text: str = "text", source: str = "source", default: float = 1.0) -> DataFrame:
    """(src, rate): the mean number of copies of a document of each source."""
    sizes = df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("src")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("chars"))
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("src") == name, float(w)).otherwise(weight)
    weighed = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = weighed.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") * F.col("all_chars")
    return weighed.crossJoin(total).select("src", F.when(F.col("chars") > 0, share / (F.col("all_weight") * F.col("chars"))).otherwise(0.0).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ..., far enough for 52 bits."""
    top = (mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def mix_sources(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source", default: float = 1.0) -> DataFrame:
    """df's columns plus copy (0, 1, ...) and order_key; dealt out at random, sorted by order_key in each partition.

    Sorting everything by order_key gives one global random order; columns of df with
    these names are replaced. Rates are broadcast up to 10,000 sources, else joined.
    """
    df = df.drop("copy", "order_key")
    of_source = F.coalesce(F.col(source), F.lit(""))
    table = rates(df, weights, text, source, default).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    table = table.withColumn("cdf", _distribution(F.col("rate") / F.col("parts"))).select("src", "parts", "cdf")
    if df.select(of_source).distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = df.select(whole_row(df), name.alias("name"), of_source.alias("own")).join(table, F.col("own") == F.col("src"))
    # the draw stands outside the lambda over the distribution, else each of its entries would hash anew
    draw = lambda n, j: n + F.aggregate(F.col("cdf"), F.struct(_uniform(F.col("name"), j.cast("string")).alias("u"), F.lit(0).alias("n")), lambda a, c: F.struct(a["u"].alias("u"), (a["n"] + (c < a["u"]).cast("int")).alias("n")), lambda a: a["n"])
    counted = rows.select("row", "name", F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), draw).alias("n")).where("n > 0")
    copies = counted.select("row", "name", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    copies = copies.select("row.*", "copy", F.md5(F.concat_ws("|", F.lit("order"), "name", F.col("copy").cast("string"))).alias("order_key"))
    return copies.repartition(pieces(df), "order_key").sortWithinPartitions("order_key")


def oracle(weights: Mapping[str, float] = WEIGHTS, seed: int = 0, default: float = 1.0, relation: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    weight = "CASE " + " ".join(f"WHEN src = '{s}' THEN {float(w)!r}::DOUBLE" for s, w in weights.items()) + f" ELSE {float(default)!r}::DOUBLE END" if weights else f"{float(default)!r}::DOUBLE"
    return f"""
    WITH RECURSIVE sizes AS (SELECT coalesce(source, '') src, sum(coalesce(length(text), 0))::DOUBLE chars FROM {relation} GROUP BY 1),
    weighed AS (SELECT src, chars, CASE WHEN chars > 0 THEN {weight} ELSE 0::DOUBLE END weight FROM sizes),
    rated AS (SELECT src, CASE WHEN chars > 0 THEN weight * (SELECT sum(chars) FROM weighed) / ((SELECT sum(weight) FROM weighed) * chars) ELSE 0::DOUBLE END rate FROM weighed),
    parted AS (SELECT src, greatest(ceil(rate / {PART}), 1)::INT parts, rate / greatest(ceil(rate / {PART}), 1)::INT mean FROM rated),
    cdf AS (SELECT src, parts, mean, 0 k, exp(-mean) p, exp(-mean) s FROM parted
            UNION ALL SELECT src, parts, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) FROM cdf WHERE k + 1 <= floor(mean + 12 * sqrt(mean) + 20)),
    named AS (SELECT *, '{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS name, coalesce(source, '') src,
                     row_number() OVER () rid FROM {relation}),
    draws AS (SELECT rid, src, name, j, (('0x' || substr(md5(name || '|' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 u
              FROM (SELECT rid, src, name, unnest(range(1, parts + 1)) j FROM named JOIN parted USING (src))),
    counted AS (SELECT rid, sum(n) n FROM (SELECT rid, j, count(*) n FROM draws JOIN cdf ON draws.src = cdf.src AND cdf.s < draws.u GROUP BY rid, j) GROUP BY rid),
    copied AS (SELECT rid, unnest(range(0, n::INT))::INT copy FROM counted)
    SELECT doc_id, text, lang, source, n_chars, copy, md5('order|' || name || '|' || copy) AS order_key FROM copied JOIN named USING (rid)"""
