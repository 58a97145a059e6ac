"""Quality rules: counts within a document, and line frequency across documents.

Everything here is DataFrame functions; no Python runs on the executors.

Cross-document rule: lines are normalised (A-Z lower-cased, digits to 0, white space
dropped) and hashed; for each host the distinct texts that hold a line are counted:
exact copies of a document count once, else every line of a text with enough copies
would be frequent, and near-duplicate removal, not this rule, decides on copies. Lines
above the host's limit are frequent: they are removed, and a document that loses too
much, or keeps too little, is rejected.

Null text counts as empty, a null host as the host ''. Rows that repeat a doc_id are
judged each by its own text and host; fully repeated rows give repeated results, and
rows whose counts tie with a limit are within it. Texts of any length are read whole.
An empty table gives an empty result. Other columns may have any name.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import quoted, whole_row

WHITE = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: A line is frequent in a host if more than min_line_texts distinct texts hold it, and more than max_line_percent of the host's or than max_line_texts.
    min_line_texts: int = 10
    max_line_percent: int = 2
    max_line_texts: int = 10_000
    #: A document is depleted if it loses a greater share of its words, or keeps fewer words than min_words.
    max_lost_percent: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def squeezed(text: Column) -> Column:
    return F.translate(text, " " + WHITE, "")


def repeated_words(words: Column, k: int = 5) -> Column:
    """How many words lie in a k-word window that is found twice or more."""

    def windows(hashes: Column) -> Column:
        many = F.size(hashes) >= k
        return F.when(many, F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, k))))).otherwise(F.array().cast("array<bigint>"))

    def covered(sorted_windows: Column) -> Column:
        same = lambda x, i, d: F.coalesce(x["h"] == F.get(sorted_windows, i + d)["h"], F.lit(False))
        places = F.filter(F.transform(sorted_windows, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["p"])), lambda p: p.isNotNull())
        start = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(k), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), count)).cast("bigint")


def base_counts(text: Column) -> Column:
    """A struct of the counts of a text (no nulls)."""
    return let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(squeezed(text)).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        ),
    )


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.translate(line, UPPER + "0123456789 " + WHITE, LOWER + "0" * 10))


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: squeezed(x) != "")


def _lines_and_counts(docs: DataFrame) -> DataFrame:
    """A row for each line that has a word, and a last one for the document itself, which carries its counts (m).

    The text stays behind: beside the exploded lines it would be copied once for each of them.
    """
    none = F.lit(None).cast(f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>")
    row = lambda line, words, doc, m: F.struct(line.alias("line"), words.cast("bigint").alias("words"), F.lit(doc).alias("doc"), m.alias("m"))
    each = F.transform(_lines(F.col("t")), lambda x: row(line_hash(x), F.size(words_of(x)), 0, none))
    last = F.array(row(F.col("th"), F.lit(0), 1, base_counts(F.col("t"))))
    return docs.select("doc_id", "host", "th", F.explode(F.concat(each, last)).alias("x")).select("doc_id", "host", "th", "x.*")


def _prepared(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), t.alias("t"), F.xxhash64(t).alias("th"))


def frequent_lines(df: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(host, line, texts): the lines above their host's limit."""
    docs = _prepared(df, doc_id, text, host)
    each = docs.select("host", "th", F.explode(F.array_distinct(F.transform(_lines(F.col("t")), line_hash))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count_distinct("th").alias("texts")).where(F.col("texts") > limits.min_line_texts)
    hosts = docs.groupBy("host").agg(F.count_distinct("th").alias("host_texts"))
    return counted.join(hosts, "host").where((F.col("texts") * 100 > F.col("host_texts") * limits.max_line_percent) | (F.col("texts") > limits.max_line_texts)).select("host", "line", "texts")


def quality_rules(df: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, kept, lost_words, frequent (hashes of its frequent lines), host and th (the text's hash): one row a document."""
    docs = _prepared(df, doc_id, text, host)
    hot = frequent_lines(df, limits, doc_id, text, host).select("host", "line", F.lit(True).alias("hot"))
    is_hot = F.coalesce("hot", F.lit(False)) & (F.col("doc") == 0)
    per = _lines_and_counts(docs).join(hot, ["host", "line"], "left").groupBy("doc_id", "host", "th")
    per = per.agg(F.sum(F.when(is_hot, F.col("words")).otherwise(0)).alias("lost"), F.collect_set(F.when(is_hot, F.col("line"))).alias("frequent"), F.sum("doc").alias("copies"), *(F.max(f"m.{c}").alias(c) for c in COUNTS))
    per = per.withColumn("lost_words", F.expr("lost div copies")).withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")))
    depleted = (100 * F.col("lost_words") > limits.max_lost_percent * F.col("n_words")) | (F.col("n_words") - F.col("lost_words") < limits.min_words)
    per = per.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *COUNTS, "base_failed", "kept", "lost_words", "frequent", "host", "th")


def without_frequent_lines(df: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents, all their columns, the text without its frequent lines."""
    verdicts = quality_rules(df, limits, doc_id, text, host).where("kept").select("doc_id", "host", "th", "frequent").dropDuplicates(["doc_id", "host", "th"])
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(host), F.lit("")).alias("own_host"), F.xxhash64(t).alias("own_th"), whole_row(df))
    joined = rows.join(verdicts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own_host") == F.col("host")) & (F.col("own_th") == F.col("th")))
    own = F.col("row")[text]
    left = F.array_join(F.filter(F.split(own, "\n"), lambda x: (squeezed(x) == "") | ~F.array_contains("frequent", line_hash(x))), "\n")
    return joined.select(F.col("row").withField(quoted(text), F.when(F.size("frequent") == 0, own).otherwise(left)).alias("row")).select("row.*")


def oracle(limits: Limits = Limits()) -> str:
    """The same over the table documents, in DuckDB's SQL; lines by their text instead of a hash."""
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = lambda x: f"list_filter(string_split(translate({x}, {white}, '     '), ' '), lambda w: w <> '')"
    bare = lambda x: f"translate({x}, ' ' || {white}, '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(source, '') host, coalesce(text, '') t FROM documents),
    w AS (SELECT *, {words("t")} ws, list_filter(string_split(t, chr(10)), lambda x: {bare("x")} <> '') ls FROM d),
    g AS (SELECT rid, i, list_slice(ws, i, i + 4) gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) i FROM w WHERE len(ws) >= 5)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) n FROM g) WHERE n > 1),
    rep AS (SELECT rid, count(DISTINCT i + j) n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(j) GROUP BY rid),
    base AS (SELECT rid, doc_id, host, t, len(ws)::BIGINT n_words, length({bare("t")})::BIGINT word_chars,
                    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT n_symbols,
                    (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words
             FROM w LEFT JOIN rep USING (rid)),
    lines AS (SELECT rid, host, t, translate(x, '{UPPER}0123456789 ' || {white}, '{LOWER}0000000000') line, len({words("x")}) n
              FROM (SELECT rid, host, t, unnest(ls) x FROM w)),
    hosts AS (SELECT host, count(DISTINCT t) texts FROM d GROUP BY host),
    hot AS (SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line
            HAVING count(DISTINCT t) > {limits.min_line_texts} AND (count(DISTINCT t) * 100 > any_value(hosts.texts) * {limits.max_line_percent} OR count(DISTINCT t) > {limits.max_line_texts})),
    lost AS (SELECT rid, sum(n) n FROM lines JOIN hot USING (host, line) GROUP BY rid),
    j AS (SELECT base.*, coalesce(lost.n, 0)::BIGINT lost_words,
                 n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed
          FROM base LEFT JOIN lost USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND 100 * lost_words <= {limits.max_lost_percent} * n_words AND n_words - lost_words >= {limits.min_words} AS kept,
           lost_words FROM j"""
