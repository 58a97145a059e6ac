"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A strict term rejects at once; soft terms reject when enough distinct ones occur.
A term counts only where no ASCII letter or digit touches it, so ``casino`` isn't
found in ``casinolike``; matching ignores the case of A-Z. A null url, and one
without ``://``, has an empty host and path and fits no rule; the vocabulary is
still looked up in its text (null: nothing to find, allowed).
"""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. pattern: host, then path from its first slash on."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)
STRICT = ("adult", "casino", "escort", "porn", "viagra", "warez", "xxx")
SOFT = ("bet", "bonus", "cheap", "crack", "dating", "free", "hot", "loan", "pills", "poker", "sale", "sexy", "win")
MIN_SOFT = 2


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits a host or its parent domains, and its verdict; nulls where none fits."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern, verdict = F.when(fits, rule.pattern).otherwise(pattern), F.when(fits, rule.verdict).otherwise(verdict)
    return pattern, verdict


def _term_counter(strict: Sequence[str], soft: Sequence[str], column: int):
    def count(batches: Iterable[pa.RecordBatch]):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(dict.fromkeys([*strict, *soft])):
            automaton.add_word(term, (i, len(term), term in set(strict)))
        if len(automaton):
            automaton.make_automaton()
        alnum = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for batch in batches:
            strict_hits, soft_hits = [], []
            for url in batch.column(column).to_pylist():
                hard, weak = set(), set()
                url = (url or "").translate(lower)
                for end, (i, n, is_strict) in automaton.iter(url) if len(automaton) else ():
                    left, right = end - n, end + 1
                    if (left < 0 or url[left] not in alnum) and (right >= len(url) or url[right] not in alnum):
                        (hard if is_strict else weak).add(i)
                strict_hits.append(len(hard))
                soft_hits.append(len(weak))
            columns = [*batch.columns, pa.array(strict_hits, pa.int32()), pa.array(soft_hits, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "strict_hits", "soft_hits"])

    return count


def url_filter(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """df plus host, path, rule, strict_hits, soft_hits (distinct terms) and verdict (allow or block).

    Columns of df that bear one of these names are replaced. No shuffle, one pass.
    """
    added = ("host", "path", "rule", "strict_hits", "soft_hits", "verdict")
    df = df.drop(*(c for c in added if c != url))
    schema = T.StructType([*df.schema.fields, T.StructField("strict_hits", T.IntegerType()), T.StructField("soft_hits", T.IntegerType())])
    counted = df.mapInArrow(_term_counter(tuple(strict), tuple(soft), df.columns.index(url)), schema)
    counted = counted.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rejected = (F.col("strict_hits") >= 1) | (F.col("soft_hits") >= min_soft)
    return counted.withColumn("rule", rule).withColumn("verdict", F.coalesce(ruled, F.when(rejected, "block").otherwise("allow")))


def oracle(rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT) -> str:
    """The same over the table pages, in DuckDB's SQL."""
    found = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t.replace('.', '[.]')}([^a-z0-9]|$)')::INT"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    return f"""
    WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') u,
                      translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path FROM pages),
    q AS (SELECT *, ({" + ".join(map(found, strict))})::INT strict_hits, ({" + ".join(map(found, soft))})::INT soft_hits,
                 {case(lambda r: r.pattern)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hits >= 1 OR soft_hits >= {min_soft} THEN 'block' ELSE 'allow' END) AS verdict,
           strict_hits, soft_hits FROM q"""
