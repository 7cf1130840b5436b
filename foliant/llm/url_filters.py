"""URL filters: host and path rules first, then a weighted vocabulary.

A rule names a host and a path prefix; it fits its host and all subdomains where the
path starts with the rule's, and the longest fitting rule decides. Other URLs are judged by
terms that an Aho-Corasick automaton finds in the lower-cased URL: a term counts only where
no ASCII letter or digit stands on either side of it. One strict term blocks, as do distinct
soft terms whose weights reach the limit.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is judged by its terms (null: none, allowed); repeated terms count once; an empty table
gives an empty result; rows keep their extra columns, but for those named like the result's.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.columns import Apart

#: (rule, verdict): the host up to the first slash, the path from there.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: One of these blocks.
STRICT = ["porn", "xxx", "hentai", "sexcam", "warez", "malware", "phishing", "cracked", "keygen", "escort"]
#: Weights of terms that block only together.
SOFT = {
    "casino": 2, "poker": 2, "betting": 2, "slots": 1, "jackpot": 1, "adult": 2, "nude": 2, "dating": 1, "loan": 1,
    "payday": 2, "pills": 1, "pharmacy": 1, "torrent": 2, "download": 1, "free": 1, "cheap": 1, "replica": 2, "track": 1,
}
SOFT_LIMIT = 3
SOFT_DISTINCT = 2


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in (*((t, 0) for t in strict), *soft):
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def _is_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms that stand in a URL between boundaries."""
    found: tuple[set[str], set[str]] = (set(), set())
    low = url.translate(_TO_LOWER)
    for end, (term, weight) in _automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (start == 0 or not _is_word(low[start - 1])) and (end + 1 == len(low) or not _is_word(low[end + 1])):
            found[weight > 0].add(term)
    return found


def vocabulary_counts(url: Column, strict: list[str] | None = None, soft: dict[str, int] | None = None) -> Column:
    """struct<n_strict, n_soft, soft_weight> of a URL column: distinct terms and their weight."""
    strict_terms = tuple(STRICT if strict is None else strict)
    soft_terms = tuple((SOFT if soft is None else soft).items())
    weights = dict(soft_terms)

    @F.pandas_udf("n_strict bigint, n_soft bigint, soft_weight bigint")
    def count(urls: pd.Series) -> pd.DataFrame:
        hits = [term_hits(u or "", strict_terms, soft_terms) for u in urls]
        return pd.DataFrame({"n_strict": [len(a) for a, _ in hits], "n_soft": [len(b) for _, b in hits], "soft_weight": [sum(weights[t] for t in b) for _, b in hits]}, dtype="int64")

    return count(url)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", group), F.lit(""))


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in reversed(ordered):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_filter(df: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict, n_strict, n_soft and soft_weight. One narrow pass."""
    made = ["host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"]
    own = Apart(df.select(*[c for c in df.columns if c not in made or c == url_col]))
    url = F.col(own[url_col])
    hosts = F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = own.df.select("*", hosts.alias("_host"), _part(url, 2).alias("_path"), vocabulary_counts(url).alias("_terms"))
    ruled = parts.withColumn("_rule", rule_match(F.col("_host"), F.col("_path"), rules))
    by_terms = F.when((F.col("_terms.n_strict") > 0) | ((F.col("_terms.n_soft") >= SOFT_DISTINCT) & (F.col("_terms.soft_weight") >= SOFT_LIMIT)), "block").otherwise("allow")
    found = [F.col("_host"), F.col("_path"), F.col("_rule.rule"), F.coalesce(F.col("_rule.verdict"), by_terms), *[F.col(f"_terms.{c}") for c in made[4:]]]
    return own.back(ruled, dict(zip(made, found, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: one row for each row of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).drop("url")


def oracle() -> str:
    hit = "CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN {} ELSE 0 END"
    strict = " + ".join(hit.format(t, 1) for t in STRICT)
    soft = " + ".join(hit.format(t, 1) for t in SOFT)
    weight = " + ".join(hit.format(t, w) for t, w in SOFT.items())
    cases = {"rule": "", "verdict": ""}
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        h, _, rest = rule.partition("/")
        for k, v in (("rule", rule), ("verdict", verdict)):
            cases[k] += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}') THEN '{v}'"
    a_z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), {a_z}) AS host,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, translate(coalesce(url, ''), {a_z}) AS low FROM pages),
     t AS (SELECT page_id, host, path, CAST({strict} AS BIGINT) AS n_strict, CAST({soft} AS BIGINT) AS n_soft, CAST({weight} AS BIGINT) AS soft_weight FROM u)
SELECT page_id, host, path, CASE {cases["rule"]} END AS rule,
       CASE {cases["verdict"]} WHEN n_strict > 0 OR (n_soft >= {SOFT_DISTINCT} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft, soft_weight
FROM t"""
