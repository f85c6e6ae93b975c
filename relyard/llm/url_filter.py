"""URL filter: host and path rules first, a weighted vocabulary for the rest.

``judge(pages)`` needs ``page_id`` and ``url`` and returns one row per input row:
page_id, host, path, rule, verdict, n_strict, n_soft.

* Rules are exact statements about a host with its subdomains and a path prefix; the longest fitting one decides.
* Without a rule, one Aho-Corasick automaton finds all vocabulary terms in the lower-cased url in one pass. A hit counts
  only where no ASCII letter or digit touches it. One strict term blocks, or ``soft_limit`` distinct soft terms.

Defined cases: a null url, or one without ``://``, has an empty host and path, so no rule; the vocabulary still looks
at the whole url, and a null or empty url is allowed. Repeated rows are judged alike, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Vocabulary, fixed values: a strict term blocks alone, soft ones only together.
STRICT_TERMS = ("casino", "cialis", "escort", "escorts", "hentai", "malware", "phishing", "porn", "porno", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "adult", "bet", "bonus", "cheap", "crack", "deals", "download", "farm", "free", "keygen", "loan", "loans", "pharmacy",
    "pills", "poker", "sex", "slots", "torrent", "win",
)
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Host rules of the page table, fixed values.
PAGE_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path: after the first ``://`` up to ``/ ? #``, then up to ``? #``."""
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    return (
        pages.select(pages["page_id"], url.alias("url"))
        .withColumn("after", after)
        .select(
            "page_id",
            "url",
            ascii_lower(F.regexp_extract("after", r"^[^/?#]*", 0)).alias("host"),
            F.regexp_extract("after", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )


def rule_choice(rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits host and path; null where none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, terms in enumerate((soft, strict)):
        for term in terms:
            made.add_word(term, (term, kind))
    made.make_automaton()
    return made


def term_hits(url: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms that stand alone in a lower-cased url."""
    hits: tuple[set, set] = (set(), set())
    if found.kind == ahocorasick.AHOCORASICK:
        for last, (term, kind) in found.iter(url):
            before, after = last - len(term), last + 1
            if (before < 0 or not _touches(url[before])) and (after == len(url) or not _touches(url[after])):
                hits[kind].add(term)
    return len(hits[1]), len(hits[0])


def _touches(char: str) -> bool:
    return char.isascii() and char.isalnum()


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = PAGE_RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    terms = (tuple(strict), tuple(soft))

    @F.pandas_udf("struct<n_strict: int, n_soft: int>")
    def count_terms(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(*terms)
        for batch in urls:
            yield pd.DataFrame([term_hits(url, found) for url in batch], columns=["n_strict", "n_soft"], dtype="int32")

    judged = with_host_and_path(pages).withColumn("hits", count_terms(ascii_lower(F.col("url"))))
    by_terms = F.when((F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= soft_limit), "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        rule_choice(rules, lambda r: r.text).alias("rule"),
        F.coalesce(rule_choice(rules, lambda r: r.verdict), by_terms).alias("verdict"),
        F.col("hits.n_strict").alias("n_strict"),
        F.col("hits.n_soft").alias("n_soft"),
    )


def oracle() -> str:
    """The same verdicts with one regular expression per term."""

    def alone(term: str) -> str:
        return f"(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)'))::int"

    def cases(value) -> str:
        ordered = sorted(PAGE_RULES, key=lambda r: -len(r.text))
        whens = (
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered
        )
        return "CASE " + " ".join(whens) + " END"

    strict, soft = " + ".join(map(alone, STRICT_TERMS)), " + ".join(map(alone, SOFT_TERMS))
    return f"""
    WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
                      CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    h AS (SELECT *, {strict} AS n_strict, {soft} AS n_soft, {cases(lambda r: r.text)} AS rule, {cases(lambda r: r.verdict)} AS by_rule FROM p)
    SELECT page_id, host, path, rule,
           coalesce(by_rule, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
           n_strict, n_soft FROM h"""
