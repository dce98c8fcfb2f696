"""URL filters: rules are indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only those run.

A rule is a regular expression over host + path with the literal tokens (runs of 0-9 and a-z) that any match must
hold whole. How often those tokens occur is counted over all URLs, and each rule is filed under its rarest one.
Two kinds of rules exist: domain rules (`example.net/en/`: host, its subdomains, path prefix; the longest that fits
decides) and glob rules (`*` any text, `^` anything but a letter, digit, `-`, `_`, `.` or the end), which decide
where no domain rule fits. URLs are judged row by row where they are scanned; nothing is shuffled but token counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.catalogue import Catalogue
from .common import ascii_lower, table

CATALOGUE = Catalogue()
TOKEN = re.compile(r"[0-9a-z]+")
#: The index travels with the tasks; a longer rule list than this is refused rather than shipped unchecked.
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    domain: bool


def domain_rule(name: str, action: str) -> Rule:
    """host/path: fits the host and its subdomains if the URL's path starts with the rule's."""
    host, slash, rest = name.partition("/")
    host, path = host.lower(), slash + rest
    found = [m.group() for m in TOKEN.finditer(host)]
    found += [m.group() for m in TOKEN.finditer(path.lower()) if m.end() < len(path)]
    return Rule(name, action, r"(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?:/|\Z)"), tuple(found), True)


def glob_rule(name: str, action: str) -> Rule:
    """Pattern searched anywhere in host + path, lower-cased; a token next to `*` or an end may be part of a longer one."""
    text = name.lower()
    found = [m.group() for m in TOKEN.finditer(text)
             if 0 < m.start() and m.end() < len(text) and "*" not in (text[m.start() - 1], text[m.end()])]
    body = "".join(".*" if c == "*" else r"(?:[^0-9a-z_.-]|\A|\Z)" if c == "^" else re.escape(c) for c in text)
    return Rule(name, action, body, tuple(found), False)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: str) -> set[str]:
    return set(TOKEN.findall(target))


def token_counts(addresses: DataFrame, wanted: frozenset[str]) -> dict[str, int]:
    """In how many URLs each wanted token occurs, over all rows. As many numbers as wanted tokens reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(_tokens((host + path).lower()) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    rows = addresses.select("host", "path").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


class RuleIndex:
    """Rules by their rarest literal token; those without one are tried on every URL."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.pattern, re.DOTALL))
            if rule.literals:
                self.by_token.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, target: str) -> tuple[str | None, str | None, str | None]:
        """(domain rule, its action, action of the glob rules) for host + path."""
        low = target.lower()
        best: Rule | None = None
        globs: list[str] = []
        for rule, pattern in [*self.always, *(e for t in _tokens(low) for e in self.by_token.get(t, ()))]:
            if not rule.domain:
                if pattern.search(low):
                    globs.append(rule.action)
            elif (best is None or (-len(rule.name), rule.name) < (-len(best.name), best.name)) and pattern.match(target):
                best = rule
        return (best.name, best.action, None) if best else (None, None, "block" if "block" in globs else "allow" if globs else None)


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of pages.

    Null URLs and such without `://` have an empty host and path, which no domain rule fits; they get the default
    unless a glob rule matches the empty text. Of fitting domain rules the longest wins, of equally long ones the
    first by name. Repeated rows are judged alike; other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    if sum(len(r.pattern) + len(r.name) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"the rules take more than {MAX_RULE_BYTES} bytes")
    addresses = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = token_counts(addresses, frozenset(t for r in rules for t in r.literals))
    index = RuleIndex(rules, counts)
    kind = addresses.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rule, action, pattern = index.judge(host + path)
                names.append(rule)
                verdicts.append(action or pattern or default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    return addresses.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


RULES = [
    domain_rule("net/", "block"), domain_rule("example.net/en/", "allow"),
    domain_rule("example.com/de/", "block"), domain_rule("org/fr/", "allow"),
    *(glob_rule(f"^{name}.", "block") for name in ("adult-x", "spam-farm", "cheap-pills", "casino-win", "free-bets")),
    *(glob_rule(f".{name}.", "block") for name in ("adult-x", "spam-farm", "cheap-pills", "casino-win", "free-bets")),
    glob_rule("ads-track", "block"), glob_rule("^ads-track^", "block"),
]

SQL = r"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, h, pre, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fit AS (SELECT DISTINCT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
        FROM (SELECT DISTINCT host, path FROM p), rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE
    WHEN regexp_matches(lower(p.host || p.path), '(^|[^0-9a-z_-])(adult-x|spam-farm|cheap-pills|casino-win|free-bets)\.')
      OR contains(lower(p.host || p.path), 'ads-track') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path
"""


@CATALOGUE.register("op9_url_filter", SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
