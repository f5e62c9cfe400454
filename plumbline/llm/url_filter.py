"""Operator 2: verdicts on URLs by rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains if the path begins with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path) or '(?:/|\\Z)'}"

    def tokens(self) -> list[str]:
        """Labels of the host and whole segments of the path, as far as they are surely tokens of a fitting URL."""
        whole = re.split(r"[^a-z0-9]+", self.host) + re.split(r"[^a-z0-9]+", self.path)[:-1]
        return [t for t in whole if t]


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the lower-cased URL: ``*`` is any text, ``^`` a character that is no letter, digit or one of ``_-.%``, or the end."""

    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    def regex(self) -> str:
        parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
        return "(?s)" + "".join(parts.get(c) or re.escape(c) for c in self.pattern.lower())

    def tokens(self) -> list[str]:
        text = self.pattern.lower()
        return [m[0] for m in re.finditer(TOKEN, text)
                if m.start() and m.end() < len(text) and text[m.start() - 1] != "*" and text[m.end()] != "*"]


#: What decides where no site rule fits: the first listed pattern, else the URL is allowed.
PATTERNS = (
    PatternRule("block", "/casino/"), PatternRule("block", "/wp-login.php"), PatternRule("block", ".doubleclick.net^"),
    PatternRule("block", "^sessionid="), PatternRule("block", "/ads/*banner"),
)
RULES_A_PASS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(pages: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each of the given tokens; no more rows than tokens reach the driver."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)] or [("",)], "token string")
    held = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.col(url), UPPER, LOWER), F.lit(TOKEN), F.lit(0)))).alias("token"))
    return {r["token"]: r["n"] for r in held.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    """Rules by their rarest token; those without a sure token are tried on every URL."""

    def __init__(self, rules: list[tuple[int, object]], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, str, str, re.Pattern]]] = {}
        self.always: list[tuple[int, str, str, re.Pattern]] = []
        for number, rule in rules:
            entry = number, rule.name, rule.action, re.compile(rule.regex())
            tokens = sorted(set(rule.tokens()), key=lambda t: (counts.get(t, 0), t))
            (self.by_token.setdefault(tokens[0], []) if tokens else self.always).append(entry)

    def fitting(self, tokens: set[str], subject: str) -> list[tuple[int, str, str]]:
        candidates = [*self.always, *(e for t in tokens & self.by_token.keys() for e in self.by_token[t])]
        return [(number, name, action) for number, name, action, regex in candidates if regex.search(subject)]


def url_filter(pages: DataFrame, sites: tuple[SiteRule, ...], patterns: tuple[PatternRule, ...] = PATTERNS,
               id: str = "page_id", url: str = "url", default: str = "allow", rules_a_pass: int = RULES_A_PASS) -> DataFrame:
    """Judge every URL: the longest site rule that fits, else the first pattern rule, else ``default``.

    Rules are indexed by the token that the fewest URLs hold.  A URL's tokens fetch
    candidate rules, and only those run regular expressions.  A rule set over
    ``rules_a_pass`` takes several passes, which hand on the best rule so far.

    Result: page_id, host, path, rule (the site rule, or null), verdict, pattern (the
    pattern rule that decided, or null).  One row per input row; repeated rows and missing
    ids stay.  A null URL or one without ``://`` has an empty host and path, and is judged
    by patterns only.  An empty table gives no rows; other columns are ignored.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"),
                        *[F.lit(None).cast(kind).alias(name) for name, kind in (("rule", "string"), ("action", "string"), ("pattern", "string"), ("p_action", "string"))])
    rules = [*enumerate(sites), *enumerate(patterns)]
    counts = token_counts(pages, url, {t for _, r in rules for t in r.tokens()})
    for first in range(0, len(rules), rules_a_pass):
        part = rules[first : first + rules_a_pass]
        mine = [[e for e in part if isinstance(e[1], kind)] for kind in (SiteRule, PatternRule)]

        def judge(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            site_index, pattern_index = Index(mine[0], counts), Index(mine[1], counts)
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    text = (row["url"] or "").translate(str.maketrans(UPPER, LOWER))
                    tokens = set(re.findall(TOKEN, text))
                    site = row["host"] + row["path"]
                    fits = site_index.fitting(tokens | set(re.findall(TOKEN, row["host"])), site) if row["host"] else []
                    for _, name, action in sorted(fits):
                        if row["rule"] is None or len(name) > len(row["rule"]):
                            row["rule"], row["action"] = name, action
                    if row["pattern"] is None:
                        for _, name, action in sorted(pattern_index.fitting(tokens, text))[:1]:
                            row["pattern"], row["p_action"] = name, action
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

        rows = rows.mapInArrow(judge, rows.schema)
    verdict = F.coalesce("action", "p_action", F.lit(default))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"))
