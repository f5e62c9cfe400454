"""Operator 6: secrets in texts, and who owns the values found.  Native functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` whose ``value`` group has ``least`` characters; ``needs``: strings of which a text with a match holds one."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    screen: str | None = None


KEYWORDS = "password|passwd|secret|token|api_?key"
BASE = (
    Kind("assign", rf"""(?i:({KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("=", ":"),
         rf"""(?i:{KEYWORDS})["']?\x20*[:=]"""),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, (), "[0-9a-f]{32}"),
)
MORE = (
    Kind("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, ("eyJ",)),
    Kind("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 25, ("PRIVATE KEY",)),
)
HIT = "array<struct<start:int,kind:int,end:int,value:string>>"


def _hits(text: Column, kind: Kind, number: int) -> Column:
    """Spans of one kind.  The pieces between the matches and the matches themselves give the positions."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value)) if kind.value else whole
    steps = F.zip_with(F.split(text, kind.pattern, -1), F.arrays_zip(whole.alias("w"), value.alias("v")),
                       lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m["w"]).alias("n"), m["v"].alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("hits"))

    def step(done: Column, s: Column) -> Column:
        start = (done["at"] + s["gap"]).cast("int")
        end = (start + F.coalesce(s["n"], F.lit(0))).cast("int")
        hit = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.sha2(s["v"], 256).alias("value"))
        good = s["n"].isNotNull() & (F.char_length(s["v"]) >= kind.least)
        return F.struct(end.alias("at"), F.when(good, F.array_append(done["hits"], hit)).otherwise(done["hits"]).alias("hits"))

    possible = F.lit(True)
    if kind.needs:
        possible = F.lit(False)
        for part in kind.needs:
            possible = possible | F.contains(text, F.lit(part))
    if kind.screen:
        possible = F.when(possible, text.rlike(kind.screen)).otherwise(False)
    return F.when(possible, F.aggregate(steps, zero, step, lambda d: d["hits"])).otherwise(F.array().cast(HIT))


def hits(text: Column, kinds: tuple[Kind, ...] = BASE + MORE) -> Column:
    """All spans of a text, ordered by start, then by kind as listed; value is the SHA-256 of what was found."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_hits(text, kind, number) for number, kind in enumerate(kinds)]))


def listed(spans: Column, kinds: tuple[Kind, ...] = BASE + MORE) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda h: F.concat_ws(":", F.get(names, h["kind"]), h["start"], h["end"])), ",")


def ownership(found: DataFrame, widely: int) -> DataFrame:
    """Per value: documents, repositories, owners and class; ``found`` has value, repository and owner.

    Counts are pre-aggregated by (value, owner, repository), so a value that is copied
    everywhere arrives as one row per repository.  Missing owners count as one owner.
    """
    repositories = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("documents"))
    owners = repositories.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("documents").alias("documents"))
    per = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                      F.sum("documents").alias("documents"))
    return per.withColumn("class", F.when(F.col("owners") >= widely, "example").when(F.col("owners") == 1, "live").otherwise("shared"))


def scanned(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
            kinds: tuple[Kind, ...] = BASE + MORE, widely: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without a hit, rows with hits, and (text_key, classes) of the latter's values.

    Both first frames are ``docs`` with a column ``_hits``, the second also with
    ``_key``, a hash of the text.  ``classes`` maps a value's hash to its class: a value
    of ``widely`` owners or more is an example, of one owner live, else shared.
    """
    rows = docs.withColumn("_hits", hits(F.col(text), kinds))
    without, with_ = rows.where(F.size("_hits") == 0), rows.where(F.size("_hits") > 0).withColumn("_key", F.sha2(F.col(text), 256))
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository])
    found = with_.select("_key", F.col(owner).cast("string").alias("owner"), repo.alias("repository"),
                         F.explode(F.array_distinct(F.transform("_hits", lambda h: h["value"]))).alias("value"))
    owned = found.select("_key", "value").distinct().join(ownership(found, widely).select("value", "class"), "value")
    classes = owned.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("value", "class"))).alias("_classes"))
    return without, with_, classes


def secret_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source",
                repository: tuple[str, ...] = ("source", "lang"), kinds: tuple[Kind, ...] = BASE + MORE, widely: int = 3) -> DataFrame:
    """Spans of every kind per document, each with the class of its value by ownership in the corpus.

    Result: doc_id and spans (array of start, kind, end, value, class), one row per input
    row; a null or clean text has no spans.  Rows with equal texts get equal spans;
    repeated ids and null ids do no harm.  Spans of different kinds may overlap.
    """
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text"), F.col(owner).cast("string").alias("_owner"),
                       F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("_repository"))
    without, with_, classes = scanned(docs, "_text", "_owner", ("_repository",), kinds, widely)
    classed = with_.select("doc_id", "_key", "_hits").join(classes, "_key", "left").select("doc_id", F.transform(
        "_hits", lambda h: F.struct(h["start"], h["kind"], h["end"], h["value"], F.col("_classes")[h["value"]].alias("class"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,class:string>>")
    return classed.unionByName(without.select("doc_id", empty.alias("spans")))


def redacted(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
             kinds: tuple[Kind, ...] = BASE + MORE, widely: int = 3, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret but widely copied examples replaced by ``mark``; overlapping spans become one mark."""
    without, with_, classes = scanned(docs, text, owner, repository, kinds, widely)
    rows = with_.join(classes, "_key", "left")
    bad = F.filter("_hits", lambda h: F.col("_classes")[h["value"]] != "example")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, h: Column) -> Column:
        gap = F.concat(done["out"], F.substr(F.col(text), done["at"] + 1, h["start"] - done["at"]), F.lit(mark))
        out = F.when(h["start"] >= done["at"], gap).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], h["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(bad, zero, step, lambda d: F.concat(d["out"], F.substr(F.col(text), d["at"] + 1)))
    return without.select(docs.columns).unionByName(rows.withColumn(text, clean).select(docs.columns))
