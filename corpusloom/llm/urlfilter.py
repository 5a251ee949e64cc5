"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digest and precedence.

Built-in functions only. A url's expressions go no deeper than the deepest rule, which loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number of rows are broadcast; beyond it the join shuffles on the hash prefix.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased. Path: then up to ? # or end. Null or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    host = _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _anchor(path: Column) -> Column:
    """A rule's path up to its last slash: the part that equals some path-prefix expression of every url it fits."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Distinct values of ``url`` with host, path, rule (host and path joined, or null) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains when the url's path starts with the rule's.
    The longest rule (host and path) wins, then the longest host, then block before allow. Equal rules count once, rules with a null
    are ignored; without a fitting rule the verdict is ``default``. An empty rule path fits every path.
    """
    h, p = host_and_path(F.col("_url"))
    seen = urls.select(F.col(url).alias("_url")).distinct().select("_url", h.alias("host"), p.alias("path"))
    rule = rules.select(
        _lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).dropna().distinct()
    rule = rule.withColumn("r_expr", F.concat_ws("\x00", "r_host", _anchor(F.col("r_path"))))
    rule = rule.withColumn("r_digest", F.sha2("r_expr", 256)).drop("r_expr")
    bounds = rule.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.size(F.split(_anchor(F.col("r_path")), "/"))).alias("parts"),
    ).first()
    if not bounds["n"]:
        return seen.select("_url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    size_h, size_p = F.size(labels), F.size(parts)
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(size_h, F.lit(bounds["labels"]))),
        lambda n: F.array_join(F.slice(labels, size_h - n + 1, n), "."),
    )
    # n parts and a slash: as deep as the rules' anchors go; "" is the anchor of a rule without any slash
    prefixes = F.concat(
        F.array(F.lit("")),
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(size_p - 1, F.lit(bounds["parts"] - 1)))),
                lambda n: F.when(n < size_p, F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    expr = F.flatten(F.transform(hosts, lambda a: F.transform(prefixes, lambda b: F.concat(a, F.lit("\x00"), b))))
    wide = seen.select("_url", "host", "path", F.explode(expr).alias("e")).withColumn("digest", F.sha2("e", 256)).drop("e")
    short = rule.withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    short = F.broadcast(short) if bounds["n"] <= BROADCAST_RULES else short
    hit = (
        wide.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
        .join(short, "prefix")
        .where((F.col("digest") == F.col("r_digest")) & F.expr("startswith(path, r_path)"))
    )
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = hit.groupBy("_url").agg(F.max(order).alias("best"))
    return seen.join(best, "_url", "left").select(
        "_url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; repeated rows stay, null urls have empty host and path.

    Each distinct url is judged once; a url that many pages share is split by the adaptive skew join.
    """
    judged = apply_rules(pages.where(F.col("url").isNotNull()), rules, default=default)
    mine = pages.select("page_id", F.col("url").alias("_url"))
    out = mine.join(judged, "_url", "left")
    return out.select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
