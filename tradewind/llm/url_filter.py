"""URL allow and block rules by hashed host-suffix and path-prefix expressions (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of the short hash that rules and expressions meet on; the full digest is compared afterwards.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty when it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as rows from ``(verdict, "host/path")`` pairs."""
    rows = [(rule[: rule.index("/")].lower(), rule[rule.index("/") :], rule, verdict) for verdict, rule in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none fits), verdict.

    A rule fits its host and every subdomain when the path begins with the rule's path; the longest
    rule wins, of equally long ones a block rule, then the greater text. Without a fitting rule the
    verdict is ``default``. Every distinct (host, path) is expanded once into host suffixes and path
    prefixes, of the label counts and lengths that occur among the rules; expressions meet rules on a
    short hash prefix and are confirmed by the full digest. Null or malformed URLs have an empty host
    and path and fit no rule. Repeated rows come back repeated, an empty table gives an empty result,
    and other columns of ``pages`` are not read. No rules: every verdict is ``default``.
    """
    # Two short lists: bounded by the longest rule, not by the number of rules or pages.
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.char_length("rule_path"))).alias("lengths"),
    ).first()
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))

    labels = F.split("host", r"\.")
    hosts = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - (n - 1), F.lit(n)), ".")) for n in shape["labels"]]
    paths = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"]]
    expressions = F.array(*[F.concat(h, p) for h in hosts for p in paths]) if hosts else F.array().cast("array<string>")
    digest = F.sha2(F.col("expression").cast("binary"), 256)
    expanded = (
        parts.where(F.col("host") != "")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.array_distinct(F.array_compact(expressions))).alias("expression"))
        .select("host", "path", digest.alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    coded = (
        rules.select("rule", "verdict", F.sha2(F.concat("rule_host", "rule_path").cast("binary"), 256).alias("rule_digest"))
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )
    best = (
        expanded.join(coded, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.char_length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    )
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
