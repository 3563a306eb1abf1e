"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(digest: str) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path); for lists too long for the driver, bring a DataFrame of these columns."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """Judges every url of pages by the longest rule that fits it.

    Adds host, path, rule and verdict to all rows of pages and keeps their number; columns of
    these names that pages has already are replaced. A rule (verdict, host, path) fits its host
    and all subdomains, and every path that starts with its path. The longest of the fitting rules (host and path together) wins; between
    equal lengths the longer host, then `block`. Null urls and urls
    without `://` have an empty host and path, so no rule fits them. A rule with a null or empty
    host or path, or a null verdict, fits nothing. Urls that no rule fits get `otherwise`.

    Each distinct (host, path) is expanded into its host suffixes joined with its path prefixes: those that end in `/`,
    and those as long as a rule's path that ends otherwise; none deeper or longer than the rules are, as they can equal none. The expressions meet the rules on
    the first 32 bits of their SHA-256; the full digests decide. Only the different lengths of such paths come to the driver.
    """
    rules = (
        rules.select("verdict", "host", "path").where("verdict is not null and host <> '' and path <> ''").distinct()
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", _short("digest"))
    )
    deepest = rules.agg(F.max(F.size(F.split("host", "[.]"))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("steps")).first()
    lengths = sorted(r[0] for r in rules.where("path not like '%/'").select(F.length("path")).distinct().collect())
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if deepest["labels"] is None:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})

    whole = F.expr(f"transform(filter(sequence(1, {max(1, deepest['steps'])}), n -> n < size(split(path, '/'))), n -> concat(substring_index(path, '/', n), '/'))")
    cut = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    starts = F.array_distinct(F.concat(whole, cut))
    expressions = (
        judged.select("host", "path").where("host <> '' and path <> ''").distinct()
        .withColumn("suffix", F.explode(F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {deepest['labels']})), n -> substring_index(host, '.', -n))")))
        .withColumn("start", F.explode(starts))
        .select("host", "path", F.sha2(F.concat("suffix", "start"), 256).alias("digest"))
        .withColumn("prefix", _short("digest"))
    )
    found = rules.select("prefix", F.col("digest").alias("of_rule"), F.struct(F.length("rule").alias("length"), F.length("host").alias("wide"), (F.col("verdict") == "block").alias("block"), "rule", "verdict").alias("best"))
    best = expressions.join(found, "prefix").where("digest = of_rule").groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", "best.rule", "best.verdict")
    return judged.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
