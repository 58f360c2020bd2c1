"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, then on full digests.

A rule is a host, a path and a verdict; it fits its host and every subdomain if
the path of the URL starts with the rule's path.  Each distinct (host, path) is
expanded into its host suffixes times its path prefixes of the lengths that
rules have; the expressions meet the rules on eight hex digits of their digest
and are confirmed by the whole digest.  The longest expression wins; of equally
long ones the longer host, and block before allow.  DataFrame functions only.

A null URL and one without ``://`` have an empty host and path and fit no rule,
and neither does an empty path unless a rule's path is empty.  Repeated and
clashing rows and columns do no harm: only the id and the URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_DIGITS = 8


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring_index(F.substr(text, F.instr(text, "://") + 3), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return ascii_lower(host), path


def _digested(frame: DataFrame, host: str, path: str) -> DataFrame:
    frame = frame.withColumn("digest", F.sha2(F.concat(F.col(host), F.lit("\0"), F.col(path)), 256))
    return frame.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))


def verdicts(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct (host, path) that any rule fits."""
    rules = _digested(rules.dropna().dropDuplicates(), "rule_host", "rule_path").select(
        "short", "digest", "rule_host", "rule_path", F.col("verdict").alias("rule_verdict")
    )
    # However many rules there are, they have few label counts and path lengths.
    labels, lengths = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))
    ).first()

    def up_to(numbers: list[int], most: Column) -> Column:
        return F.filter(F.array(*map(F.lit, sorted(numbers))).cast("array<int>"), lambda n: n <= most)

    suffixes = up_to(labels, F.size(F.split("host", r"\.")))
    prefixes = up_to(lengths, F.length("path"))
    expanded = (
        parts.select("host", "path", F.explode(suffixes).alias("n_suffix"), F.split("host", r"\.").alias("parts"))
        .select("host", "path", F.concat_ws(".", F.slice("parts", -F.col("n_suffix"), F.col("n_suffix"))).alias("suffix"),
                F.explode(prefixes).alias("n_prefix"))
        .select("host", "path", "suffix", F.substring("path", F.lit(1), F.col("n_prefix")).alias("prefix"))
    )
    fits = _digested(expanded, "suffix", "prefix").alias("e").join(rules.alias("r"), "short").where("e.digest = r.digest")
    best = F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    ))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """The id column, ``host``, ``path``, ``rule`` and ``verdict`` of every page."""
    host, path = split_url(F.col("url"))
    pages = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    judged = verdicts(pages.select("host", "path").distinct(), rules)
    joined = pages.join(judged, ["host", "path"], "left")
    return joined.select(id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
