"""URL rules by host-suffix and path-prefix expressions, matched on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield.llm.common import fresh, quoted

RULES = "host string, path string, verdict string"
#: Bytes of rules that are sent to every task instead of being shuffled.
SMALL_RULES = 16 << 20
#: Hex digits of the hash prefix that is joined on; the whole digest is compared afterwards.
PREFIX = 8


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what stands between ``://`` and ``/``, ``?``, ``#`` or the end, lower-cased; then up to ``?`` or ``#``.

    Both are empty for a null and for a text without ``://``.
    """
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and every part of it that follows a dot."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), ".")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    A rule ``(host, path, verdict)`` fits its host and all subdomains where the path starts with its own. Each url is
    expanded into host suffixes times path prefixes of the lengths that rule paths have, joined with the rules
    on a short prefix of the expression's hash, and confirmed by the whole digest and the texts. The
    longest fitting rule wins; of equally long ones ``block``, then the later text in code-point order. Without one the verdict is
    ``default``. Rules with a null host or path never fit; a repeated rule counts once. Null urls have empty host and
    path. Existing columns of the four names are replaced; every input row gives one row.

    Expressions are made per distinct (host, path), so a hot url costs one expansion; rules are sent to all tasks only
    while their texts are below ``SMALL_RULES`` bytes, and are shuffled above.
    """
    host, path = url_parts(quoted(url).cast("string"))
    known = rules.where("host is not null and path is not null").select(
        _ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).distinct()
    known = known.select("*", *_digests(F.col("r_host"), F.col("r_path")))
    # As many numbers as the longest rule path has characters, at most
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())
    small = (known.agg(F.sum(F.length("r_host") + F.length("r_path"))).first()[0] or 0) <= SMALL_RULES
    judged_host, judged_path, judged, of_host, of_path = (
        fresh(urls, n) for n in ("url_host", "url_path", "url_rule", "of_host", "of_path")
    )
    parts = urls.withColumn(judged_host, host).withColumn(judged_path, path)
    sites = parts.select(F.col(judged_host).alias("host"), F.col(judged_path).alias("path")).distinct()
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = sites.withColumn("e_host", F.explode(host_suffixes(F.col("host")))).withColumn("e_path", F.explode(prefixes))
    asked = expressions.select("*", *_digests(F.col("e_host"), F.col("e_path")))
    side = known.withColumnsRenamed({"prefix": "r_prefix", "digest": "r_digest"})
    same = (F.col("digest") == F.col("r_digest")) & (F.col("e_host") == F.col("r_host")) & (F.col("e_path") == F.col("r_path"))
    fits = asked.join(F.broadcast(side) if small else side, F.col("prefix") == F.col("r_prefix")).where(same)
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"), (F.col("r_verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = fits.groupBy(F.col("host").alias(of_host), F.col("path").alias(of_path)).agg(F.max(rank).alias(judged))
    joined = parts.join(best, (F.col(judged_host) == F.col(of_host)) & (F.col(judged_path) == F.col(of_path)), "left")
    own = ("host", "path", "rule", "verdict")
    return joined.select(
        *[quoted(c) for c in urls.columns if c.lower() not in own], F.col(judged_host).alias("host"),
        F.col(judged_path).alias("path"), F.col(judged)["rule"].alias("rule"),
        F.coalesce(F.col(judged)["verdict"], F.lit(default)).alias("verdict"),
    )


def _digests(host: Column, path: Column) -> list[Column]:
    digest = F.sha2(F.concat_ws("\n", host, path).cast("binary"), 256)
    return [F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("digest")]
