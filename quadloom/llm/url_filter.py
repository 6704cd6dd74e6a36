"""URL filters: rules on host suffix and path prefix.

Method. A URL expands into expressions host-suffix + path-prefix, one for every pair that a rule could name (only numbers of labels
and path lengths that occur among the rules are tried, which loses nothing). Expressions and rules meet in an equi-join on the
first 4 bytes of their SHA-256, then the full digest confirms, so that rules can be kept and shipped as digests. Of the rules that
fit, the longest wins; among equally long ones a block wins, then the larger text. A URL that no rule fits gets the default.

The rule table is broadcast only while its counted rows stay under a bound; beyond it the join shuffles on the prefix, with the
expressions of common hosts spread by Spark's skew join. One shuffle by row brings a URL's hits together, after partial aggregation.

Cases: a null URL or one without :// has an empty host and path, so no rule fits and the default holds; repeated rows give
repeated results; rules with a null host or path are ignored, equal rules count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of rules up to which they are broadcast: a digest, a text and a verdict each.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """array<string>: the last n labels of the host, for n in labels, with the first m characters of the path, for m in lengths."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda k: (k <= n) & (host != "")), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))


def judged(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls: any table with the two columns. rules: (host, path, verdict). Returns id, host, path, rule, verdict."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path")), F.count("*")).first()  # bounded: numbers of labels and lengths of paths
    rules = rules.groupBy(F.substring(digest, 1, 8).alias("_prefix")).agg(F.collect_list(F.struct(digest.alias("digest"), F.length(F.concat("host", "path")).alias("n"), F.col("rule_verdict").alias("v"), F.concat("host", "path").alias("rule"))).alias("_rules"))
    base = urls.select(urls[id_col].alias("_id"), urls[url_col].alias("_url")).select("_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"))
    if not shape[2]:
        return base.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if shape[2] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    found = base.select("_id", "host", "path", F.posexplode_outer(expressions(F.col("host"), F.col("path"), sorted(shape[0]), sorted(shape[1]))).alias("_at", "_said")).withColumn("_said", F.sha2("_said", 256))
    hits = found.withColumn("_prefix", F.substring("_said", 1, 8)).join(rules, "_prefix", "left")
    fits = F.array_max(F.transform(F.filter("_rules", lambda r: r["digest"] == F.col("_said")), lambda r: F.struct(r["n"].alias("n"), r["v"].alias("v"), r["rule"].alias("rule"))))
    copies = F.count(F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, 1)).cast("int")
    out = hits.groupBy("_id", "host", "path").agg(F.max(fits).alias("_best"), copies.alias("_copies"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
