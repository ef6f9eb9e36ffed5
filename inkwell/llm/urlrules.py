"""URL filters by host-suffix and path-prefix expressions.

Every url is expanded into its host's suffixes times its path's prefixes of the
lengths that rules have.  Expressions meet the rules on a 32-bit hash prefix, the
full digest confirms, and of the rules that fit the longest one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Rules that may be sent to every executor; more of them are shuffled.
BROADCAST_ROWS = 10_000
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host itself and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _keyed(df: DataFrame, host: str, path: str) -> DataFrame:
    # no host holds a slash, so the pair can be joined without doubt
    digest = F.sha2(F.concat(F.col(host), F.lit("\n"), F.col(path)), 256)
    return df.withColumn("__digest", digest).withColumn("__h32", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))


def apply_rules(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``urls``.

    ``rules`` has host, path and action.  A rule fits its host and all subdomains
    when the url's path starts with the rule's path.  The longest rule (host and
    path together, then path, then the action first in order) wins.  No rule: rule is null
    and the verdict ``allow``.  Null urls and those without ``://`` have an empty
    host and path, which only a rule with an empty host fits.  Rules with a null
    part are left out and repeated ones count once; repeated rows give repeated
    rows; an empty table gives none; columns other than the two are not read.
    """
    pages = urls.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pages = pages.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    known = _keyed(rules.select(lower_ascii(F.col("host")).alias("rhost"), F.col("path").alias("rpath"), "action").dropna().distinct(), "rhost", "rpath")
    # lengths of rule paths: one row, at most as many values as the longest path
    lengths = sorted(known.agg(F.collect_set(F.length("rpath")).alias("n")).first()["n"])
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    pairs = pages.select("host", "path").distinct()
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    expressions = pairs.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("ehost"), F.array_compact(prefixes).alias("eps")).select("host", "path", "ehost", F.explode("eps").alias("epath"))
    met = _keyed(expressions, "ehost", "epath").join((F.broadcast(known) if few else known).withColumnRenamed("__digest", "__rule"), "__h32")
    confirmed = met.filter((F.col("__digest") == F.col("__rule")) & (F.col("ehost") == F.col("rhost")) & (F.col("epath") == F.col("rpath")))
    rank = F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rpath").alias("p"), (F.col("action") == "allow").alias("a"))
    best = confirmed.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), F.col("action").alias("verdict")), rank).alias("best"))
    # written first, so that the join can split a host and path that very many pages have
    best = stored(best, "url-verdicts")
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
