"""Verdicts on URLs by rules for hosts and paths, with a sort-merge range join.

A rule is a host, the start of a path and a verdict; it fits its host and all subdomains, and
the longest fitting rule (characters of host and path) wins, then the longer host, then the greater text. A host's
canonical key has its labels reversed; with the path behind it, a rule's texts are an
interval of keys, and intervals of rules are nested or apart. A URL has a key under each
domain above its host (as many as the host has labels).

Rules and keys are put in order together and swept. A rule sends an event at the start of
its interval, with itself, and one behind the end, with the rule around it: what the latest
event says is the top of the stack of rules that are open, and the events at the ends take
rules off it. In window terms: the last event's rule by key, per host key.

Very common hosts and domains: keys are dealt over ``salts`` parts of each host key, and rules (which
are few against URLs) are repeated for each part. Repeated rows are counted before the sweep, per
input partition, and put back after it. Only built-in functions are used.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; no rule means
the default verdict. Rules without a host are left out; of equal rules with different
verdicts ``block`` holds. Empty tables are fine; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
SALTS = 32


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def key(path: Column, end: bool = False) -> Column:
    """Bytes of a path; behind the end of its interval stands a byte that no text has."""
    return F.concat(path.cast("binary"), F.unhex(F.lit("FF"))) if end else path.cast("binary")


def events(rules: DataFrame) -> DataFrame:
    """Rows (site, key, top) of rules (host, path, verdict): ``top`` is the rule on the stack."""
    clean = (
        rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''").groupBy("host", "path").agg(F.max(F.col("verdict") == BLOCK).alias("blocks")))
    size = F.char_length("host") + F.char_length("path")
    rule = F.struct(size.alias("size"), F.char_length("host").alias("of_host"), F.concat("host", "path").alias("rule"), "blocks")
    own = clean.select("host", "path", rule.alias("own"))
    # the rule around a rule: the longest proper start of its path that is a rule of the host
    starts = own.where("path <> ''").select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("start"))
    around = (
        starts.join(own.select("host", F.col("path").alias("start"), F.col("own").alias("outer")), ["host", "start"])
        .groupBy("host", "path").agg(F.max("outer").alias("outer")))
    nested = own.join(around, ["host", "path"], "left")
    # a stack with nothing on it is a struct of nulls, so that it hides what came before
    empty = F.struct(F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("of_host"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("blocks"))
    site = reversed_host(F.split("host", r"\."))
    opening = nested.select(site.alias("site"), key(F.col("path")).alias("key"), F.col("own").alias("top"))
    closing = nested.select(site.alias("site"), key(F.col("path"), True).alias("key"), F.coalesce("outer", empty).alias("top"))
    return opening.unionByName(closing)


def judged(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, salts: int = SALTS) -> DataFrame:
    """Per row: id, url, ``host``, ``path``, ``rule`` (host and path, or null), ``verdict``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.spark_partition_id().alias("part"))
    counted = rows.groupBy("id", "url", "part").agg(F.count(F.lit(1)).alias("copies"))
    host, path = host_and_path(F.col("url"))
    labels = F.split("host", r"\.")
    own = counted.withColumns({"host": host, "path": path}).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)))
    points = own.withColumn("above", F.explode(F.sequence(F.lit(1), F.size(labels)))).select(
        "id", "url", "part", "copies", "host", "path", "salt", (F.col("above") == 1).alias("whole"),
        reversed_host(F.slice(labels, F.col("above"), F.size(labels))).alias("site"), key(F.col("path")).alias("key"))
    spread = events(rules).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    line = points.withColumn("point", F.lit(True)).unionByName(spread.withColumn("point", F.lit(False)), allowMissingColumns=True)
    sweep = Window.partitionBy("site", "salt").orderBy("key", "point").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("open", F.last("top", ignorenulls=True).over(sweep)).where(F.col("point") & (F.col("whole") | F.col("open.rule").isNotNull()))
    best = (
        met.groupBy("id", "url", "part", "host", "path")
        .agg(F.max(F.when(F.col("open.rule").isNotNull(), F.col("open"))).alias("open"), F.max("copies").alias("copies")))
    return best.select(
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"), F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path",
        F.col("open.rule").alias("rule"),
        F.when(F.col("open.rule").isNull(), default).when(F.col("open.blocks"), BLOCK).otherwise(ALLOW).alias("verdict")).drop("copy")
