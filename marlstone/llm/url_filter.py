"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host and path, verdict) of the registered query's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hex digits of the short hash on which expressions and rules are joined.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as rows (rule, verdict): rule is a host, then a path that begins with a slash."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict).

    Each distinct url is expanded into (suffix of its host by labels) x (folder prefix of its path), up to the
    greatest number of labels and of folders that a rule has: no deeper one can be a rule's. A rule is keyed by its host and the folder of its path. Both sides meet on the first SHORT hex
    digits of the key's SHA-256; the full digest and the rest of the rule's path are then confirmed.
    Of the rules that fit, the longest wins, then the one with the longer host, then "block". Distinct
    urls are judged once and joined back, so a url or host that fills a third of the table is combined
    before any exchange, and urls without "://" are not exchanged at all. Which join is used follows from the
    rules' measured size, not from a hint.

    Null url or no "://": empty host and path, no rule, the default. Null rules, rules without a slash
    and null verdicts are ignored; repeated rules count once. Null page_id stays null; repeated pages
    give repeated results; an empty table gives no rows.
    """
    cut = rules.where("rule is not null and verdict is not null and instr(rule, '/') > 0").select("rule", "verdict").distinct()
    keyed = cut.select(
        "rule", F.col("verdict").alias("rule_verdict"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"),
        F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("rule_host"), F.expr("regexp_extract(substring(rule, instr(rule, '/')), '(?s)^(.*/)', 1)").alias("rule_folder"))
    most = keyed.agg(F.max(F.size(F.split("rule_host", "\\."))), F.max(F.length("rule_folder") - F.length(F.translate("rule_folder", "/", "")))).first()
    most_labels, most_folders = most[0] or 1, most[1] or 1
    keyed = keyed.withColumn("rule_digest", F.sha2(F.concat("rule_host", "rule_folder"), 256)).withColumn("rule_short", F.substring("rule_digest", 1, SHORT)).drop("rule_host", "rule_folder")

    has = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    parsed = _parse(pages.where(has).select("url").distinct().withColumn("rest", rest)).select("url", "host", "path")

    labels = F.split(F.substring_index("host", ".", -most_labels), "\\.")
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array(F.lit("")))
    # The last part, of what is deeper or no folder, is left out.
    folders = F.split("path", "(?<=/)", most_folders + 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, 1, k), ""))
    prefixes = F.filter(F.slice(prefixes, 1, most_folders), lambda x: F.endswith(x, F.lit("/")))
    spread = (parsed.where(F.col("path") != "").select("url", "path", F.explode(F.array_distinct(prefixes)).alias("prefix"), suffixes.alias("suffixes"))
              .select("url", "path", F.explode(F.array_distinct("suffixes")).alias("suffix"), "prefix")
              .select("url", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
              .withColumn("short", F.substring("digest", 1, SHORT)))

    hits = spread.join(keyed, F.col("short") == F.col("rule_short")).where((F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)"))
    rank = F.struct(F.length("rule"), F.length("rule") - F.length("rule_path"), (F.col("rule_verdict") == "block").alias("b"), F.col("rule"), F.col("rule_verdict"))
    best = hits.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    own = _parse(pages.where(has).select("page_id", "url").withColumn("rest", rest)).select("page_id", "url", "host", "path")
    judged = own.join(best, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    bare = pages.where(~has).select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionAll(bare)


def _parse(df: DataFrame) -> DataFrame:
    """host (A-Z lower-cased) and path of ``rest``, the url after its first "://"."""
    return df.withColumn("host", F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract("rest", "^[^/?#]*(/[^?#]*)", 1))
