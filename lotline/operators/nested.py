"""Nested JSON analytics.

Every array level is an ``explode`` (narrow, no shuffle); counts are one
hash aggregate; shares are a window over the small aggregated result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions.classify import leak_class, pick_limit_pair


def plain_number(c: Column) -> Column:
    """T7 number text: plain decimal (never scientific), 15 decimals when
    |x| < 1e-10, 10 when |x| < 1, else 8, trailing zeros and a trailing
    point cut; a missing value is ''."""
    def fixed(scale: int) -> Column:
        s = c.try_cast(f"decimal(38,{scale})").cast("string")
        s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")
        # no such decimal (NaN, infinity, very large): the text of the number itself
        return F.coalesce(s, c.try_cast("decimal(38,0)").cast("string"), c.cast("string"))
    a = F.abs(c)
    return (F.when(c.isNull(), F.lit(""))
             .when(a < 1e-10, fixed(15))
             .when(a < 1, fixed(10))
             .otherwise(fixed(8)))


def after_first_separator(c: Column, sep: str = "::") -> Column:
    """Text after the first ``sep``; unchanged when there is none."""
    return F.regexp_replace(c, "(?s)^.*?" + sep, "")


def flatten_limits(docs: DataFrame) -> DataFrame:
    """One row per (configuration set, setting, leakage element) with the
    element text after the first '::' and the four limits as plain text."""
    sets = docs.select(*[c for c in docs.columns if c != "ConfigurationSets"],
                       F.explode("ConfigurationSets").alias("cs"))
    settings = sets.select("*", F.explode("cs.Settings").alias("st"))
    el = settings.select("*", F.explode("st.LeakageElements").alias("element"))
    lim = F.col("st.LimitsSettings")
    keep = [c for c in docs.columns if c != "ConfigurationSets"]
    return el.select(
        *keep,
        F.col("cs.ConfigurationName").alias("configuration"),
        after_first_separator(F.col("element")).alias("pin_group"),
        plain_number(lim["VssLimitHigh"]).alias("vss_limit_high"),
        plain_number(lim["VssLimitLow"]).alias("vss_limit_low"),
        plain_number(lim["VccLimitHigh"]).alias("vcc_limit_high"),
        plain_number(lim["VccLimitLow"]).alias("vcc_limit_low"),
    )


def split_by_class(limits: DataFrame) -> DataFrame:
    """U4 (+ P13, P14): each row of the flat table tagged with its leak class
    and the limit pair of that class; rows of no class are not in the
    class tables (they stay in the main table only)."""
    klass = leak_class(F.col("configuration"))
    pair = pick_limit_pair(klass, F.col("vss_limit_high"), F.col("vss_limit_low"),
                           F.col("vcc_limit_high"), F.col("vcc_limit_low"))
    return (limits.withColumn("leak_class", klass).filter(F.col("leak_class").isNotNull())
                  .withColumn("_p", pair)
                  .select("leak_class", "configuration", "pin_group",
                          F.col("_p.high").alias("limit_high"), F.col("_p.low").alias("limit_low"),
                          F.col("_p.type").alias("test_type")))


def flatten_modes(docs: DataFrame) -> DataFrame:
    """Process types -> unit info -> config details, one row per detail."""
    keep = [c for c in docs.columns if c != "ProcessTypes"]
    p = docs.select(*keep, F.explode("ProcessTypes").alias("pt"))
    u = p.select(*keep, F.explode("pt.UnitInfo").alias("ui"))
    d = u.select(*keep, F.explode("ui.ConfigDetails").alias("cd"))
    return d.select(*keep, F.col("cd.ConfigSetName").alias("config_set"),
                    F.col("cd.ExecutionMode").alias("execution_mode"))


def mode_counts(details: DataFrame) -> DataFrame:
    """A5: count per (config set, execution mode); both must be non-empty."""
    ok = (F.col("config_set").isNotNull() & (F.col("config_set") != "")
          & F.col("execution_mode").isNotNull() & (F.col("execution_mode") != ""))
    return details.filter(ok).groupBy("config_set", "execution_mode").agg(F.count(F.lit(1)).alias("count"))


def share_in_group(counts: DataFrame, group: str = "config_set") -> DataFrame:
    """Count as a share of its config set's total, as a number and as
    text with one decimal (ties to even, as the reference's formatting does
    for exact ties)."""
    total = F.sum("count").over(Window.partitionBy(group))
    pct = F.col("count") * 100.0 / total
    return (counts.withColumn("total_count", total)
                  .withColumn("percentage", F.bround(pct.cast("decimal(38,10)"), 6).cast("double"))
                  .withColumn("percentage_text",
                              F.concat(F.bround(pct.cast("decimal(38,10)"), 1).cast("decimal(38,1)").cast("string"),
                                       F.lit("%"))))
