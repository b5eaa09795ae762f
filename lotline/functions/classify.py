"""Classification expressions (P11-P18). Plain ``CASE WHEN`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotline.functions.numbers import to_number

# Fixed values (must equal the reference's for equal results):
# pass bins that are always green: functional "100", interface "1";
# severity thresholds: red above 0.05, yellow from 0.02 to 0.05 inclusive.
PASS_BIN = {"functional": "100", "interface": "1"}
RED_ABOVE = 0.05
YELLOW_FROM = 0.02


def program_family(program: Column) -> Column:
    """10th character 'H' -> CCG, otherwise EDGE; a null name is its own
    class (null) instead of aborting the run."""
    return (F.when(program.isNull(), F.lit(None).cast("string"))
             .when(F.substring(program, 10, 1) == "H", F.lit("CCG"))
             .otherwise(F.lit("EDGE")))


def diode_category(name: Column) -> Column:
    """UPPERDIODE before LOWERDIODE, else OTHER."""
    return (F.when(name.contains("UPPERDIODE"), F.lit("UPPERDIODE"))
             .when(name.contains("LOWERDIODE"), F.lit("LOWERDIODE"))
             .otherwise(F.lit("OTHER")))


# Leak-class words, checked in this priority order.
HOT_HI = ("LEAKHI", "HIGH", "HI")
HOT_LO = ("LEAKLO", "LOW", "LO")


def _any(text: Column, words) -> Column:
    out = None
    for w in words:
        c = text.contains(w)
        out = c if out is None else (out | c)
    return out


def leak_class(configuration: Column) -> Column:
    """HOT/COLD x hi/lo on the upper-cased configuration name, priority
    HOT+hi, HOT+lo, COLD+hi, COLD+lo; none -> null (kept in the main table only)."""
    up = F.upper(configuration)
    hot, cold = up.contains("HOT"), up.contains("COLD")
    hi, lo = _any(up, HOT_HI), _any(up, HOT_LO)
    return (F.when(hot & hi, F.lit("HOT_HI")).when(hot & lo, F.lit("HOT_LO"))
             .when(cold & hi, F.lit("COLD_HI")).when(cold & lo, F.lit("COLD_LO")))


def pick_limit_pair(klass: Column, vss_high: Column, vss_low: Column,
                    vcc_high: Column, vcc_low: Column) -> Column:
    """Hi classes take the Vss pair (type VSS), lo classes the Vcc pair."""
    is_hi = klass.endswith("_HI")
    is_lo = klass.endswith("_LO")
    return (F.when(is_hi, F.struct(vss_high.alias("high"), vss_low.alias("low"), F.lit("VSS").alias("type")))
             .when(is_lo, F.struct(vcc_high.alias("high"), vcc_low.alias("low"), F.lit("VCC").alias("type"))))


# Fixed value: the rule-call marker inside a configuration value.
RULE_MARKER = "_Rules.Temp("


def config_kind(configuration: Column, marker: str = RULE_MARKER) -> Column:
    """Rule configuration when the text calls the rule function, else hardcoded."""
    return F.when(configuration.contains(marker), F.lit("rule")).otherwise(F.lit("hardcoded"))


def severity(pct: Column, bin_value: Column, bin_kind: Column, is_total_row: Column) -> Column:
    """Red > 0.05; 0.02..0.05 yellow (both ends inclusive); <= 0.02 green;
    the pass bin is always green; the total row has none."""
    is_pass = ((bin_kind == "functional") & (bin_value == PASS_BIN["functional"])) | \
              ((bin_kind == "interface") & (bin_value == PASS_BIN["interface"]))
    return (F.when(is_total_row, F.lit(None).cast("string"))
             .when(is_pass, F.lit("green"))
             .when(pct > RED_ABOVE, F.lit("red"))
             .when(pct >= YELLOW_FROM, F.lit("yellow"))
             .otherwise(F.lit("green")))


def target_status(value: Column, target: Column, higher_is_good: bool) -> Column:
    """Compare |value| with |target|. Yield: above target good, else bad
    (equal is bad). TTG/ETT/RCS: above target bad, else good (equal is good).
    No value or no target -> null."""
    above = F.abs(value) > F.abs(target)
    good, bad = F.lit("good"), F.lit("bad")
    res = F.when(above, good).otherwise(bad) if higher_is_good else F.when(above, bad).otherwise(good)
    return F.when(value.isNull() | target.isNull(), F.lit(None).cast("string")).otherwise(res)


def normalise_rate(c: Column) -> Column:
    """P18: '12.5%' / '0.125' / 12.5 -> percent number; a value in [0, 1] is a
    fraction (so 1 means 100%)."""
    num = to_number(F.regexp_replace(c.cast("string"), "%", ""))
    return F.when(num.between(0, 1), num * 100).otherwise(num)
