"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

The rules' own verdicts are the labels: the trees are fitted on the URLs that a rule
decides and judge the others. Everything is DataFrame functions and Spark's own
gradient-boosted trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import written

#: Labelled URLs that the trees are fitted on, about, at most.
TRAIN_ROWS = 20_000
#: Rows of each class that the sample has at least, about (all where a class has fewer).
CLASS_ROWS = 200
#: Added to the counts of a suffix, at the overall rate.
SUFFIX_PRIOR = 20.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "host_length", "host_labels",
            "hyphens", "longest_run", "secure", "suffix_rate", "suffix_log")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines such as ``block example.com/de/``."""
    out = []
    for line in lines:
        verdict, _, where = line.strip().partition(" ")
        host, slash, path = where.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null."""
    picks = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        picks.append(F.when(fits, F.lit(r.name)))
    return F.coalesce(*picks, F.lit(None).cast("string"))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features of a URL (all doubles)."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    letters = F.split(u, "")
    share = F.transform(F.array_distinct(letters),
                        lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    runs = F.transform(F.split(u, r"[^A-Za-z]+"), lambda w: F.length(w))
    raw = {
        "length": F.length(u),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "digit_ratio": F.length(F.regexp_replace(u, r"[^0-9]", "")) / n,
        "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "host_length": F.length(host),
        "host_labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))),
        "hyphens": F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit(""))),
        "longest_run": F.coalesce(F.array_max(runs), F.lit(0)),
        "secure": u.startswith("https:").cast("int"),
    }
    return {k: v.cast("double") for k, v in raw.items()}


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id",
          train_rows: int = TRAIN_ROWS, trees: int = 10, depth: int = 3) -> DataFrame:
    """Verdict for every row of ``pages``: the longest fitting rule's, else the trees'.

    Returns id, host, path, rule, verdict, block_probability. The trees are fitted on
    about ``train_rows`` of the URLs that a rule decides (all of them where they are
    fewer), picked by a hash of URL and id, of either verdict CLASS_ROWS at least. Null URLs and such without ``://`` have empty
    host and path and are judged by the trees; where no rule decides any row, or all
    decide alike, there is nothing to learn and the rest is allowed, or gets that one
    verdict. Repeated rows and ids are judged alike; other columns are ignored.
    """
    base = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    base = base.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = [r.name for r in rules if r.verdict == "block"]
    by_rule = F.when(F.col("rule").isNull(), None).when(F.col("rule").isin(blocked), 1.0).otherwise(0.0)
    base = base.withColumn("_label", by_rule.cast("double"))
    base = base.withColumn("_suffix", F.substring_index("host", ".", -2))

    known = base.filter(F.col("_label").isNotNull())
    n, rate = known.agg(F.count("*"), F.avg("_label")).first()
    if not n or rate in (0.0, 1.0):
        only = F.lit("block" if n and rate == 1.0 else "allow")
        prob = F.lit(rate if n else 0.0).cast("double")
        return _result(base.withColumn("_p", prob), id_col, only)

    # suffix statistics over all labelled rows
    suffixes = known.groupBy("_suffix").agg(F.count("*").alias("_n"), F.sum("_label").alias("_b"))
    suffixes = suffixes.select("_suffix", ((F.col("_b") + SUFFIX_PRIOR * rate) / (F.col("_n") + SUFFIX_PRIOR)).alias("suffix_rate"),
                               F.log1p(F.col("_n").cast("double")).alias("suffix_log"))
    full = base.join(suffixes, "_suffix", "left").fillna({"suffix_rate": rate, "suffix_log": 0.0})
    feats = lexical(F.col("_url"), F.col("host"), F.col("path"))
    full = full.select(id_col, "host", "path", "rule", "_label", "_url", "suffix_rate", "suffix_log",
                       *[v.alias(k) for k, v in feats.items()])
    full = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(full)
    # every class has its share, and CLASS_ROWS at least; equal URLs are picked row by row
    held = {1.0: n * rate, 0.0: n * (1.0 - rate)}
    share = {label: min(1.0, max(train_rows / n, CLASS_ROWS / max(1.0, of))) for label, of in held.items()}
    at = F.pmod(F.xxhash64("_url", F.col(id_col)), F.lit(1_000_003))
    picked = at < F.when(F.col("_label") == 1.0, int(1_000_003 * share[1.0]) + 1).otherwise(int(1_000_003 * share[0.0]) + 1)
    # the trees pass over it many times
    train = written(full.filter(F.col("_label").isNotNull() & picked).select("_features", "_label"), "url-sample")
    model = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth,
                          maxBins=32, seed=11, checkpointInterval=-1).fit(train)
    scored = model.transform(full).withColumn("_p", vector_to_array("probability")[1])
    return _result(scored, id_col, F.when(F.col("_p") > 0.5, "block").otherwise("allow"))


def _result(df: DataFrame, id_col: str, learned: Column) -> DataFrame:
    verdict = F.when(F.col("_label") == 1.0, "block").when(F.col("_label") == 0.0, "allow").otherwise(learned)
    return df.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.col("_p").alias("block_probability"))
