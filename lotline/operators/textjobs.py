"""Structured extraction from program texts (T2-T6, T9, W3-W6, W9, W10,
A14, A15, U3).

Input is ``(file, line_no, line)`` (see ``lotline.sources.text``). Every
window is partitioned by file and chunk of lines and ordered by line number;
what a chunk needs from its neighbours travels as one summary row per chunk,
so a long file is many tasks and a search may reach any number of lines.

Test blocks (T2/T3) need no range join: only the lines that can matter (heads,
block ends, fields) enter a window, which gives each head the next block end
and the next line where each field matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions.classify import RULE_MARKER, config_kind, diode_category
from lotline.session import written

# Fixed values (must equal the reference's for equal results).
WANTED_METHODS = ("PrimeDcLeakageTestMethod", "TraceAnalyticsDcLeakage")
HEAD_RE = r"^Test\s+(PrimeDcLeakageTestMethod|TraceAnalyticsDcLeakage)\s+(\S+)"
END_RE = r"^\s*Test "
TEST_TYPE_RE = r'TestType\s*=\s*"([^"]+)"'
BYPASS_RE = r"BypassPort\s*=\s*([^;]+);"
CONFIG_RE = r"Configuration\s*=\s*([^;]+);"
PARAM_RE = r'"([^"]+)"'
UNKNOWN = "UNKNOWN"
# A file is processed in chunks of this many lines, so one huge file is many tasks.
CHUNK_LINES = 50_000


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _extract(c: Column, pattern: str, group: int = 1, word: str = "") -> Column:
    """``word``: a text that every match holds; most lines lack it, and need no pattern."""
    v = F.regexp_extract(c, pattern, group)
    return F.when(c.contains(word) & c.rlike(pattern), v)


def _is_head(line: Column) -> Column:
    return line.startswith("Test") & line.rlike(HEAD_RE)


def _is_end(line: Column) -> Column:
    return line.contains("Test ") & line.rlike(END_RE)


def _carry(lines: DataFrame, values: dict[str, Column], chunk_lines: int, forward: bool, own: bool,
           order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Adds, under each name, the nearest non-null value of the file before each
    line (``forward``) or after it; with ``own`` the line's own value counts.
    Within a chunk a running ``last``; beyond it the nearest value of the
    chunks on that side (a window over one summary row per chunk), joined
    back on (file, chunk). One pass for all values."""
    c = F.floor(F.col(order[0]) / F.lit(chunk_lines)).cast("long")
    df = lines.withColumn("_chunk", c)
    for name, v in values.items():
        df = df.withColumn(f"_v{name}", v)

    def way(col: str) -> Column:
        return F.col(col).asc() if forward else F.col(col).desc()

    near = (Window.partitionBy("file", "_chunk").orderBy(way(order[0]), *order[1:])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1))
    pick = F.max if forward else F.min
    summary = df.groupBy("file", "_chunk").agg(*[
        pick(F.when(F.col(f"_v{n}").isNotNull(), F.struct(F.col(order[0]).alias("n"), F.col(f"_v{n}").alias("v"))))["v"].alias(f"_c{n}")
        for n in values])
    beyond = Window.partitionBy("file").orderBy(way("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("file", "_chunk", *[F.last(f"_c{n}", ignorenulls=True).over(beyond).alias(f"_i{n}") for n in values])
    df = df.select("*", *[F.last(f"_v{n}", ignorenulls=True).over(near).alias(f"_l{n}") for n in values])
    df = df.join(carried, ["file", "_chunk"], "left")
    kept = lines.columns
    return df.select(*kept, *[F.coalesce(f"_l{n}", f"_i{n}").alias(n) for n in values])


def _carry_forward(lines: DataFrame, value: Column, name: str, chunk_lines: int) -> DataFrame:
    """The last non-null ``value`` at or before each line of its file."""
    return _carry(lines, {name: value}, chunk_lines, forward=True, own=True)


def _scan_blocks(lines: DataFrame, offset_one_ends: bool, fields: dict[str, Column], chunk_lines: int) -> DataFrame:
    """W5 + W6: one row per wanted head with the first match of each field in
    its block. A block ends at the first line whose stripped text starts
    with 'Test ' (from the second line after the head, or the first with
    ``offset_one_ends``; that line is still searched) or with the file."""
    df = lines.select("file", "line_no", "line", *[c.alias(f"_c_{n}") for n, c in fields.items()])
    is_head, is_end = _is_head(F.col("line")), _is_end(F.col("line"))
    matters = is_head
    for n in fields:
        matters = matters | F.col(f"_c_{n}").isNotNull()
    # an end that counts from the second line after a head is placed one line before its own, behind that line
    at = F.col("line_no") - (0 if offset_one_ends else 1)
    places = F.array(F.when(matters, F.struct(F.col("line_no").alias("pos"), F.lit(0).alias("mark"), F.lit(None).cast("int").alias("end"))),
                     F.when(is_end, F.struct(at.alias("pos"), F.lit(1).alias("mark"), F.col("line_no").cast("int").alias("end"))))
    # read twice below, so written once
    df = written(df.filter(matters | is_end), "places").withColumn("_p", F.explode(F.filter(places, lambda x: x.isNotNull())))
    df = df.select("file", "line_no", "line", "_p.pos", "_p.mark", "_p.end",
                   *[F.when(F.col("_p.mark") == 0, F.col(f"_c_{n}")).alias(f"_c_{n}") for n in fields])
    values = {f"_n_{n}": F.when(F.col(f"_c_{n}").isNotNull(), F.struct(F.col("line_no").alias("n"), F.col(f"_c_{n}").alias("v")))
              for n in fields}
    df = _carry(df, {"_last": F.col("end"), **values}, chunk_lines, forward=False, own=False, order=("pos", "mark"))
    heads = df.filter((F.col("mark") == 0) & _is_head(F.col("line")))
    return heads.select(
        "file", F.col("line_no").alias("head_line"),
        F.regexp_extract("line", HEAD_RE, 2).alias("test_instance_name"),
        F.regexp_extract("line", HEAD_RE, 1).alias("test_method"),
        *[F.when(F.col("_last").isNull() | (F.col(f"_n_{n}")["n"] <= F.col("_last")), F.col(f"_n_{n}")["v"]).alias(n)
          for n in fields])


def _config_candidate(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """Adds ``_cfg``: the Configuration value a line would give. A line with
    'Configuration' but without both '=' and ';' is joined (with spaces) with
    the following lines up to the first one holding ';', which must not lie
    behind the next block end. Only the lines of such spans are gathered,
    one group per ';': its first open line gives the value. (No block begins
    inside a span, and what a later open line of it would give, the first
    finds too, so the others never are a block's first match.)"""
    line = F.col("line")
    has_cfg, has_semi, is_end = line.contains("Configuration"), line.contains(";"), _is_end(line)
    single = has_cfg & line.contains("=") & has_semi
    df = _carry(lines.filter((has_cfg & ~single) | has_semi | is_end),
                {"_semi": F.when(has_semi, F.col("line_no")), "_stop": F.when(is_end, F.col("line_no"))},
                chunk_lines, forward=False, own=False)
    spans = df.filter(has_cfg & ~single & (F.col("_stop").isNull() | (F.col("_semi") <= F.col("_stop"))))
    spans = spans.groupBy("file", "_semi").agg(F.min("line_no").alias("_from"))
    members = spans.select("file", "_from", F.explode(F.sequence("_from", "_semi")).alias("line_no"))
    texts = (members.join(lines.select("file", "line_no", "line"), ["file", "line_no"])
             .groupBy("file", "_from").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines")))
    joined = F.concat_ws(" ", F.transform("_lines", lambda x: x["line"]))
    texts = texts.select("file", F.col("_from").alias("line_no"), _extract(joined, CONFIG_RE).alias("_multi"))
    # only open lines are joined
    is_open = has_cfg & ~single
    opened = lines.filter(is_open).join(texts, ["file", "line_no"], "left").select(*lines.columns, "_multi")
    out = lines.filter(~is_open).withColumn("_multi", F.lit(None).cast("string")).unionByName(opened)
    return out.withColumn("_cfg", _strip(F.coalesce(F.when(single, _extract(line, CONFIG_RE)), F.col("_multi")))).drop("_multi")


def extract_instances(lines: DataFrame, rule_marker: str = RULE_MARKER,
                      chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """T2 (+ P15): leakage test instances with name, method, test type,
    bypass port, configuration and the four rule parameters (hot, cold,
    phm-hot, all; hot is the primary configuration of a rule call).
    Missing values are 'UNKNOWN'; a block is searched to its end. The lines are written once,
    when this is called, as several steps read them."""
    df = _config_candidate(written(lines.select("file", "line_no", "line"), "lines"), chunk_lines)
    fields = {
        "test_type": _extract(F.col("line"), TEST_TYPE_RE, word="TestType"),
        "bypass_port": _strip(_extract(F.col("line"), BYPASS_RE, word="BypassPort")),
        "raw_config": F.col("_cfg"),
    }
    df = _scan_blocks(df, False, fields, chunk_lines)
    raw = F.coalesce(F.col("raw_config"), F.lit(UNKNOWN))
    is_rule = raw.contains(rule_marker)
    params = F.when(is_rule, F.regexp_extract_all(raw, F.lit(PARAM_RE), 1)).otherwise(F.array().cast("array<string>"))

    def param(i: int) -> Column:
        return F.coalesce(F.try_element_at(params, F.lit(i)), F.lit(UNKNOWN))

    primary = (F.when(is_rule & (F.size(params) > 0), param(1))
                .when(is_rule, raw)
                .otherwise(_strip(F.regexp_replace(raw, '"', ""))))
    return df.select(
        "file", "head_line", "test_instance_name",
        primary.alias("configuration"),
        F.coalesce(F.col("test_type"), F.lit(UNKNOWN)).alias("test_type"),
        "test_method",
        F.coalesce(F.col("bypass_port"), F.lit(UNKNOWN)).alias("bypass_port"),
        param(1).alias("hot_config"), param(2).alias("cold_config"),
        param(3).alias("phmhot_config"), param(4).alias("all_config"),
        config_kind(raw, rule_marker).alias("config_kind"),
    )


def extract_instance_heads(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The instances of :func:`extract_instances` with name, method and bypass port only, for
    counts that need no configuration: no span of lines is gathered."""
    df = _scan_blocks(lines, False, {"bypass_port": _strip(_extract(F.col("line"), BYPASS_RE, word="BypassPort"))}, chunk_lines)
    return df.select("file", "head_line", "test_instance_name", "test_method", F.coalesce(F.col("bypass_port"), F.lit(UNKNOWN)).alias("bypass_port"))


def extract_instances_lite(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Name, method and bypass port; the block stops at the next 'Test '
    line (the line right after the head included)."""
    df = _scan_blocks(lines, True, {"bypass_port": _strip(_extract(F.col("line"), BYPASS_RE, word="BypassPort"))}, chunk_lines)
    return df.select("file", "head_line", F.col("test_instance_name").alias("instance_name"), "test_method",
                     F.coalesce(F.col("bypass_port"), F.lit(UNKNOWN)).alias("bypass_port"))


def instance_counts(instances: DataFrame, method_col: str = "test_method",
                    bypass_col: str = "bypass_port") -> DataFrame:
    """Instance totals by test method and by bypass value (1, -1,
    other) in one grouping-sets aggregate; ``dimension`` names the set."""
    bucket = F.when(F.col(bypass_col).isin("1", "-1"), F.col(bypass_col)).otherwise(F.lit("other"))
    g = (instances.withColumn("_bucket", bucket)
                  .groupingSets([[method_col], ["_bucket"]], method_col, "_bucket")
                  .agg(F.count(F.lit(1)).alias("instances"), F.grouping_id().alias("_gid")))
    return g.select(F.when(F.col("_gid") == 1, F.lit("test_method")).otherwise(F.lit("bypass_port")).alias("dimension"),
                    F.when(F.col("_gid") == 1, F.col(method_col)).otherwise(F.col("_bucket")).alias("value"),
                    "instances")


# ---------------------------------------------------------------- T4 limits

# Limit-block heads, the five (high, low) pattern pairs in
# priority order, and the value used when a side has no match.
LIMIT_HEAD_RE = r"^(#?)\s*Test\s+iCShopsTest(.*)$"
LIMIT_BOUNDARY_RE = r"^\s*(?:#\s*)?Test\s+iCShopsTest"
LIMIT_PATTERNS = [
    (r'(?:upper|lower)_diode_limit_high\s*=\s*TPI_SHOPS_Rules\.Selector_(?:UPPER|LOWER)DIODE_limit_high_EVG\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)',
     r'(?:upper|lower)_diode_limit_low\s*=\s*TPI_SHOPS_Rules\.Selector_(?:UPPER|LOWER)DIODE_limit_low_EVG\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)'),
    (r'(?:upper|lower)_diode_limit_high\s*=\s*[^(]*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)',
     r'(?:upper|lower)_diode_limit_low\s*=\s*[^(]*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)'),
    (r'(?:upper|lower)_diode_limit_high\s*=\s*[^(]*\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,\)]+)\s*\)',
     r'(?:upper|lower)_diode_limit_low\s*=\s*[^(]*\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,\)]+)\s*\)'),
    (r'(?:upper|lower)_diode_limit_high\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)',
     r'(?:upper|lower)_diode_limit_low\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\)'),
    (r'(?:upper|lower)_diode_limit_high\s*\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,\)]+)\s*\)',
     r'(?:upper|lower)_diode_limit_low\s*\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^,\)]+)\s*\)'),
]
LIMIT_DEFAULT = "N/A"
CONDITIONS = ("PHMCOLD", "PHMHOT", "CLASSCOLD", "CLASSHOT", "ALL")


def limit_blocks(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """W5 for limit blocks: a block runs from a head to the line before the
    next boundary line (a head, commented or not, indented or not).
    Returns (file, block_line, test_name, body) for blocks that open with a
    head which is not commented and whose name does not end with '_FF'; the
    body is what follows the name, lines joined with newlines. A head may be
    spread over lines: a '#' alone on the line before comments it, and the
    name may be on the line after it.

    Every line learns its block's head from the nearest boundary line before
    it; lines of no block, or of one that is left out, are dropped there, so
    only wanted blocks (the unit the patterns search; a few lines in
    program files) are gathered."""
    text = F.col("line")
    boundary, head = text.rlike(LIMIT_BOUNDARY_RE), text.rlike(LIMIT_HEAD_RE)
    filled = _strip(text)
    df = _carry(lines, {"_above": F.when(filled != "", filled)}, chunk_lines, forward=True, own=False)
    commented = (F.regexp_extract(text, LIMIT_HEAD_RE, 1) == "#") | F.coalesce(F.col("_above") == "#", F.lit(False))
    same_line = F.regexp_extract(text, LIMIT_HEAD_RE, 2)
    name = F.regexp_extract(same_line, r"^\s*(\S+)", 1)
    event = F.when(boundary, F.struct(F.col("line_no").alias("n"), (head & ~commented & ~name.endswith("_FF")).alias("wanted")))
    df = _carry_forward(df, event, "_head", chunk_lines).filter(F.col("_head")["wanted"])
    piece = F.when(F.col("line_no") == F.col("_head")["n"], same_line).otherwise(text)
    g = df.groupBy("file", F.col("_head")["n"].alias("block_line")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), piece.alias("p")))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda x: x["p"]), "\n")
    g = g.select("file", "block_line", whole.alias("_text"))
    return (g.select("file", "block_line", F.regexp_extract("_text", r"^\s*(\S+)", 1).alias("test_name"),
                     F.regexp_replace("_text", r"^\s*\S+", "").alias("body"))
             .filter((F.col("test_name") != "") & ~F.col("test_name").endswith("_FF")))


def extract_limits(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """T4 (+ P12, W10): one row per (file, category, test name) with the five
    high and five low limits. Commented heads and names ending '_FF' are
    skipped. The first pattern pair where the high or the low side matches
    gives both sides (the other side stays 'N/A'). When a (category, test
    name) appears twice in a file, the later block wins.

    The winning pair's index is found first; its two patterns are then
    picked as column values, so each limit is a single ``regexp_extract``
    rather than a chain over all pairs."""
    b = limit_blocks(lines, chunk_lines)
    body = F.col("body")
    hits = [F.when(body.rlike(hi) | body.rlike(lo), F.lit(k + 1)) for k, (hi, lo) in enumerate(LIMIT_PATTERNS)]
    b = b.withColumn("_pair", F.coalesce(*hits))
    pick = F.col("_pair")
    hi_pat = F.element_at(F.array(*[F.lit(p[0]) for p in LIMIT_PATTERNS]), pick)
    lo_pat = F.element_at(F.array(*[F.lit(p[1]) for p in LIMIT_PATTERNS]), pick)
    # rows of one pair side by side: the per-row pattern is compiled once per run of rows
    b = b.withColumn("_hp", hi_pat).withColumn("_lp", lo_pat).sortWithinPartitions("_pair")

    def side(pat: str, i: int) -> Column:
        ok = F.col("_pair").isNotNull() & F.regexp(body, F.col(pat))
        v = F.call_function("regexp_extract", body, F.col(pat), F.lit(i))
        v = _strip(F.regexp_replace(v, r"""^["']+|["']+\z""", ""))
        return F.when(ok, v).otherwise(F.lit(LIMIT_DEFAULT))

    cols = [side("_hp", i + 1).alias(f"{c}_high") for i, c in enumerate(CONDITIONS)] + \
           [side("_lp", i + 1).alias(f"{c}_low") for i, c in enumerate(CONDITIONS)]
    df = b.select("file", "block_line", diode_category(F.col("test_name")).alias("category"), "test_name", *cols)
    values = [c for c in df.columns if c.endswith(("_high", "_low"))]
    # The later block wins per (file, category, test name)
    g = df.groupBy("file", "category", "test_name").agg(F.max(F.struct("block_line", *values)).alias("_r"))
    return g.select("file", "category", "test_name", *[F.col("_r")[c].alias(c) for c in values])


def limits_long(wide: DataFrame) -> DataFrame:
    """Wide limits -> one row per (file, condition, category, test name)."""
    pairs = ", ".join(f"'{c}', {c}_high, {c}_low" for c in CONDITIONS)
    return wide.selectExpr("file", "category", "test_name",
                           f"stack({len(CONDITIONS)}, {pairs}) AS (condition, high_limit, low_limit)")


# ------------------------------------------------------------ T5 pin groups

# Group head and pin patterns.
GROUP_RE = r"^Group\s+(.+)$"
PIN_RE = r"^\s*(#?[A-Z][A-Z0-9_]*(?:__[A-Z]+)?)[;,]?\s*$"


def extract_pin_groups(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """T5 (+ W4): (group, pin) rows. A group opens at 'Group <name>' and
    closes at a line holding '}' while open; pins are upper-case ids
    (optionally '#'-prefixed, optional __SUFFIX, optional ';' or ',') on
    lines inside a group. Lines are stripped; blank lines are ignored."""
    s = _strip(F.col("line"))
    is_group = s.rlike(GROUP_RE)
    event = (F.when(is_group, F.struct(F.lit(True).alias("open"), F.regexp_extract(s, GROUP_RE, 1).alias("g")))
              .when(s.contains("}"), F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("g"))))
    df = _carry_forward(lines.withColumn("_s", s).withColumn("_ev", event), F.col("_ev"), "_state", chunk_lines)
    pins = df.filter(F.col("_ev").isNull() & (F.col("_s") != "") & F.col("_state")["open"]
                     & F.col("_s").rlike(PIN_RE))
    return pins.select("file", "line_no", F.col("_state")["g"].alias("pin_group"),
                       F.regexp_extract("_s", PIN_RE, 1).alias("pin_name"))


def pins_per_group(pins: DataFrame) -> DataFrame:
    """Pins per (file, group) with the group's first-seen line for
    ordering; equal names in different files are different groups."""
    return pins.groupBy("file", "pin_group").agg(
        F.count(F.lit(1)).alias("pin_count"), F.min("line_no").alias("first_line"))


# ------------------------------------------------------------ T6 resources

RESOURCE_RE = r"^\s*Resource\s+(\w+)"
RESOURCE_PIN_RE = r"^\s*(IP_\S+)\s+([^\s;]+);"
PLAIN_NUMBER_RE = r"^-?\d+(\.\d+)?$"


def distinctive_value(raw: Column) -> Column:
    """T6 value rule: drop '[...]' parts and trim; one plain number that is
    not 0 and below 100 -> x1000 rounded half-to-even, as integer text;
    anything else -> ''."""
    t = _strip(F.regexp_replace(raw, r"\[.*?\]", ""))
    num = t.try_cast("double")
    ok = t.rlike(PLAIN_NUMBER_RE) & num.isNotNull() & (num != 0) & (num < 100)
    return F.when(ok, F.bround(num * 1000, 0).cast("bigint").cast("string")).otherwise(F.lit(""))


def extract_resources(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """T6 (+ W3): (resource, pin, raw value, distinctive value); the current
    resource name is carried down the file ('' before the first one)."""
    res = F.when(F.col("line").rlike(RESOURCE_RE), F.regexp_extract("line", RESOURCE_RE, 1))
    df = _carry_forward(lines, res, "_res", chunk_lines)
    pins = df.filter(F.col("line").rlike(RESOURCE_PIN_RE))
    raw = F.regexp_extract("line", RESOURCE_PIN_RE, 2)
    return pins.select("file", "line_no", F.coalesce(F.col("_res"), F.lit("")).alias("resource"),
                       F.regexp_extract("line", RESOURCE_PIN_RE, 1).alias("pin_name"),
                       raw.alias("value_raw"), distinctive_value(raw).alias("distinctive_value"))


# ------------------------------------------------------------ T9 ids

ID_CHARS = "[A-Za-z0-9_-]+"


def extract_ids(df: DataFrame, key: str, text_col: str, label_re: str) -> DataFrame:
    """T9 (+ W9): all ids following a label in each text, distinct per text in
    first-seen order; ``seq`` numbers them, so a caller that expects n ids
    can keep ``seq <= n``."""
    pattern = f"{label_re}\\s*({ID_CHARS})"
    found = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1)).alias("pos", "id"))
    first = found.groupBy(key, "id").agg(F.min("pos").cast("long").alias("first_pos"))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("first_pos")).cast("long")
    return first.withColumn("seq", seq)
