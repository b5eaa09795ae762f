"""Conversation structure repair by one integer minimum over a DAG.

A conversation's rows are edited so that the initials of their roles read (s?(ua)+)?.
The nodes of the DAG are (rows done, state of the pattern, rows inserted), an edge is
one edit. An edge weighs its cost, in the high digits, plus its audit letter in the
digit of the low part that belongs to its place; unused places at the end stay zero. So
the smallest weight is the lowest cost and, among its audits, the ASCII-least, and
minimum and addition of integers decide everything, the audit included.

Rows are told as one letter each (initial and fault) and gathered in chunks of CHUNK. A
chunk gives its smallest weights from each state to each state; FAN neighbours combine
into one until a conversation has one. A long conversation thus is many tasks, and its
texts are only hashed, one row after the other.

Inserted rows: with INSERT the dearest edit, removing an inserted row together with its
partner in the pattern (and a lone system row) is always cheaper, so an optimal plan holds
none. INSERTS are allowed all the same, and decide where other costs are given.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import crc32_of, dealt_join, written
from lotline.llm.turns import numbered, turn_digest

CHUNK = 256
FAN = 16
#: Rows that a plan may insert.
INSERTS = 2

#: Audit letters in ASCII order; their digits start at 1, as 0 is the padding. BITS: of a digit.
LETTERS = "DIKR"
BITS = 3
DIGIT = {x: i + 1 for i, x in enumerate(LETTERS)}
#: Fixed values of the contract: white space, and the ends of a whole text.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: What follows in the pattern: by state, the state that a row of an initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua?"
WHOLE, TRUNCATED, DUPLICATE, BLANK = range(4)


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def code(initial: str, fault: int) -> str:
    """One letter for a row's initial (s, u, a or ? for others) and first fault."""
    return chr(ord("A") + 4 * INITIALS.index(initial) + fault)


def decode(letter: str) -> tuple[str, int]:
    initial, fault = divmod(ord(letter) - ord("A"), 4)
    return INITIALS[initial], fault


def written_by(state: int) -> str:
    """The initial that a rerole or an insertion gives after a state."""
    return "a" if state == USER else "u"


def _inserted(layer: dict, done: int, width: int, costs: Costs) -> None:
    """Adds the edges that insert a row, at the same number of rows done."""
    for m in range(INSERTS):
        for state in range(4):
            if (state, m) in layer:
                at = width - 1 - done - m
                key = (NEXT[state, written_by(state)], m + 1)
                weight = layer[state, m] + (costs.insert << BITS * width) + (DIGIT["I"] << BITS * at)
                layer[key] = min(weight, layer.get(key, weight))


def chunk_weights(codes: str, start: int, costs: Costs) -> dict[tuple[int, int], int]:
    """Smallest weight to each (state, inserted) from ``start`` over the rows of ``codes``; the low
    part has a place for each row and each insertion."""
    width = len(codes) + INSERTS
    layer = {(start, 0): 0}
    _inserted(layer, 0, width, costs)
    for i, letter in enumerate(codes):
        initial, fault = decode(letter)
        extra = costs.truncated if fault == TRUNCATED else 0
        after: dict[tuple[int, int], int] = {}
        for (state, m), weight in layer.items():
            edges = [("D", state, costs.delete)]
            if fault < DUPLICATE:
                edges.append(("R", NEXT[state, written_by(state)], costs.rerole + extra))
                if (state, initial) in NEXT:
                    edges.append(("K", NEXT[state, initial], extra))
            at = width - 1 - i - m
            for x, to, cost in edges:
                w = weight + (cost << BITS * width) + (DIGIT[x] << BITS * at)
                after[to, m] = min(w, after.get((to, m), w))
        layer = after
        _inserted(layer, i + 1, width, costs)
    return layer


@lru_cache(maxsize=2048)
def _part(codes: str, first: bool, costs: Costs) -> str:
    """A chunk as text: its rows, outer initials, adjacent pairs that are not legal, and weights."""
    initials = [decode(x)[0] for x in codes]
    weights = {f"{s}": {f"{q},{m}": hex(w) for (q, m), w in chunk_weights(codes, s, costs).items()} for s in ((START,) if first else range(4))}
    return json.dumps({"n": len(codes), "head": initials[0], "tail": initials[-1], "weights": weights,
                       "illegal": sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False))})


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(parts: list[dict]) -> dict:
    """Neighbouring parts as one: smallest sums over the state between them, the second's
    letters moved behind the first's."""
    out = parts[0]
    for part in parts[1:]:
        n, wide, before, after = out["n"] + part["n"], out["n"] + part["n"] + INSERTS, out["n"] + INSERTS, part["n"] + INSERTS
        weights: dict = {}
        for start, ways in out["weights"].items():
            best = weights.setdefault(start, {})
            for mid, first in ways.items():
                state, m = mid.split(",")
                cost, letters = divmod(int(first, 16), 1 << BITS * before)
                for end, second in part["weights"][state].items():
                    q, k = end.split(",")
                    if int(m) + int(k) > INSERTS:
                        continue
                    more, others = divmod(int(second, 16), 1 << BITS * after)
                    # the first's rows and insertions take n + m places, the second's follow
                    low = (letters << BITS * (wide - before)) + (others >> BITS * int(m))
                    weight = ((cost + more) << BITS * wide) + low
                    key = f"{q},{int(m) + int(k)}"
                    best[key] = min(weight, best.get(key, weight))
        out = {"n": n, "head": out["head"], "tail": part["tail"],
               "illegal": out["illegal"] + part["illegal"] + (not legal(out["tail"], part["head"])),
               "weights": {s: {k: hex(w) for k, w in ways.items()} for s, ways in weights.items()}}
    return out


def solved(part: dict) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    best = min(int(w, 16) for k, w in part["weights"][str(START)].items() if int(k.split(",")[0]) in FINAL)
    width = part["n"] + INSERTS
    cost, letters = divmod(best, 1 << BITS * width)
    digits = format(letters, "o").zfill(width)  # BITS = 3: one octal digit each
    return cost, digits.rstrip("0").translate(str.maketrans({str(d): x for x, d in DIGIT.items()}))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its
    text, 2 takes its full stops, 3 repeats it, 4 makes its role user. Nulls (but those of conv_id
    and turn themselves, which stay) are one space."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    rows = conversations.withColumn("_fault", crc32_of(named) % 20).filter("_fault <> 0").select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"), "_fault")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fault", "_copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest").asc()]


def facts(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, initial, fault) of ``rows`` (conv_id, turn, role, text), without texts."""
    body = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?").alias("initial"),
        F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*ENDS), WHOLE).otherwise(TRUNCATED).alias("fault"))
    placed = written(numbered(narrow, "conv_id", *_order()), "placed")
    # where a text stood first in its conversation; only those that come again are joined back
    again = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = written(again.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "digest", "first", "n"), "repeats")
    keyed = placed.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = dealt_join(keyed, again, ["key", "digest"], F.col("pos"), "n", "left")
    return out.select("conv_id", "pos", "turn", "initial", F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE)
                      .otherwise(F.col("fault")).alias("fault"))


def plans(told: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, illegal, cost, audit) of every conversation that has rows, from :func:`facts`."""
    fixed = asdict(costs)
    letter = F.substring(F.lit("".join(code(i, f) for i in INITIALS for f in range(4))),
                         4 * (F.instr(F.lit(INITIALS), F.col("initial")) - 1) + F.col("fault") + 1, F.lit(1))
    chunks = told.select("conv_id", F.expr(f"(pos - 1) div {CHUNK}").alias("i"), F.struct("pos", letter.alias("x")).alias("row"))
    chunks = chunks.groupBy("conv_id", "i").agg(F.array_sort(F.collect_list("row")).alias("l")).select("conv_id", "i", F.array_join("l.x", "").alias("codes"))

    @F.udf("string", useArrow=True)
    def part_of(codes: str, first: bool) -> str:
        return _part(codes, first, Costs(**fixed))

    @F.udf("string", useArrow=True)
    def one_of(parts: list) -> str:
        return json.dumps(joined([json.loads(x) for x in parts]))

    @F.udf("illegal long, cost long, audit string", useArrow=True)
    def solution(part: str) -> tuple:
        p = json.loads(part)
        return (p["illegal"], *solved(p))

    parts = written(chunks.select("conv_id", "i", part_of("codes", F.col("i") == 0).alias("part")), "parts")
    while (parts.agg(F.max("i")).first()[0] or 0) > 0:
        neighbours = parts.groupBy("conv_id", F.expr(f"i div {FAN}").alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("l"))
        parts = written(neighbours.select("conv_id", "i", F.when(F.size("l") > 1, one_of("l.part")).otherwise(F.col("l")[0].part).alias("part")), "parts")
    return parts.select("conv_id", solution("part").alias("p")).select("conv_id", "p.illegal", "p.cost", "p.audit")


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, rank): a conversation's summary comes first, its rows follow and are
    hashed as they come, so a conversation is never held."""
    def stream():
        for batch in batches:
            yield from batch.to_pylist()

    head, state, sha, at, left = None, START, None, 0, 0

    def add(role: str, text: str) -> None:
        nonlocal left
        sha.update((("\n" if left else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        left += 1

    def insert() -> None:
        nonlocal at, state
        while at < len(head["audit"]) and head["audit"][at] == "I":
            add(ROLES[written_by(state)], "")
            state, at = NEXT[state, written_by(state)], at + 1

    schema = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in _OUT.split(", ")])
    names, out = [f.name for f in schema][:-1], []
    for row in stream():
        if row["rank"] == 0:
            if head:
                out.append({**{c: head[c] for c in names}, "repaired_sha256": sha.hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
            head, state, sha, at, left = row, START, hashlib.sha256(), 0, 0
            insert()
            continue
        x, at = head["audit"][at], at + 1
        if x != "D":
            initial = row["role"][:1] if x == "K" else written_by(state)
            state = NEXT[state, initial]
            add(row["role"] if x == "K" else ROLES[initial], row["text"])
        insert()
    if head:
        out.append({**{c: head[c] for c in names}, "repaired_sha256": sha.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, ids: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Faults, the cheapest repair and the repaired conversation's digest, one row per conversation.

    ``rows``: conv_id, turn, role, text without null role and text; ``ids``: every conv_id, also of
    conversations that have lost all rows. Rows stand by turn (nulls first), those of one
    turn in the order of their digests; rows without a conv_id are one conversation. Returns
    conv_id, gaps, blank, duplicate, truncated (rows by first fault), illegal (adjacent roles that
    do not follow), cost, audit, repaired_sha256. An empty table gives no rows.
    """
    told = written(facts(rows), "facts")
    turns = told.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = told.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(c) for c, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    found = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (turns, faults, plans(told, costs)):
        part = part.withColumnRenamed("conv_id", "_id")
        found = found.join(part, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = found.select("conv_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"),
                         *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"))
    body = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("rank"), F.col("turn").cast("long").alias("turn"),
                       turn_digest(F.col("role"), F.col("text")).alias("digest"), "role", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = heads.unionByName(body, allowMissingColumns=True).repartition(parts, "conv_id")
    return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "rank", *_order()).mapInArrow(_hashed, _OUT)
