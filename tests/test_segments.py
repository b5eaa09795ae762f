"""Ordered scans in chunks against plain Python on the whole sheet."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lotline.operators import joins, order, segments
from lotline.sources.text import split_batches
from tests.conftest import rows


def sheet_rows(n, seed, values="abc"):
    rng = random.Random(seed)
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([1, 1, 1, 2, 7])
        out.append((at, rng.choice([*values, None, values[0], values[0], " "])))
    return out


def runs_of(cells):
    out = []
    for value, group in itertools.groupby(cells, key=lambda c: c[1]):
        group = list(group)
        out.append((group[0][0], len(group), value))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 50_000])
def test_runs_over_chunk_borders(spark, monkeypatch, chunk):
    monkeypatch.setattr(segments, "CHUNK", chunk)
    sheets = {s: sheet_rows(120, s) for s in (1, 2)} | {None: [(i, "same") for i in range(40)], 4: [(5, None)]}
    df = spark.createDataFrame([(s, i, v) for s, cells in sheets.items() for i, v in cells], "sheet long, position long, v string")
    got = rows(order.run_spans(df, "sheet", "position", ["v"]), "sheet", "start", "length", "value")
    assert got == sorted(((s, *r) for s, cells in sheets.items() for r in runs_of(cells)), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("chunk", [1, 3, 50_000])
def test_first_seen_order(spark, monkeypatch, chunk):
    monkeypatch.setattr(segments, "CHUNK", chunk)
    sheets = {s: sheet_rows(80, 10 + (s or 0), "abcdef") for s in (1, None)} | {3: [(1, None), (2, " "), (3, None)]}
    df = spark.createDataFrame([(s, i, v) for s, cells in sheets.items() for i, v in cells], "sheet long, ordinal long, lot string")
    expected = []
    for s, cells in sheets.items():
        first: dict = {}
        for i, v in cells:
            first.setdefault((v or "").strip() or None, i)
        key = lambda c: (v := (c[1] or "").strip() or None, )
        ordered = sorted(cells, key=lambda c: (key(c)[0] is None, first[key(c)[0]] if key(c)[0] else 0, c[0]))
        expected += [(s, i, first[key((i, v))[0]] if key((i, v))[0] else None, n + 1) for n, (i, v) in enumerate(ordered)]
    got = rows(order.group_by_first_seen(df, "sheet", "lot", "ordinal"), "sheet", "ordinal", "first_seen", "position")
    assert got == sorted(expected, key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("chunk", [2, 50_000])
def test_batches_and_pairing(spark, monkeypatch, chunk):
    monkeypatch.setattr(segments, "CHUNK", chunk)
    ids = spark.createDataFrame([("f", f"L{i}", i * i) for i in range(30)], "file string, lot string, ordinal long")
    assert sorted((r.ordinal, r.batch_id) for r in split_batches(ids, 7).collect()) == [(i * i, i // 7) for i in range(30)]
    left = spark.createDataFrame([(1, i * 3) for i in range(12)], "sheet long, position long")
    right = spark.createDataFrame([(1, f"id{i}", i * 5) for i in range(9)], "sheet long, id string, seq long")
    got = {r.position: r.id for r in joins.positional_zip(left, right, "sheet", "position", "seq").collect()}
    assert got == {i * 3: f"id{8 - i}" if i < 9 else "" for i in range(12)}


def test_one_large_sheet_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(segments, "CHUNK", 5_000)
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("sheet"), F.col("id").alias("position"), F.expr("CAST(id DIV 7000 AS STRING)").alias("v"))
    got = sorted(tuple(r) for r in order.run_spans(df, "sheet", "position", ["v"]).select("start", "length").collect())
    assert got == [(i, min(7000, n - i)) for i in range(0, n, 7000)]
    placed = order.group_by_first_seen(df.select("sheet", F.col("position").alias("at"), F.expr("CAST(position % 3 AS STRING)").alias("v")), "sheet", "v", "at")
    assert placed.filter(F.expr(f"position <> first_seen * {n // 3} + at div 3 + 1")).count() == 0
    assert placed.agg(F.countDistinct("position"), F.min("position"), F.max("position")).first()[:] == (n, 1, n)


def test_heavy_limits_key_gives_the_same_rows(spark, monkeypatch):
    left = spark.createDataFrame([("T" if i % 3 else None, "hot" if i % 3 else f"c{i}", i) for i in range(600)], "test_type string, configuration string, n long")
    limits = spark.createDataFrame([("T", "hot", j) for j in range(7)] + [(None, "c3", 1), (None, "c3", 2), ("T", "none", 3)], "test_type string, configuration string, lim long")
    whole = rows(joins.limits_left_join(left, limits))
    monkeypatch.setattr(joins, "HEAVY_ROWS", 20)
    dealt, _ = joins._dealt(left, limits.withColumnsRenamed({"test_type": "_rk_test_type", "configuration": "_rk_configuration"}), joins.LIMIT_KEYS)
    assert dealt.select("_split").distinct().count() >= 15
    assert rows(joins.limits_left_join(left, limits)) == whole and len(whole) == 400 * 7 + 200 + 1
