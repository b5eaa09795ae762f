"""The pipeline and the registered queries on the smallest data set."""

from __future__ import annotations

import hashlib
import os
import struct
from zlib import crc32

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from lotline.llm import partition_join, stages, string_tiling
from tests.llm.test_partition_join import brute

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


@needs_data
def test_run(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    assert all(d.columns == COLUMNS for d in kept[:-1])
    before = {r.doc_id: r.text for r in kept[1].collect()}
    groups = brute(list(before.items()), 5, 80)
    assert {r.doc_id for r in kept[2].collect()} == {i for i, _, c in groups if i == c}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {i for i, t in before.items() for x in items if x and t and sum(n for *_, n in string_tiling.tile(
        string_tiling.tokens_of(x), string_tiling.tokens_of(t))) >= 0.5 * len(string_tiling.tokens_of(x))}
    assert {r.doc_id for r in kept[3].collect()} == {r.doc_id for r in kept[2].collect()} - leaks
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for r in kept[4].collect():
        ids = tok.encode(before[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    result = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(tuple, result), key=str) == sorted(map(tuple, kept[4].collect()), key=str)


@needs_data
def test_stages_on_odd_documents(spark, frame, tmp_path):
    odd = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "12 34", "en", "s", 5), (None, "the words of a text without an id", "en", "s", 3),
           (4, "a long text " * 4000, "en", "s", 9), (5, "plain words stand here for a while", "en", "s", 1), (5, "plain words stand here for a while", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, __language int"
    path = str(tmp_path / "odd")
    frame([(*r, "k", 1) for r in odd], schema).write.parquet(path)
    docs = spark.read.parquet(path)
    assert stages.drop_toxic(spark, docs, SMALL).count() == len(odd)
    assert sorted(str(r.doc_id) for r in stages.drop_unknown_language(spark, docs, SMALL).collect()) == ["4", "5", "5", "None"]
    assert sorted(str(r.doc_id) for r in stages.keep_one_of_group(spark, docs, SMALL).collect()) == ["1", "2", "3", "4", "5", "None"]
    assert stages.drop_contaminated(spark, docs, SMALL).count() == len(odd)
    assert stages.encode(spark, docs, SMALL).count() == len(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    empty = spark.createDataFrame([], docs.schema)
    empty.write.parquet(str(tmp_path / "none"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "none")), SMALL).count() == 0


@needs_data
@pytest.mark.parametrize("name", [q for q in E.queries() if q.startswith("op")])
def test_query_runs(spark, name):
    rows = E.queries()[name](spark, SMALL).collect()
    table = {"op1": "embeddings", "op8": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    if name.startswith("op12_"):
        assert sum(r.depth == 0 for r in rows) == 1
    elif name.startswith("op13_"):
        assert len(rows) == spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert len(rows) == n if not name.startswith("op6_") else 0 < len(rows) < n


@needs_data
def test_contract_columns(spark):
    want = {"op1": "vec_id n_links component_id kept", "op2": "doc_id n_tokens ids_sha256 decoded_sha256", "op3": "doc_id held_out lang_pred score",
            "op4": "doc_id size text_crc32 law shard slot grown_shard", "op5": "doc_id start n_tokens ids_crc32",
            "op7": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8": "page_id host path rule verdict",
            "op10": "doc_id n_shingles component_id", "op11": "doc_id keep_id group_size kept text_sha256",
            "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
            "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}
    for name, f in E.queries().items():
        if name.split("_")[0] in want and name.startswith("op"):
            assert f(spark, SMALL).columns == want[name.split("_")[0]].split()


def test_shingles_keep_their_case_rules():
    assert partition_join.words_of("A\x0bB É\x85x") == ["a".encode(), b"b", "É\x85x".encode()]


NEW = ["op11_exact_dedup", "op12_prefix_trie", "op13_structure_repair"]


@needs_data
@pytest.mark.parametrize("name", NEW)
def test_new_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SMALL)
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@needs_data
def test_unlike_texts_of_one_id_are_not_lost(spark, tmp_path):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, near), (1, "quite another text that has nothing to do with it at all"), (1, near), (2, near + " x"), (None, near), (None, near), (3, "alone it stands")]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    out = stages.keep_one_of_group(spark, spark.read.parquet(str(tmp_path / "d")), SMALL)
    assert sorted(((str(r.doc_id), r.text) for r in out.collect())) == sorted([("1", near), ("1", rows[1][1]), ("None", near), ("None", near), ("3", rows[6][1])])


@needs_data
def test_unknown_languages_go_and_short_clean_texts_stay(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = {10**6: "zzz qqq xxx x7 {}", 10**6 + 1: "你好 世界 这是 一个 测试", 10**6 + 2: "Добрый день, как дела сегодня", 10**6 + 3: "kq wx zj vq qz " * 40}
    more = spark.createDataFrame([(i, t, None, "s", 1) for i, t in odd.items()], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in stages.drop_unknown_language(spark, docs, SMALL).select("doc_id").collect()}
    assert not kept & odd.keys()
    clean = {r.doc_id for r in docs.filter("lang is not null and text rlike '[a-zA-Z]'").collect()}
    assert len(clean - kept) <= 2, clean - kept


def test_language_floors_come_from_all_labelled_rows(spark):
    rows = [(i, "some text here", "en", ("en", 0.8)) for i in range(9000)]
    for n, i in enumerate(range(0, 9000, 450)):  # the least may stand anywhere
        rows[i] = (i, "some text here", "en", ("en", 0.5 - n / 100))
    rows += [(9000, "some text here", None, ("en", 0.01)), (9003, "some text here", "en", ("und", 0.0)), (None, "some text here", "en", ("en", 0.02))]
    judged = spark.createDataFrame(rows, "doc_id long, text string, lang string, v struct<lang_pred: string, score: double>")
    least = min(r[3][1] for r in rows[:9000] if crc32(str(r[0]).encode()) % 3 != 1)
    assert stages.language_floors(judged, "v") == {3: stages.FLOOR_SHARE * least}
