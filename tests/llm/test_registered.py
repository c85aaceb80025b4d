"""The queries as registered, on whole small tables, and the pipeline's chain of stages."""

import hashlib
import os
import re
import struct
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from compare import oracle_rows, spark_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from tideline.llm import bpe, common  # noqa: E402
from tideline.llm.registry import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_beside_sql(spark, name):
    cols, rows = spark_rows(QUERIES[name](spark, SF))
    want_cols, want = oracle_rows(ORACLES[name], SF)
    assert cols == want_cols
    assert rows == want


def texts(spark):
    return {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_byte_bpe_query(spark):
    import public_tokenizers as P
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    want = {}
    for i, t in texts(spark).items():
        ids = own.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_byte_bpe"](spark, SF).collect()} == want


def test_secret_query_base(spark):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for i, t in texts(spark).items():
        # letters there in either case: A-Z alone, so the text is folded by hand
        low = t.translate({c: c + 32 for c in range(65, 91)})
        found = [(m.start(), 0, m.end()) for m in assign.finditer(low) if len(m[1]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        want[i] = (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op6_secret_scan"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["op1_decontamination", "op3_toxicity", "op4_quality", "op5_edit_token_counts", "op10_line_dedup"])
def test_runs_over_the_whole_table(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    ids = set(texts(spark))
    assert {r.doc_id for r in rows} <= ids and (name == "op1_decontamination" or len(rows) == len(ids))
    if name in ("op3_toxicity", "op4_quality"):
        import zlib

        cut = {"op3_toxicity": 0.7, "op4_quality": 0.5}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)


def words(k, n, tag):
    return " ".join(f"{tag}{k}w{j}" for j in range(n))


@pytest.fixture
def small(spark, tmp_path):
    """Documents of every kind, with columns whose names the stages use themselves, and what is left of each after every stage."""
    passage = "\n".join(words(i, 20, "pass") for i in range(3))
    item = words(0, 30, "bench")
    clean = {i: f"{words(i, 60, 'clean')}\n{words(i, 30, 'more')}" for i in range(1, 41)}
    toxic = {i: f"{words(i, 20, 'tx')} zonk {words(i, 5, 'ty')} quux zonk {words(i, 9, 'tz')}" for i in range(100, 160)}
    near = words(7, 100, "near")
    rows = clean | toxic | {200: f"{words(200, 30, 'a')}\n{passage}", 201: f"{words(201, 30, 'b')}\n{passage}\n{words(201, 30, 'c')}", 202: passage}
    rows |= {300: near, 301: near.replace("near7w50", "other"), 302: near, 400: f"{words(400, 20, 'd')} {item} {words(400, 20, 'e')}", 500: "", 501: None}
    first = f"{words(200, 30, 'a')}\n{passage}"
    kept = clean | {200: first, 201: f"{words(201, 30, 'b')}\n{words(201, 30, 'c')}", 300: near, 301: rows[301], 302: near, 400: rows[400], 500: "", 501: None}
    stages = [rows.keys() - toxic.keys(), kept.keys() - {302}, kept.keys() - {301, 302}, kept.keys() - {301, 302, 400}]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_removed string, gone int, _d int, row int, ids string"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "mine", "keep", 1, 2, 3, "x") for i, t in rows.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, kept, stages


def test_pipeline_stage_by_stage(spark, small):
    folder, rows, kept, want = small
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = common.materialize(stage(spark, docs, folder), "test")
        assert docs.columns == columns, name
        got = docs.collect()
        left = {r.doc_id: r.text for r in got}
        if name == "line dedup":
            assert set(left) - {301, 302} == ids - {301} and all(left[i] == kept[i] for i in left), name  # equal lines of copies go here or with the copies
        else:
            assert set(left) == ids & set(left) and ids - set(left) <= {301, 302}, name
        assert all((r.score, r.n_removed, r.gone, r._d, r.row, r.ids) == ("mine", "keep", 1, 2, 3, "x") for r in got), name
    assert 201 in left and passage_free(left[201])


def passage_free(text):
    return "pass" not in text


def test_pipeline_rows(spark, small):
    folder, rows, kept, want = small
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == want[3]
    ranks = bpe.load_ranks(bpe.default_path())
    by_id = {v: k for k, v in ranks.items()}
    for i, r in got.items():
        ids = struct.unpack(f"<{r.n_tokens}I", r.ids)
        assert r.round_trip and b"".join(by_id[x] for x in ids).decode() == (kept[i] or "")


def test_pipeline_of_nothing(spark, small, tmp_path):
    folder, *_ = small
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        common.table(spark, folder, name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
