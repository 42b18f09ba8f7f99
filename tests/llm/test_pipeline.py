"""The registered corpus queries and the pipeline, over whole small tables."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from test_corpus import VOCABULARY, expected_ids, plain_components, plain_distance, plain_fingerprint, plain_repeats

import corpus_pipeline
from weftgraph.llm import decontaminate, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select * from '{FOLDER}/documents.parquet' order by doc_id").df()


def test_packing_and_shards_hold_the_same_ids(spark, documents):
    want = {d: expected_ids(t, 0) for d, t in zip(documents.doc_id, documents.text)}
    pieces = queries.op1_packing(spark, FOLDER).toPandas()
    for d, part in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for r in part.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[d])
    sizes = pieces.groupby("sequence_id").length.sum()
    assert set(pieces.doc_id) == set(want) and sizes.max() <= 1024 and sizes.sum() > 0.95 * 1024 * len(sizes)
    at = 0
    for r in queries.op8_token_shards(spark, FOLDER).toPandas().sort_values("doc_id").itertuples():
        ids = np.append(want[r.doc_id][:-1], 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_dedup_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    found, want = queries.op2_exact_dedup(spark, FOLDER).toPandas(), con.sql(queries.oracle_sql()["op2_exact_dedup"]).df()
    assert found.sort_values("doc_id").values.tolist() == want[found.columns].sort_values("doc_id").values.tolist()


def test_simhash_and_repeats(spark, documents):
    prints = {d: plain_fingerprint(t) for d, t in zip(documents.doc_id, documents.text)}
    want = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, FOLDER).toPandas().itertuples()} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    rows = plain_repeats(list(zip(documents.doc_id, documents.text)), 100)
    assert {tuple(r) for r in queries.op7_suffix_dedup(spark, FOLDER).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()} == set(rows)


def test_language_id_on_held_out_documents(spark, documents):
    found = queries.op9_language_id(spark, FOLDER).toPandas().merge(documents[["doc_id", "lang"]])
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    held = found[found.held_out & found.lang.notna()]
    assert len(found) == len(documents) and (held.lang == held.lang_pred).mean() > 0.97


def leaks(documents):
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    out = set()
    for d, t in zip(documents.doc_id, documents.text):
        words = decontaminate.words_of(t)
        held = set(words)
        for k, x in items:
            item = decontaminate.words_of(x)
            if sum(w in held for w in item) >= 0.8 * len(item) and plain_distance(item, words, 0) <= int(0.2 * len(item)):
                out.add((d, k))
    return out


def test_decontamination_against_all_pairs(spark, documents):
    assert {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, FOLDER).collect()} == leaks(documents)


def test_pages(spark):
    found = queries.op6_html_extraction(spark, FOLDER).toPandas()
    assert len(found) == 50 and (found.text.str.len() == found.n_chars).all() and found.n_chars.min() > 0
    verdicts = queries.op3_url_filter(spark, FOLDER).toPandas()
    assert set(verdicts.verdict) <= {"allow", "block"} and len(verdicts) == 50
    assert len(queries.op4_token_counts(spark, FOLDER).collect()) == 200


def shingles(text, width=5):
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def test_pipeline(spark, documents):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and VOCABULARY
    left = documents[[any(c.isalpha() for c in t) for t in documents.text]]
    left = left.sort_values("doc_id").groupby("text").tail(1)
    sets = {d: shingles(t) for d, t in zip(left.doc_id, left.text)}
    roots = plain_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(roots.values())) < len(roots)  # there are near copies to find
    left = left[left.doc_id.isin(set(roots.values()))]
    left = left[~left.doc_id.isin({d for d, _ in leaks(left)})]
    found = corpus_pipeline.run(spark, FOLDER).toPandas()
    want = {d: expected_ids(t, 0) for d, t in zip(left.doc_id, left.text)}
    assert set(found.doc_id) == set(want) and found.length.sum() == sum(map(len, want.values()))
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in found.itertuples())


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids, clashing columns, no rows."""
    prose = [" ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60)) for i in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(3, prose[3], "en"), (40, prose[4], "en"), (50, None, "en"), (51, "", None), (None, "a row without a number", "en"), (60, "12 34", "en")]
    clash = "kept string, id string, keys string, grp string, `__lang_pred` string"
    docs = spark.createDataFrame([(*r, *["c"] * 5) for r in rows], f"doc_id bigint, text string, lang string, {clash}")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "nothing that stands there at all"), (1, None)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").toPandas()
    ids = {None if i != i else int(i) for i in found.doc_id}
    assert ids == {None, *range(12), 40} - {4} and len(found[found.doc_id == 3]) == 1
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, f"file://{tmp_path}")
        assert stages.columns == docs.columns and stage(spark, docs.where("false"), f"file://{tmp_path}").count() == 0
    assert corpus_pipeline.pack(spark, docs.where("false"), "").count() == 0
