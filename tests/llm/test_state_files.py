"""What the stateful dedup writes for its state: every file on a local file system costs processes (chmod, readlink) in the executors."""

from __future__ import annotations

from weftgraph.llm import exact_dedup


def test_state_has_no_second_checksums(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id bigint, text string").repartition(3)
    found = exact_dedup.dedup_table(docs, state_dir=f"file://{tmp_path}/state").toPandas()
    assert found.kept.sum() == 40 and found.group_size.sum() == 20 * 3 * 3 + 20 * 2 * 2
    state = list((tmp_path / "state" / "stream" / "state").rglob("*.changelog"))
    assert state and not [p for p in (tmp_path / "state" / "stream").rglob("*.crc") if not p.name.startswith(".")]
