from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausemill.session import work_dir
from clausemill.sources import commits, files, sinks
from clausemill.streaming import ingest, status


def test_upload_checks_on_real_files(spark, tmp_path):
    (tmp_path / "good.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "bad.pdf").write_bytes(b"PK..")
    (tmp_path / "note.txt").write_bytes(b"%PDF")
    (tmp_path / "long.pdf").write_bytes(b"%PDF" + b"x" * 100)
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "bad.pdf").write_bytes(b"%PDF of the same name")
    names = [p for p in tmp_path.rglob("*") if p.is_file()]
    announced = spark.createDataFrame([(str(p.relative_to(tmp_path)), p.stat().st_size) for p in names], "filename string, length long")
    announced = announced.union(spark.createDataFrame([("gone.pdf", None)], announced.schema))
    rows = files.read_files(spark, str(tmp_path), announced, max_bytes=50)
    assert rows.count() == len(names) + 1 and rows.where("length > 50 and content is not null").isEmpty()
    got = {r.filename: r.error for r in files.validate_uploads(rows, max_bytes=50).collect()}
    assert got == {
        "good.PDF": None, "bad.pdf": "Uploaded file is not a valid PDF", "note.txt": "Unsupported file type. Only PDF uploads are accepted.",
        "long.pdf": "Uploaded file exceeds the maximum size of 50 bytes", "empty.pdf": "Uploaded file is empty",
        "gone.pdf": "PDF file not found: 'gone.pdf'", "more/bad.pdf": None,
    }


def test_manifest(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps([
        {"filename": "KYC - NBFCs.pdf", "title": "KYC", "regulator": "SEBI", "applicability": ["NBFC"], "source_type": "x"},
        {"filename": "b.pdf", "title": "B"},
    ]))
    names = spark.createDataFrame([("a.pdf",), ("B.pdf",), ("b.pdf",), ("KYC - NBFCs.pdf",)], "filename string")
    got = files.apply_manifest(names, files.read_manifest(spark, str(tmp_path / "manifest.json"))).collect()
    assert [(r.filename, r.title, r.regulator, r.source_type) for r in got] == [
        ("KYC - NBFCs.pdf", "KYC", "SEBI", "x"), ("a.pdf", None, "RBI", "regulatory_document"),
        ("B.pdf", None, "RBI", "regulatory_document"), ("b.pdf", "B", "RBI", "regulatory_document"),
    ]


CLAUSES = "version_id long, text string"


def stored(spark, path):
    return sorted(((r.version_id, r.text) for r in sinks.version_clauses(spark, path, CLAUSES).collect()), key=repr)


def test_replacing_a_version_leaves_the_others(spark):
    path = work_dir(spark, "t")
    assert stored(spark, path) == []
    sinks.replace_version_clauses(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], CLAUSES), path)
    sinks.replace_version_clauses(spark.createDataFrame([(1, "z"), (None, "m")], CLAUSES), path)
    assert stored(spark, path) == [(1, "z"), (2, "c"), (None, "m")]
    none, batch = spark.createDataFrame([], CLAUSES), spark.createDataFrame([(1,), (3,), (None,)], "version_id long")
    for _ in range(2):
        sinks.replace_version_clauses(none, path, batch)
        assert stored(spark, path) == [(2, "c")]


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, monkeypatch):
    path = work_dir(spark, "t")
    sinks.replace_version_clauses(spark.createDataFrame([(1, "a")], CLAUSES), path, batch="b0")
    changed = spark.createDataFrame([(1, "z")], CLAUSES)

    def dies(self, commit):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(commits.CommitLog, "_publish", dies)
        with pytest.raises(RuntimeError, match="lost"):
            sinks.replace_version_clauses(changed, path, batch="b1")
    assert stored(spark, path) == [(1, "a")]
    assert sinks.replace_version_clauses(changed, path, batch="b1")
    assert stored(spark, path) == [(1, "z")]
    assert not sinks.replace_version_clauses(spark.createDataFrame([(1, "other")], CLAUSES), path, batch="b1")
    assert stored(spark, path) == [(1, "z")]
    # The folder of the run that died and the replaced batch go, names of batches stay known.
    sinks.compact_version_clauses(spark, path, CLAUSES)
    log = commits.CommitLog(spark, path)
    assert stored(spark, path) == [(1, "z")] and len(log.visible()) == 1 and len(list((Path(path) / "data").iterdir())) == 1
    assert not sinks.replace_version_clauses(spark.createDataFrame([(1, "late")], CLAUSES), path, batch="b0")


def test_one_of_two_writers_gets_the_commit(spark):
    path = work_dir(spark, "t")
    log = commits.CommitLog(spark, path)
    log.commit("b0", {"rows": spark.range(3)})
    second = commits.Commit(0, "b1", "data/x", ("rows",), False)
    with pytest.raises(commits.CommitConflict):
        log._publish(second)
    assert [c.batch for c in log.commits()] == ["b0"] and log.read("rows", "id long").count() == 3


def test_chunks_are_stored_once(spark):
    path, schema = work_dir(spark, "t"), "document_id long, chunk_index int, content string, organization_id long"
    rows = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 1), (1, 1, "c", 1)], schema)
    for name in ("x", "x", "y"):
        sinks.append_chunks(rows, path, batch=name)
    got = sorted((r.document_id, r.chunk_index, r.content) for r in sinks.stored_chunks(spark, path, schema).collect())
    assert got == [(1, 0, "a"), (1, 1, "c")]


def test_upsert_replaces_whole_points(spark):
    schema = "id int, payload string, batch_no int, position int"
    stored = spark.createDataFrame([(1, "old", 0, 0), (2, "kept", 0, 1)], schema)
    batch = spark.createDataFrame([(1, "first", 1, 0), (1, None, 1, 1), (3, "new", 1, 2)], schema)
    assert sorted((r.id, r.payload) for r in sinks.upsert_vectors(stored, batch).collect()) == [(1, None), (2, "kept"), (3, "new")]


def pages_of(batch):
    return batch.select("doc_id", F.lit(1).alias("page_number"), "text")


def test_ingest_takes_every_content_once_over_several_runs(spark, tmp_path):
    landing = str(tmp_path / "landing")
    path, checkpoint = work_dir(spark, "ingest"), str(tmp_path / "checkpoint")
    schema = "doc_id long, text string"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing).withColumn("content_hash", F.sha2("text", 256))
        ingest.stream_ingest(stream, pages_of, path, checkpoint).awaitTermination()
        return {r.version_id: (r.status, r.error_code, r.clause_count) for r in ingest.ingested_versions(spark, path).collect()}

    first = run((1, "1. Keep the records"), (2, "1. Keep the records"), (3, " "), (4, "short"))
    assert first == {1: ("completed", None, 1), 3: ("failed", "EMPTY_DOCUMENT", 0), 4: ("failed", "CLAUSE_SPLITTING_FAILED", 0)}
    second = run((5, "1. Keep the records"), (6, "2. Review them\n(a) every year"), (7, None))
    assert second == {**first, 6: ("completed", None, 2), 7: ("failed", "EMPTY_DOCUMENT", 0)}


def test_status_stream_equals_the_batch_result(spark, tmp_path):
    landing, path = str(tmp_path / "events"), work_dir(spark, "status")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    rows = spark.sql(
        "SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id * 7 % 500)) AS ts, "
        "id % 13 AS user_id, element_at(array('signup', 'view', 'purchase', 'error'), int(id * 5 % 4) + 1) AS event_type FROM range(400)"
    )
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).write.mode("append").parquet(landing)
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(landing)
        status.stream_job_status(events, path, str(tmp_path / "checkpoint")).awaitTermination()
    want = status.latest_status(status.status_events(rows)).collect()
    got = status.current_status(spark, path).collect()
    key = lambda r: (r.entity_id, r.status, r.updated_at, r.n_events)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 13
