"""Files, documents and names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from markspan.functions import text
from markspan.operators import textparse
from markspan.sources import artifacts, intake, results


def test_manifest_of_real_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One.PDF").write_bytes(b"x" * 10)
    (tmp_path / "b.png").write_bytes(b"x")
    got = intake.check_files(intake.read_manifest(spark, str(tmp_path)), max_bytes=9)
    reasons = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in got.collect()}
    assert reasons == {"One.PDF": intake.TOO_LARGE, "b.png": intake.NOT_PDF}


def test_documents_on_disk(spark, tmp_path):
    (tmp_path / "good.json").write_text('{\n "a": "1"\n}')
    (tmp_path / "bad.json").write_text('{"a": ')
    rows = {r.path.rsplit("/", 1)[1]: r for r in results.read_documents(spark, str(tmp_path)).collect()}
    assert rows["good.json"].fields == {"a": "1"} and rows["good.json"].raw is None
    assert rows["bad.json"].fields is None and rows["bad.json"].raw == '{"a": '


def test_names(spark):
    def one(expr, value):
        return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]

    assert one(text.safe_token, " ..a b/ü.pdf_ ") == "a_b_.pdf"
    assert one(text.safe_token, "###") == "unknown"
    assert one(text.safe_token, None) == "unknown"
    assert one(text.safe_token, "x" * 200) == "x" * 80
    assert one(text.stem, "/up/a.b.pdf") == "a.b"
    assert one(text.stem, ".hidden") == ".hidden"
    assert one(text.safe_name, "/up/my exam.pdf") == "my_exam.pdf"
    assert one(text.preview, "y" * 81) == "y" * 80 + "..."
    assert one(text.preview, "y" * 80) == "y" * 80
    assert one(text.word_count, "a  b c\nd ") == 4
    assert one(text.finite_number, " 1.5 ") == 1.5
    assert one(text.finite_number, "NaN") is None
    assert one(text.label_from_key, "candidate_number") == "Candidate Number"


def test_text_answers(spark):
    sample = "Question 2: b\nQ1) A\n1. C\nESSAY QUESTION 4: one\n two SHORT ANSWER 5 - ESSAY 6:\n"
    df = spark.createDataFrame([(1, sample)], "doc_id bigint, text string")
    assert {(r.question, r.answer) for r in textparse.choices(df).collect()} == {(1, "A"), (2, "B"), (5, "E")}
    assert {(r.question, r.response) for r in textparse.responses(df).collect()} == {(4, "one\n two")}


def test_legacy_document(spark):
    doc = '{"multiple_choice": [{"question": 1, "answer": "A"}], "free_response": [{"question": 9, "response": "two words"}]}'
    df = spark.createDataFrame([(1, doc), (2, '{"free_response": []}')], "submission_id bigint, document string")
    got = {(r.kind, r.question, r.value, r.word_count) for r in textparse.legacy_rows(df, "submission_id", "document").collect()}
    assert got == {("multiple_choice", 1, "A", None), ("free_response", 9, "two words", 2)}


def test_documents_in_parts_are_joined_again(spark, tmp_path):
    """A large document is cut into parts, small ones share a task, and what the manifest lacks is not read."""
    size = {1: 3, 2: 2500, 3: 1, None: 4}
    rows = [(d, s, n, f"{d}/{s}/{n} é") for d, k in size.items() for s in (0, 1) for n in range(k)]
    lines = spark.createDataFrame(rows, "submission_id bigint, section int, n bigint, line string").repartition(7)
    folder = str(tmp_path / "docs")
    results.write_source_documents(lines, folder, 400)
    (tmp_path / "docs" / "documents" / "submission_id=9").mkdir()
    (tmp_path / "docs" / "documents" / "submission_id=9" / "part-00000-x.txt").write_text("left by a stopped job\n")
    parts = results.read_source_documents(spark, folder)
    per = {r.submission_id: r["count"] for r in parts.groupBy("submission_id").count().collect()}
    assert per.keys() == size.keys() and per[2] > 5 and per[1] == 1
    assert {r.submission_id: r.lines for r in parts.groupBy("submission_id").agg(F.sum("lines").alias("lines")).collect()} == {d: 2 * k for d, k in size.items()}
    got = {r.submission_id: r.document for r in results.document_texts(parts).collect()}
    assert got == {d: "".join(f"{d}/{s}/{n} é\n" for s in (0, 1) for n in range(k)) for d, k in size.items()}


def run_pages(spark, runs):
    rows = [(f"sub {r}", f"up/Exam {r}.pdf", p, f"x/p{p}.png", None if p == 2 else "two words", "broken" if p == 2 else None, 0.0 if p == 3 else 80.5, 4) for r in runs for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "context_id string, source_filename string, page int, image_path string, text string, error string, average_confidence double, confidence_samples bigint")
    return df.withColumn("created_at", F.lit("2024-03-05 06:07:08").cast("timestamp_ntz"))


def test_runs_are_read_once_their_summary_is_stored(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    artifacts.write_runs(run_pages(spark, [1, 2]), folder)
    write, calls = artifacts.append_by_day, []

    def stop(df, at, place):
        calls.append(place)
        if len(calls) == 2:
            raise RuntimeError
        write(df, at, place)

    monkeypatch.setattr(artifacts, "append_by_day", stop)
    with pytest.raises(RuntimeError):
        artifacts.write_runs(run_pages(spark, [2, 3]), folder)
    monkeypatch.undo()
    assert artifacts.read_runs(spark, folder).count() == 2 and artifacts.read_pages(spark, folder).count() == 6
    for _ in range(2):
        artifacts.write_runs(run_pages(spark, [2, 3]), folder)
        assert artifacts.read_runs(spark, folder).count() == 3 and artifacts.read_pages(spark, folder).count() == 9
    one = artifacts.read_runs(spark, folder).filter("context_id = 'sub 3'").first()
    assert (one.run_dir, one.pages_total, one.pages_ok, one.average_confidence) == ("2024/03/05/sub_3/Exam_3/060708", 3, 2, 80.5)
    bad = artifacts.read_pages(spark, folder).filter("page = 2").first()
    assert (bad.status, bad.error, bad.word_count, bad.average_confidence, bad.confidence_samples, bad.text, bad.text_file) == ("error", "broken", 0, 0.0, 0, "", "pages/page_002.txt")
