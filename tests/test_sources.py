import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxmetric.sources import ingest, tables, upload

EXPORT = (
    "SURVEY;NPS;NPS_TOELICHTING;GESLACHT;LEEFTIJD;ABOJAREN;CREATIE_DT;TITEL_TEKST;TITEL\n"
    "Q1;9;\"goed; echt\nwaar\";V;30-39;2;01/02/2024;Krant;\n"
    ";x;;;;;;;\n"
    "Q1;abc;nvt;;;;2024-02-01;;Blad\n"
    "Q1;4.7;N.v.t.;;;;31/31/2024;;Blad\n"
    "Q1;4.7;  duur  ;;;;1-2-2024;;Blad\n"
)


@pytest.fixture
def export_file(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT, encoding="utf-8")
    return str(path)


def test_delimiter(spark, export_file, tmp_path):
    assert ingest.detect_delimiter(spark, export_file) == ";"
    other = tmp_path / "one.csv"
    other.write_text("SURVEY,NPS\nA,1\nB,2\n")
    assert ingest.detect_delimiter(spark, str(other)) == ","


def test_export_file(spark, export_file):
    rows = ingest.normalize(ingest.number_rows(ingest.read_csv(spark, export_file)))
    valid = ingest.valid_rows(rows).orderBy("row_number").collect()
    assert [(r.row_number, r.nps_score, r.nps_explanation, r.creation_date, r.title_text) for r in valid] == [
        (1, 9, "goed; echt\nwaar", dt.date(2024, 2, 1), "Krant"),
        (5, 4, "duur", dt.date(2024, 2, 1), "Blad"),
    ]
    messages = [r.message for r in ingest.rejected_rows(rows).orderBy("row_number").collect()]
    assert messages == [
        "Row 2: Missing SURVEY",
        "Row 3: Invalid NPS: abc",
        "Row 4: Invalid CREATIE_DT: 31/31/2024",
    ]
    assert tuple(ingest.ingest_report(rows).first()) == (2, 3, 2)
    assert '"NPS":"9"' in valid[0].raw_data


def test_row_numbers_per_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_text("SURVEY,NPS\n" + "".join(f"S{n},{i}\n" for i in range(n + 4)))
    rows = ingest.number_rows(ingest.read_csv(spark, str(tmp_path), ",")).collect()
    for r in rows:
        assert int(r.NPS) + 1 == r.row_number


def test_missing_headers(spark):
    df = spark.createDataFrame([("A", "9")], "survey string, ` nps ` string")
    assert ingest.missing_headers(df) == ["CREATIE_DT"]
    assert ingest.normalize(df).first().error == "Invalid CREATIE_DT: None"
    with pytest.raises(ValueError):
        ingest.load_responses(df.select("survey"), strict=False)


def test_golden_export(spark):
    from voxmetric.operators.nps import summary

    scores = [9, 7, 4, 10, 6, 8, 3, 9, 5, 8]
    df = spark.createDataFrame([("S", str(s), "01/01/2024") for s in scores], "SURVEY string, NPS string, CREATIE_DT string")
    got = summary(ingest.load_responses(df)).first()
    assert (got.total_responses, got.nps_score, got.avg_score) == (10, -10.0, 6.9)
    assert (got.promoters, got.passives, got.detractors) == (3, 3, 4)


def test_file_format():
    assert ingest.file_format("A.XLSX") == "xlsx"
    assert ingest.file_format("a.dat") == "csv"


def test_structure():
    s = upload.detect_structure(["response", "rating", "date", "department"])
    assert s.is_multi_question and s.question_columns == ("response",)
    s = upload.detect_structure(["participant_id", "answer_text"])
    assert not s.is_multi_question and s.main_column == "answer_text"
    assert s.question_columns == ("answer_text",)


def test_upload_file(spark, tmp_path):
    path = tmp_path / "survey.csv"
    path.write_text(
        "participant_id,question_1_like,question_2_fix,city\n"
        'p1,"good, really good",too short,Gent\n'
        "p2,tiny,tiny,\n"
        "p3, exactly10c ,this one is long enough,\n"
    )
    frame, s = upload.read_upload(spark, str(path))
    rows = upload.to_long(frame, s).orderBy("row_number", "question_order").collect()
    assert [(r.row_number, r.question_text, r.response_text, r.metadata) for r in rows] == [
        (2, "question_1_like", "good, really good", {"participant_id": "p1", "city": "Gent"}),
        (3, "question_2_fix", "this one is long enough", {"participant_id": "p3"}),
    ]
    head = upload.header_record(spark, "s", "survey.csv", s, 2).first()
    assert head.name == "survey" and head.is_multi_question


def test_short_answer_boundary(spark):
    s = upload.detect_structure(["participant_id", "response_text"])
    df = spark.createDataFrame([("s", 1, "a", "1234567890"), ("s", 2, "b", "12345678901")], "survey_id string, file_order bigint, participant_id string, response_text string")
    assert [r.participant_id for r in upload.keep_answered(df, s).collect()] == ["b"]


def test_dense_index_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(upload, "_CHUNK", 7)
    df = spark.range(100).filter("id % 3 <> 0").select(F.lit("s").alias("g"), F.col("id").alias("o"))
    got = sorted((r.o, r.position) for r in upload.dense_index(df, "g", "o").collect())
    assert [p for _, p in got] == list(range(len(got)))


def test_append_and_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 2, 5))], "id bigint, creation_date date")
    tables.append_responses(df, path)
    tables.append_responses(df.filter("id = 1"), path)
    assert tables.scan(spark, path, ["id"], F.col("creation_month") == "2024-01").count() == 2


def test_upsert_table_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "e")
    old = spark.createDataFrame([(i, "old") for i in range(20)], "response_id bigint, model string")
    tables.write_keyed(old, path, "response_id", 4)
    parents = spark.range(25).withColumnRenamed("id", "id")
    new = spark.createDataFrame([(3, "new"), (22, "new"), (99, "orphan")], "response_id bigint, model string")
    for _ in range(2):
        tables.upsert_table(new, path, "response_id", 4, parents)
        rows = {r.response_id: r.model for r in spark.read.parquet(path).collect()}
        assert spark.read.parquet(path).count() == len(rows) == 21
        assert rows[3] == rows[22] == "new" and rows[4] == "old" and 99 not in rows
