import pytest

from brightloom.errors import EmptyDataset, StepError, UnsupportedFileType
from brightloom.operators import audit_log
from brightloom.sources.file_audit import audit_files
from brightloom.sources.tables import cleaned_path, export_table, format_of, load_table


def test_csv(tmp_path, spark):
    path = tmp_path / "a.csv"
    path.write_text('id,name,score,flag,when,gone\n1,"x, ""q""",1.5,True,2026-01-01,\n2,NA,nan,False,2026-01-02,\n'
                    '3,"two\nlines",,true,n/a,NULL\n')
    df = load_table(spark, str(path))
    assert {f.name: f.dataType.typeName() for f in df.schema} == {
        "id": "long", "name": "string", "score": "double", "flag": "boolean", "when": "string", "gone": "double"}
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == 'x, "q"' and rows[1]["name"] is None and rows[2]["name"] == "two\nlines"
    assert rows[1]["score"] is None and rows[2]["when"] is None


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip(tmp_path, spark, people, fmt):
    path = export_table(people, cleaned_path(str(tmp_path), "people", fmt))
    df = load_table(spark, path)
    assert (df.count(), len(df.columns)) == (100, 6)
    assert df.where("age is null").count() == 3


def test_json_array(tmp_path, spark):
    path = tmp_path / "a.json"
    path.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert load_table(spark, str(path)).count() == 2


def test_refusals(tmp_path, spark):
    with pytest.raises(UnsupportedFileType):
        format_of("a.txt")
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(EmptyDataset):
        load_table(spark, str(tmp_path / "e.csv"))
    with pytest.raises(StepError):
        export_table(spark.createDataFrame([], "a int"), str(tmp_path / "x.csv"))


def test_file_audit(tmp_path, spark):
    files = {
        "good.csv": b"a,b\n1,2\n", "zip.csv": b"PK\x03\x04rest", "null.csv": b"ab\x00c,d", "good.json": b'\n [1]',
        "bad.json": b"hello", "bad.parquet": b"ABCDxxxx", "good.parquet": b"PAR1xxxx", "good.xlsx": b"PK\x03\x04x",
        "bad.xlsx": b"a,b", "note.txt": b"x", "big.csv": b"1" * 500, "parquet.csv": b"PAR1,x",
        "hex.csv": b"\x50\x0a\x03,d",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = audit_files(spark, str(tmp_path), max_bytes=400).collect()
    verdicts = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in rows}
    assert {n for n, v in verdicts.items() if v == "ok"} == {
        "good.csv", "good.json", "good.parquet", "good.xlsx", "hex.csv"}
    assert verdicts["note.txt"] == "unsupported file type" and verdicts["big.csv"] == "file too large"
    assert verdicts["null.csv"] == "binary content in a CSV file"


def test_file_audit_of_a_huge_file(tmp_path, spark):
    """Two files over 2 GiB, with holes, and a name with blanks."""
    for name, head in (("huge.csv", b"a,b"), ("no table.parquet", b"ABCD")):
        with open(tmp_path / name, "wb") as file:
            file.write(head)
            file.seek((1 << 31) + 10)
            file.write(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in audit_files(spark, str(tmp_path)).collect()}
    assert got == {"huge.csv": "binary content in a CSV file", "no table.parquet": "not a Parquet file"}


def test_audit_tables(tmp_path, spark):
    folder = str(tmp_path)
    rows = [("s1", 1, "missing", '{"column": "a"}'), ("s1", 2, "scaling", "{}"), ("s2", 1, "missing", None)]
    audit_log.append(spark.createDataFrame(
        rows, "session_id string, step_number int, operation_type string, parameters string"), "operations", folder)
    stored = audit_log.read(spark, "operations", folder)
    assert stored.where("id is not null and created_at is not null").count() == 3
    assert audit_log.active_operations(stored).count() == 3
    undone = audit_log.deactivate_last(stored)
    left = [(r["session_id"], r["step_number"]) for r in audit_log.active_operations(undone).collect()]
    assert left == [("s1", 1)]
    again = audit_log.deactivate_last(undone)
    assert audit_log.active_operations(again).count() == 0
    assert again.selectExpr("from_json(parameters, 'column string, is_active boolean, undone_at string') j").where(
        "j.is_active = false and j.undone_at is not null").count() == 3
    with pytest.raises(ValueError):
        audit_log.append(spark.createDataFrame([(1,)], "zzz int"), "reports", folder)
    feedback = spark.createDataFrame([("s1", "kmeans", True)], "session_id string, recommended_algorithm string, accepted boolean")
    audit_log.append(feedback, "recommendation_feedback", folder)
    assert audit_log.read(spark, "recommendation_feedback", folder).first()["accepted"]
