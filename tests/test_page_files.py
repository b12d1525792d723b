"""Inputs of one file per page."""

from pathlib import Path

from catalog.spark_queries import write_texts
from sourceloom.sources.listing import list_files, read_files


def test_one_file_per_row_written_by_tasks(spark, tmp_path):
    texts = ["class A", "class A", None, "", "\u00e9\n\ud83d\ude00 x", "b\r\n"] + [f"class P{i}" for i in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    plain, own = str(tmp_path / "plain"), str(tmp_path / "a" / "_own")
    rows.write.option("maxRecordsPerFile", 1).text(plain)
    write_texts(rows, own)
    write_texts(rows, own)  # as after a retry
    got, want = (sorted(bytes(r.content) for r in read_files(list_files(spark, f, ".TXT")).collect()) for f in (own, plain))
    assert got == want and len(got) == len(texts)
    # Hadoop's writer leaves a check sum beside each file, and starts processes for both.
    assert all(p.suffix == ".txt" for p in Path(own).iterdir())


def test_no_rows_make_an_empty_folder(spark, tmp_path):
    write_texts(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert list_files(spark, str(tmp_path / "none"), ".txt").isEmpty()


def test_folders_that_tasks_cannot_open_are_left_to_spark(spark, tmp_path, monkeypatch):
    from catalog import spark_queries

    monkeypatch.setattr(spark_queries, "can_list", lambda root: False)
    write_texts(spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1), str(tmp_path / "f"))
    assert sorted(p.read_bytes() for p in (tmp_path / "f").glob("*.txt")) == [b"a\n", b"b\n"]
