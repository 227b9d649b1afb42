from leafmill.sources import pdf
from leafmill.streaming.files import append_objects


def test_only_new_files_are_parsed(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(pdf.write_file([b"q Q"] * (k + 1)))
    append_objects(spark, folder, table, checkpoint, 2).awaitTermination()
    pages = lambda: spark.read.parquet(table).where("type = 'Page'").count()
    assert pages() == 6
    (tmp_path / "in" / "3.pdf").write_bytes(pdf.write_file([b""]))
    append_objects(spark, folder, table, checkpoint, 2).awaitTermination()
    assert pages() == 7
