import pytest

from papyrion.sources import page_source, pages


def strict_parser(content):
    if b"bad" in content:
        raise ValueError("no pages")
    return content.decode().split("\f")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("uploads")
    for name, text in {"a.txt": "one\ftwo\fthree", "b.txt": "bad", "c.txt": "", "in/d.txt": "four\f" * 40, "in/k=_x/e.txt": "five", "f.csv": "six", "_g.txt": "seven", ".h.txt": "no"}.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    page_source.register(spark, strict_parser, "strict_files")
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


CONDITIONS = ["true", "page_no < 2", "page_no = 2 OR text = 'four'", "page_no IS NULL", "batch_id LIKE '%/a.txt'", "batch_id LIKE 'x%'", "true"]


@pytest.mark.parametrize("most", [1, 128 << 20])
def test_the_same_rows_as_a_scan_of_the_files(spark, folder, most):
    plain = pages.scan_files(spark, folder, strict_parser, "*.txt").cache()
    assert plain.count() == 3 + 1 + 41 + 1
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW strict_view USING strict_files OPTIONS (path '{folder}', glob '*.txt', maxPartitionBytes '{most}')")
    # One view under one condition after the other, and twice in one query.
    for where in CONDITIONS:
        assert rows_of(spark.sql(f"SELECT * FROM strict_view WHERE {where}")) == rows_of(plain.where(where)), where
    two = spark.sql("SELECT * FROM strict_view WHERE page_no = 2 UNION ALL SELECT * FROM strict_view WHERE page_no = 0")
    assert rows_of(two) == rows_of(plain.where("page_no IN (0, 2)"))
    plain.unpersist()


def test_options_choose_files_and_pages(spark, folder):
    read = lambda **o: spark.read.format("strict_files").options(glob="*.txt", maxPartitionBytes="1", **o).load(f"file://{folder}")
    plain = pages.scan_files(spark, folder, strict_parser, "*.txt")
    assert read().rdd.getNumPartitions() == 4
    assert read(under="in").rdd.getNumPartitions() == 2
    assert rows_of(read(under="in/")) == rows_of(plain.where("batch_id LIKE '%/in/%'"))
    assert rows_of(read(firstPage="1", lastPage="2")) == rows_of(plain.where("page_no BETWEEN 1 AND 2 OR error IS NOT NULL"))
    assert rows_of(spark.read.format("strict_files").option("glob", "a.*").load(folder)) == rows_of(plain.where("batch_id LIKE '%/a.txt'"))


def test_batches_of_rows_are_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(page_source, "BATCH_CHARS", 200)
    reader = page_source.PageReader({"path": folder, "glob": "d.txt"}, strict_parser)
    [files] = reader.partitions()
    made = list(reader.read(files))
    assert len(made) > 10 and sum(b.num_rows for b in made) == 41


def test_empty_and_missing_folders(spark, folder, tmp_path):
    assert spark.read.format("strict_files").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("strict_files").load(f"{tmp_path}/none").count()
    page_source.register(spark)
    assert rows_of(spark.read.format("page_files").load(f"{folder}/a.txt").select("page_no", "text")) == [(0, "one"), (1, "two"), (2, "three")]
