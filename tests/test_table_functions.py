from papyrion.config import ChunkConfig
from papyrion.operators.split import HashEmbedder, split_pages
from papyrion.sources import table_functions

ROWS = [("a", 0, "One two. Three four! " * 30), ("a", 1, None), (None, 2, "five six seven"), ("b", None, "x " * 900)]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("batch_id", "page_no", "piece", "start_index", "text")) for r in df.collect()), key=repr)


def test_sql_gives_what_the_splitters_give(spark):
    pages = spark.createDataFrame(ROWS, "batch_id string, page_no long, text string")
    pages.createOrReplaceTempView("pages_of_a_test")
    config = ChunkConfig(size=100, overlap=10, min_size=30)
    table_functions.register(spark, config=config)
    fixed = rows_of(split_pages(pages, ChunkConfig(strategy="fixed", size=100, overlap=10)))
    assert rows_of(spark.sql("SELECT * FROM fixed_chunks(TABLE(pages_of_a_test))")) == fixed
    assert rows_of(spark.sql("SELECT * FROM fixed_chunks(TABLE(pages_of_a_test) PARTITION BY batch_id ORDER BY page_no)")) == fixed
    wide = rows_of(split_pages(pages, ChunkConfig(strategy="fixed", size=300, overlap=0)))
    assert rows_of(spark.sql("SELECT * FROM fixed_chunks(TABLE(pages_of_a_test), 300, 0)")) == wide != fixed
    meant = rows_of(split_pages(pages, ChunkConfig(strategy="semantic", size=100, overlap=10, min_size=30), HashEmbedder()))
    assert rows_of(spark.sql("SELECT * FROM semantic_chunks(TABLE(pages_of_a_test))")) == meant
    assert spark.sql("SELECT * FROM fixed_chunks(TABLE(SELECT * FROM pages_of_a_test WHERE false))").count() == 0
