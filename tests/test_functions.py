import zipfile

from pyspark.sql import functions as F

from rankloom.functions import scoring, text
from rankloom.operators import relational
from rankloom.sources import pages
from rankloom.streaming import links


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_url_keys(spark):
    cases = {
        "HTTPS://WWW.Example.com//a//b/?utm_source=x&b=2&A=1#top": "https://example.com/a/b?A=1&b=2",
        "https://example.com/a).": "https://example.com/a", '"https://example.com/"': "https://example.com", "NaN": "", "": "", "Not A Url/": "not a url",
    }
    for raw, want in cases.items():
        assert one(spark, text.url_key, raw) == want
        assert one(spark, text.url_key, want) == want
    assert one(spark, text.url_key, None) == ""
    assert one(spark, text.url_key_plain, "https://www.dice.com/Job/1/?a=b#c") == "https://dice.com/job/1"


def test_text_functions(spark):
    assert one(spark, text.tokens, "PySpark and Spark SQL, c# on AWS Glue; node.js v1.2") == ["spark", "spark", "sql", "glue", "nodejs", "v1.2"]
    assert one(spark, lambda x: text.label_value(x, "Location"), "Title: x\n  location -  New York  \nz") == "New York"
    assert one(spark, text.latex_escape, r"50% \ a_b {x}") == r"50\% \textbackslash{} a\_b \{x\}"
    assert one(spark, lambda x: text.phrase_count(x, "c++"), "c++ and c++, xc++ c++y") == 2
    assert one(spark, text.years_required, "3-5 years; at least 4 years of experience; 40 years") == 3.0
    assert one(spark, text.years_required, "7+ years of experience, 9 years") == 7.0
    assert one(spark, text.years_required, "40 years old, 6 yrs") == 6.0
    assert one(spark, text.safe_file_name, "a b/c:d") == "a_b_c_d"
    assert one(spark, text.title_key, " Sr. Data-Engineer (C++)  ") == "sr. data-engineer c++"


def test_score_bounds(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (90.0, 10.0), (3.0, 4.0), (None, 5.0)], "a double, b double")
    got = [r[0] for r in rows.select(scoring.experience_score(F.col("a"), F.col("b"))).collect()]
    assert got == [75.0, 100.0, 67.5, 0.0]


def test_upsert_is_idempotent(spark):
    master = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4), ("C", 5)], "url string, n int")
    once = relational.upsert(master, new, "url", "n")
    assert sorted(map(tuple, once.collect())) == [("C", 5), ("a", 1), ("b", 2), ("c", 3)]
    assert sorted(map(tuple, relational.upsert(once, new, "url", "n").collect())) == sorted(map(tuple, once.collect()))


def test_crawl_stops_at_the_first_page_without_news(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (1, "a"), (2, "a"), (3, "c")], "page_no int, link string")
    assert sorted(r.link for r in pages.crawled(rows).collect()) == ["a", "b"]


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "A.txt").write_text("hello")
    (tmp_path / "c.pdf").write_text("?")
    (tmp_path / "~$b.docx").write_text("?")
    got = {r.name: (r.ord, r.text, r.error) for r in pages.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"A.txt": (1, "hello", None), "b.docx": (2, "one\nx | y", None), "c.pdf": (3, None, "unsupported file type: .pdf")}


def test_stream_appends_only_new_links(spark, tmp_path):
    source, master = str(tmp_path / "in"), str(tmp_path / "master")
    for rows in ([("a", 1), ("b", 2), ("a", 3)], [("b", 5), ("c", 4)]):
        spark.createDataFrame(rows, "url string, n int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("url string, n int").parquet(source)
        links.load_links(stream, master, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(master).collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_batches_read_only_the_folders_they_touch(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "master")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.concat(F.lit("u"), (F.col("user_id") % 400).cast("string")).alias("url"), "event_type", "event_id")
    for k in (0, 1, 2, 1):  # the last is run again
        links.append_new(events.where(F.col("event_id") % 3 == k), path, buckets=16)
    got = links.master(spark, path)
    assert sorted(r.url for r in got.select("url").collect()) == sorted(r.url for r in events.select("url").distinct().collect())
    one = links.touched(spark, path, [5])
    assert one.count() > 0 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    read = {r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and all("/bucket=5/" in f for f in read) and len(read) < len(spark.read.parquet(path).inputFiles()) / 4
    links.append_new(spark.createDataFrame([(None, "x", 1), (None, "x", 1)], "url string, event_type string, event_id long"), path, buckets=16)
    links.append_new(spark.createDataFrame([(None, "y", 2)], "url string, event_type string, event_id long"), path, buckets=16)
    assert links.master(spark, path).where("url is null").count() == 1
