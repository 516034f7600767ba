import datetime as dt

from pyspark.sql import functions as F

from papyrine.sources import readers, writers
from papyrine.streaming import jobs


def test_tex_tree(spark, tmp_path):
    p = tmp_path / "paper1"
    p.mkdir()
    (p / "main.tex").write_text("\\documentclass{x}\\begin{document}A \\input{sec/one} B \\include{missing}\\end{document}")
    (p / "one.tex").write_bytes("caf\u00e9 \\input{main}".encode("latin-1"))
    files = readers.tex_files(spark, str(tmp_path)).cache()
    assert readers.main_tex(files).collect()[0].path.endswith("main.tex")
    row = readers.expanded_tex(files).collect()[0]
    assert row.paper == "paper1" and "A caf\u00e9  B " in row.content


def test_tex_in_folders(spark, tmp_path):
    p = tmp_path / "paper2"
    (p / "sections").mkdir(parents=True)
    (p / "appendix").mkdir()
    (p / "main.tex").write_text("\\documentclass{x}\\begin{document}\\input{sections/intro} \\input{appendix/intro.tex} \\input{only}\\end{document}")
    (p / "sections" / "intro.tex").write_text("S \\input{part}")
    (p / "sections" / "part.tex").write_text("P")
    (p / "appendix" / "intro.tex").write_text("A")
    (p / "appendix" / "only.tex").write_text("O \\input{main}")
    files = readers.tex_files(spark, str(tmp_path)).cache()
    assert {r.paper for r in files.collect()} == {"paper2"} and files.count() == 5
    assert "S P A O " in readers.expanded_tex(files).collect()[0].content


def test_upgrade_and_bundle(spark, tmp_path):
    schema = "document_id string, schema_version string, authors array<string>, relations array<struct<type: string, source_id: string, target_id: string>>"
    rel = ("r", "a", "b")
    df = spark.createDataFrame([("a", "1.0", ["x", " ", None], [rel, rel, ("r", None, "b")]), ("b", "1.1", ["y"], [rel]), ("c", None, None, None)], schema)
    got = {r.document_id: r for r in readers.upgraded(df).collect()}
    assert got["a"].authors == ["x"] and len(got["a"].relations) == 1 and got["a"].schema_version == "1.1" and got["a"].upgraded
    assert not got["b"].upgraded and got["c"].upgraded and got["c"].schema_version == "1.1"
    assert writers.save_bundle({"formulas": df.select("document_id", "authors"), "metagraph": df.select("document_id", "schema_version")}, str(tmp_path / "b")) == ["metagraph", "formulas"]
    assert spark.read.parquet(str(tmp_path / "b" / "formulas")).count() == 3


def test_decoder_and_boxes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "b.txt").write_text("")
    got = readers.decoded(readers.binary(spark, str(tmp_path), "*.txt"), lambda path, b: [{"name": path[-5:], "line": x} for x in b.decode().split()], "name string, line string").collect()
    assert sorted(tuple(r) for r in got) == [("a.txt", "x"), ("a.txt", "y")]
    boxes = spark.createDataFrame([("d", 1, 1, 1, 50, 0, 5, 9, 90.0, "b"), ("d", 1, 1, 1, 10, 1, 5, 9, 70.0, "a"), ("d", 1, 1, 1, 0, 0, 1, 1, -1.0, "no"), ("d", 1, 1, 2, 0, 0, 1, 1, 5.0, " ")], "document_id string, block int, par int, line int, left int, top int, width int, height int, conf double, text string")
    row = readers.word_boxes(boxes).collect()
    assert len(row) == 1 and row[0].text == "a b" and (row[0].x0, row[0].x1, row[0].confidence) == (10, 55, 0.8)
    lines = readers.text_lines(spark.createDataFrame([("d", "a\n\n b "), ("e", None), ("f", "")], "document_id string, text string"), "document_id", "text").collect()
    assert [(r.document_id, r.line, r.text, r.y0) for r in lines] == [("d", 0, "a", 0.0), ("d", 1, "b", 421.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    writers.save_table(df, str(tmp_path / "t"), ["document_id"])
    writers.save_table(df.where("document_id = 'b'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["document_id"])
    assert sorted((r.document_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 9)]
    writers.save_json(df, str(tmp_path / "j"))
    assert readers.json_documents(spark, str(tmp_path / "j"), "document_id string, v int").count() >= 1
    writers.save_corpus({"nodes": df}, str(tmp_path / "c"), "k1")
    assert spark.read.parquet(str(tmp_path / "c" / "corpus_id=k1" / "nodes")).count() == 2
    T = lambda n: dt.datetime(2024, 1, n)
    files = spark.createDataFrame([("a", T(1)), ("b", T(2)), ("c", T(3)), ("a", T(4))], "id string, at timestamp")
    assert {r.id: r.expired for r in writers.retained(files, "id", "at", 2, "2023-01-01", "b").collect()} == {"a": False, "b": False, "c": False}
    assert {r.id for r in writers.retained(files, "id", "at", 1, "2024-01-01").where("expired").collect()} == {"b", "c"}


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    src = tmp_path / "events"
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    n = spark.read.parquet(str(src)).count()
    assert run(jobs.windowed_counts(stream, "ts", "event_type"), "w1", "complete").agg(F.sum("n")).collect()[0][0] == n
    latest = run(jobs.latest_status(stream, "user_id", "ts", "event_type"), "l1", "complete")
    assert latest.count() == spark.read.parquet(str(src)).select("user_id").distinct().count()
    docs = spark.createDataFrame([("b", "1", "ok", 1.0), ("b", "2", "error", 1.0), ("c", "1", "queued", 0.5)], "batch_id string, document_id string, status string, progress double")
    assert {r.batch_id: (r.status, r.progress) for r in jobs.batch_roll_up(docs).collect()} == {"b": ("partial", 1.0), "c": ("running", 0.5)}


def test_waiting_references(spark, tmp_path):
    T = lambda n: dt.datetime(2024, 1, n)
    schema = "target_document string, target_key string, kind string, at timestamp, ref_table string, document_id string, record_id string, ref_key string"
    ref = ("edges", "d", "e1", "x")
    none = (None,) * 4
    rows = [("d", "x", "probe", T(1), *ref), ("d", "x", "arrive", T(2), *none), ("d", "x", "delete", T(3), *none), ("d", "y", "arrive", T(1), *none), ("d", "y", "probe", T(2), "edges", "d", "e2", "y")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "r"))
    out = run(jobs.waiting_references(spark.readStream.schema(schema).parquet(str(tmp_path / "r"))), "o1", "append").collect()
    assert [(r.record_id, r.event) for r in sorted(out, key=lambda r: r.at)] == [("e1", "orphan"), ("e1", "resolved"), ("e1", "reopened")]
