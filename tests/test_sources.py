"""Packages, trees and incremental counts."""

import io
import zipfile

from pyspark.sql import functions as F

from galleyproof.operators import dom, state
from galleyproof.sources import packages
from galleyproof.streaming import counts


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_packages(spark):
    inner = package(c_dot_html=b"x")
    outer = package(a__b_dot_pdf=b"1", n_dot_zip=inner, s_dot_css=b"no")
    files = spark.createDataFrame([("p.zip", bytearray(outer)), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    found = {(r["package"], r["relpath"], r["depth"], r["error"] is None) for r in packages.expand(files).collect()}
    assert found == {("p.zip", "a/b.pdf", 0, True), ("p.zip", "c.html", 1, True), ("bad.zip", None, None, False)}


def test_trees(spark):
    html = "<body><p>One <b>two</b><p style='display:none'>gone</p><h2>Head</h2>\n<i>lorem ipsum</i><div aria-hidden='true'>no</div></body>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    shown = dom.visible_text(dom.nodes(pages)).orderBy("node_id").collect()
    assert [(r["text"].strip(), r["bold"], r["italic"], r["heading_level"], r["line"]) for r in shown] == [("One", False, False, 0, 1), ("two", True, False, 0, 1), ("Head", True, False, 2, 1), ("lorem ipsum", False, True, 0, 2)]
    assert [r["actual"] for r in dom.placeholders(dom.visible_text(dom.nodes(pages))).collect()] == ["lorem ipsum"]


def test_states(spark):
    got = spark.createDataFrame([("pending",), ("used",), ("requested",)], "s string").select(state.transition(F.col("s"), "cancelled").alias("x")).collect()
    assert [r["x"] for r in got] == ["cancelled", "used", "cancelled"]


def test_stream_counts(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = spark.createDataFrame([(1, "done"), (1, "done"), (2, "error")], "run_id long, status string")
    rows.write.parquet(folder)
    once = lambda: sorted(map(tuple, counts.run_once(spark, folder, rows.schema, str(tmp_path / "counts"), str(tmp_path / "checkpoint")).collect()))
    assert once() == [(1, "done", 2), (2, "error", 1)]
    rows.where("run_id = 1").write.mode("append").parquet(folder)
    assert once() == [(1, "done", 4), (2, "error", 1)] == once()


def test_stream_sessions(spark, tmp_path):
    from galleyproof.operators import rollup

    folder = str(tmp_path / "events")
    moments = [(1, 0), (1, 1800), (1, 3601), (1, 3602), (2, 5), (2, 9000)]
    rows = spark.createDataFrame([(k, u, 1_700_000_000 + s) for k, (u, s) in enumerate(moments)], "event_id long, user_id long, at long").select("event_id", "user_id", F.timestamp_seconds("at").alias("ts"))
    rows.coalesce(1).write.parquet(folder)
    # a last event moves the watermark past all sessions but its own
    last = rows.limit(1).select(F.lit(99).cast("long").alias("event_id"), F.lit(9).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"))
    last.coalesce(1).write.mode("append").parquet(folder)
    stream = counts.stream_sessions(spark.readStream.schema(rows.schema).parquet(folder))
    out = str(tmp_path / "out")
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = rollup.idle_sessions(rows).select("user_id", "first_second", "last_second", "n_events")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_uploads_in_batches_and_as_they_come(spark, tmp_path):
    from galleyproof.sources import uploads

    folder = tmp_path / "in"
    (folder / "English").mkdir(parents=True)
    (folder / "English" / "a.PDF").write_bytes(b"1")
    (folder / "b.exe").write_bytes(b"2")
    assert [(r["relpath"], r["ext"], bytes(r["content"])) for r in uploads.read(spark, str(folder)).collect()] == [("English/a.PDF", ".pdf", b"1")]
    out = str(tmp_path / "out")

    def handle(files, batch):
        files.select("path", "content").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    uploads.ingest_new(spark, str(folder), str(tmp_path / "state"), handle)
    (folder / "c.rtf").write_bytes(b"3")
    uploads.ingest_new(spark, str(folder), str(tmp_path / "state"), handle)
    assert {bytes(r["content"]) for r in spark.read.parquet(out).collect()} == {b"1", b"3"}
