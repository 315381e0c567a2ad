"""Reports, tables and state on small cases."""

import io
import zipfile

from pyspark.sql import functions as F

from galleyproof.functions import accounts
from galleyproof.operators import dom, images, rollup, rules, state
from galleyproof.sinks import report, tables


def test_workbook_has_all_rows_and_safe_cells(spark, monkeypatch):
    monkeypatch.setattr(report, "SHEET_ROWS", 4)
    data = io.BytesIO()
    report.write_workbook(data, [("A", spark.createDataFrame([(1, "=1+1"), (2, "<b>\x01")], "n int, t string")), ("B", spark.range(5).withColumn("none", F.lit(None).cast("int"))), ("C", spark.range(0))])
    book = zipfile.ZipFile(data)
    sheets = [book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, 5)]
    assert "'=1+1" in sheets[0] and "&lt;b&gt;<" in sheets[0]
    assert [s.count("<row>") for s in sheets] == [3, 4, 3, 1]
    assert "B (2)" in book.read("xl/workbook.xml").decode()


def test_run_report(spark):
    pairs = spark.createDataFrame([(1, 1, "s", "t", "done", 1, 1, 0, 0, None), (1, 2, "s", None, "error", 0, 0, 0, 0, "French"), (2, 1, "s", "t", "done", 0, 0, 0, 0, None)], "run_id long, file_no long, source_name string, target_name string, status string, issue_count int, critical_count int, major_count int, minor_count int, language string")
    issues = spark.createDataFrame([(1, 1, "Missing Text", "error", None, "m", "e", "", None)], "run_id long, file_no long, category string, engine_severity string, line int, message string, expected string, actual string, snippet string")
    data = io.BytesIO()
    report.write_run_report(data, 1, pairs, issues)
    book = zipfile.ZipFile(data)
    first, second, third = (book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3))
    assert "Missing Text" in first and second.count("<row>") == 3 and "Failed" in second and "Missing Text" in third


def test_written_tables(spark, tmp_path):
    issues = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "run_id long, file_no long, category string")
    path = str(tmp_path / "issues")
    tables.overwrite_runs(issues, path)
    tables.overwrite_runs(issues.where("run_id = 1").withColumn("category", F.lit("c")), path)
    assert {(r["run_id"], r["category"]) for r in spark.read.parquet(path).collect()} == {(1, "c"), (2, "b")}
    for _ in range(2):
        tables.append_log(spark.sql("select timestamp '2024-01-02 03:04:05' as ts, 'hi' as message"), str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[2024-01-02 03:04:05] hi"] * 2
    tables.write_csv(issues.withColumn("q", F.lit('a "b", c')), str(tmp_path / "csv"))
    assert {r["q"] for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()} == {'a "b", c'}
    tables.write_results(issues, str(tmp_path / "json"), "1")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert tables.next_batch(spark.createDataFrame([], "name string")).first()["number"] == 1


def test_restart(spark):
    runs = spark.createDataFrame([(1, "running"), (2, "prepared"), (3, "prepared"), (4, "done"), (5, "queued")], "run_id long, status string")
    pairs = spark.createDataFrame([(2, "queued"), (3, "done"), (4, "running")], "run_id long, status string")
    after, left = rollup.interrupt(runs, pairs)
    assert dict(after.select("run_id", "status").collect()) == {1: "interrupted", 2: "interrupted", 3: "prepared", 4: "done", 5: "interrupted"}
    assert dict(left.collect()) == {2: "interrupted", 3: "done", 4: "interrupted"}


def test_accounts(spark):
    users = spark.createDataFrame([(1, "a", "a@x.org", "admin", "active"), (2, "Root", "r@x.org", "user", "disabled"), (3, "root2", "ROOT@x.org", None, "active")], "id long, username string, email string, role string, status string")
    rows = {r["id"]: (r["username"], r["email"], r["role"], r["status"]) for r in state.sync_admin(users, "root@x.org", "root").collect()}
    assert rows == {1: ("a", "a@x.org", "user", "active"), 2: ("root", "root@x.org", "admin", "active"), 3: ("disabled_3_root2", "disabled_3_ROOT@x.org", None, "active")}
    made = state.create_users(users, spark.createDataFrame([("n@x.org", "A"), ("m@x.org", "New"), ("k@x.org", "new")], "email string, username string"))
    assert [(r["email"], r["username"]) for r in made.collect()] == [("k@x.org", "new")]
    assert [r["id"] for r in state.find_login(users, "ROOT@X.org ").collect()] == [3]
    last = state.latest_rows(spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2)], "id long, v string, ts int, n int"), ["id"], "ts", "n")
    assert [r["v"] for r in last.collect()] == ["b"]


def test_password_faults(spark):
    fault = lambda p, u="bob": spark.range(1).select(accounts.password_fault(F.lit(p), F.lit(u)).alias("f")).first()["f"]
    assert fault("Good-Enough-1") is None
    assert "longer" not in fault("x" * 129) and "128" in fault("x" * 129)
    assert "username" in fault("Xx-1234-BOB")
    assert "10 characters" in fault(None)


def test_image_rules(spark):
    schema = "doc_id long, idx long, phash long, chash long"
    sources = spark.createDataFrame([(1, 0, 0, 0), (1, 1, -1, 0), (2, 0, 0, 0)], schema)
    targets = spark.createDataFrame([(1, 5, -1, 0), (1, 6, 0, 0), (1, 7, None, None), (2, 1, 0, 2**20 - 1), (2, 2, 2**40 - 1, 0), (3, 0, 0, 0), (3, 1, None, None)], schema)
    found = {tuple(r) for r in images.image_issues(sources, targets).collect()}
    assert found == {(1, 5, "Image Order Mismatch"), (1, 7, "Broken Image"), (2, 1, "Image Possibly Wrong"), (2, 2, "Image Doesn't Match Source"), (2, 2, "Extra Image"), (3, 1, "Broken Image")}


def test_rules_on_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p style='text-align:right'>x<ul><li><p>No label</p></li></ul>"), (4, "<ul><p></p><li></li></ul>"), (5, '<HTML lang="ur-PK"><body dir="rtl"><title> Untitled </title>')], "page_id long, html string")
    tree = dom.nodes(pages)
    found = {(r["page_id"], r["category"]) for r in rules.house_style(tree).collect()}
    assert found == {(3, "Style Attribute Mismatch"), (3, "Tag Attribute Mismatch")}
    languages = spark.createDataFrame([(1, "Urdu"), (5, "Urdu"), (3, "French"), (4, None)], "page_id long, language string")
    meta = {(r["page_id"], r["category"], r["actual"]) for r in rules.rtl_metadata(tree, languages).collect()}
    assert meta == {(1, "Missing Language Attribute", "No lang attribute found"), (1, "Missing RTL Direction", 'No dir="rtl" found on html/body or text containers'), (1, "Missing Title", "No <title> tag found"), (5, "Missing Title", "<title>Untitled</title>")}
