"""Reports: frames of what they show, and a spreadsheet writer.

Cells are safe text: nothing that starts like a formula stays one. Sheets are written row
by row from the frames' iterators, so no report is held in memory; what does not fit on a
sheet goes to further ones.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.operators import classify

#: Labels of modes, columns of the plain report, rows that a sheet holds, characters that XML lacks.
MODES = {"pdf": "PDF ↔ HTML", "rtf": "RTF ↔ HTML", "pdf_word": "PDF ↔ WORD"}
COLUMNS = ("Unique ID", "Validation Type", "Source File", "Target File", "Language", "Error Type", "Severity", "Target Location", "Description", "Expected", "Actual / Shown", "Excerpt / Snippet")
SHEET_ROWS = 1_048_576
_BARRED = {c: None for c in range(32) if c not in (9, 10, 13)}


def mode_label(mode: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, mode), F.upper(mode))


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def plain_rank(severity: Column) -> Column:
    """Order of the plain report: displayed severities and the checks' own alike."""
    return F.when(severity.isin("Critical", "error"), 0).when(severity.isin("Major", "warning"), 1).when(severity.isin("Minor", "info"), 2).otherwise(3)


def plain_report(files: DataFrame, issues: DataFrame) -> DataFrame:
    """The twelve columns of the plain report, and ``position`` in it.

    ``files``: unique_id, mode, source_name, target_name, language. ``issues``: unique_id,
    category, severity, line, message, expected, actual, snippet; without severity Minor.
    """
    severity = F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("Minor"))
    line = F.nullif(F.col("line"), F.lit(0))
    both = files.join(issues, "unique_id")
    rows = both.select(
        "unique_id", mode_label(F.col("mode")).alias("validation_type"), "source_name", "target_name", "language", _shown("category").alias("category"), severity.alias("severity"),
        F.coalesce(line.cast("string"), F.lit("—")).alias("location"), _shown("message").alias("message"), _shown("expected").alias("expected"), _shown("actual").alias("actual"), _shown("snippet").alias("snippet"),
        plain_rank(severity).alias("rank"), F.coalesce(line, F.lit(99_999)).alias("at"),
    )
    order = F.struct("rank", "at")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("unique_id").orderBy(order, "category", "expected", "actual")).cast("long")).drop("rank", "at")


def file_summary(pairs: DataFrame) -> DataFrame:
    """One row per file pair: number, names, status, severity, counts, language."""
    done = F.col("status") == "done"
    status = F.when(done & (F.col("issue_count") == 0), "Passed").when(done, "Failed").otherwise(F.col("status"))
    severity = classify.file_severity(F.col("critical_count"), F.col("major_count"), F.col("minor_count"))
    names = F.concat(F.coalesce("source_name", F.lit("")), F.lit("\n→ "), F.coalesce("target_name", F.lit(""))).alias("file_pair")
    return pairs.select("run_id", "file_no", names, status.alias("status"), severity.alias("file_severity"), "issue_count", "critical_count", "major_count", "minor_count", F.coalesce("language", F.lit("—")).alias("language"))


def overview(files: DataFrame) -> DataFrame:
    """(run_id, label, value): totals of a run as its first sheet shows them."""
    passed = (F.col("issue_count") == 0) & F.col("status").isin("Passed", "done")
    failed = (F.col("issue_count") > 0) | (F.col("status") == "Failed")
    total = lambda c: F.coalesce(F.sum(c).cast("long"), F.lit(0))
    measures = {"Total Files": F.count("*"), "Passed Files": F.count_if(passed), "Failed Files": F.count_if(failed), "Total Errors": total("issue_count"), "Critical Errors": total("critical_count"), "Major Errors": total("major_count"), "Minor Errors": total("minor_count")}
    measures |= {f"{s} Files": F.count_if(F.col("file_severity") == s) for s in ("Critical", "Major", "Minor")}
    measures["Files of Severity Passed"] = F.count_if(F.col("file_severity") == "Passed")
    wide = files.groupBy("run_id").agg(*(c.alias(n) for n, c in measures.items()))
    return wide.unpivot("run_id", list(measures), "label", "value")


def error_details(issues: DataFrame) -> DataFrame:
    """Issues of a run in the order of the third sheet, with what it shows of each."""
    ranked = classify.sorted_rank(issues, "run_id", "file_no")
    kept = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    where = F.coalesce(F.nullif(F.col("line"), F.lit(0)).cast("string"), F.lit("—")).alias("location")
    context = F.coalesce(F.nullif(F.col("snippet"), F.lit("")), F.nullif(F.col("message"), F.lit("")), F.lit("—")).alias("context")
    return ranked.select("run_id", "file_no", "position", "category", "severity", "area", where, F.substring(kept("message"), 1, 300).alias("message"), kept("expected").alias("expected"), kept("actual").alias("actual"), context)


def _cells(df: DataFrame) -> DataFrame:
    numbers = ("bigint", "int", "double", "float", "smallint", "tinyint")
    return df.select(*(F.col(c) if t in numbers else tx.safe_cell(F.col(c).cast("string")).alias(c) for c, t in df.dtypes))


def _row(values: Iterable[object]) -> bytes:
    out = []
    for v in values:
        if v is None:
            out.append("<c/>")
        elif isinstance(v, (int, float)):
            out.append(f"<c><v>{v}</v></c>")
        else:
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v).translate(_BARRED))}</t></is></c>')
    return ("<row>" + "".join(out) + "</row>").encode()


def write_workbook(target: str | BinaryIO, sheets: list[tuple[str, DataFrame]]) -> None:
    """Write frames, in their order, as sheets of one workbook for a person to read.

    Rows come through the driver one partition at a time, as it writes the one file.
    """
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    names: list[str] = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for name, df in sheets:
            rows: Iterator = _cells(df).toLocalIterator()
            ahead, part = next(rows, None), 1
            while part == 1 or ahead is not None:
                names.append(name if part == 1 else f"{name} ({part})")
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>'.encode() + _row(df.columns))
                    for _ in range(SHEET_ROWS - 1):
                        if ahead is None:
                            break
                        out.write(_row(ahead))
                        ahead = next(rows, None)
                    out.write(b"</sheetData></worksheet>")
                part += 1
        n = range(1, len(names) + 1)
        listed = "".join(f'<sheet name="{escape(names[i - 1][:31])}" sheetId="{i}" r:id="rId{i}"/>' for i in n)
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')


def write_run_report(target: str | BinaryIO, run_id: int | str, pairs: DataFrame, issues: DataFrame) -> None:
    """The three sheets of a run: overview, files, and errors of each file."""
    mine = F.col("run_id") == run_id
    files = file_summary(pairs.where(mine)).orderBy("file_no")
    details = error_details(classify.classify(issues.where(mine))).orderBy("file_no", "position")
    categories = issues.where(mine).groupBy("category").agg(F.count("*").alias("value")).select(F.lit(1).alias("part"), F.col("category").alias("label"), "value")
    totals = overview(files).select(F.lit(0).alias("part"), "label", "value").unionByName(categories)
    shown = totals.orderBy("part", F.desc("value"), "label").select("label", "value")
    write_workbook(target, [("Overall Summary", shown), ("File Based Summary", files), ("Individual File Errors", details)])
