"""Workbooks as tables: XLSX cells by the standard library, segments of numeric columns and rows, titles and headers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.numbers import coerce_number, decimal_metadata, display_text, format_decimals

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Number formats by built-in id (fixed values); 14 to 22 and 45 to 47 are dates and times.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 37: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)", 48: "##0.0E+0", 49: "@"}
DATES = {*range(14, 23), *range(45, 48)}
#: Words in a label or header that mark a designed sequence (fixed values).
DESIGNED = (
    "id", "no", "number", "index", "编号", "序号", "sample no", "样本编号", "time", "时间", "day", "week", "month", "月份", "dose", "dosage", "concentration", "conc", "浓度", "剂量",
    "group", "组别", "分组", "treatment", "处理", "control", "对照", "standard", "标准", "calibrator", "batch", "批次", "replicate", "重复", "年龄", "age",
)
TITLE = r"(?i)\b(?:fig(?:ure)?|table)\s*[.\-]?\s*\d*"
CELLS = "file string, sheet string, row int, col int, num double, txt string, number_format string"


def read_sheet_cells(data: bytes, name: str) -> list[tuple]:
    """(file, sheet, row, col, num, txt, number_format) of all cells with a value; dates and booleans are left out."""
    book = zipfile.ZipFile(io.BytesIO(data))
    have = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in have:
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{NS}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{NS}t")))
    formats: list[tuple[str, bool]] = []
    if "xl/styles.xml" in have:
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{NS}numFmt")}
        for xf in styles.find(f"{NS}cellXfs") or []:
            k = int(xf.get("numFmtId", 0))
            code = own.get(k, BUILT_IN.get(k, "General"))
            formats.append((code, k in DATES or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|General', "", code), re.I))))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{NS}sheet"):
        target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        for c in ElementTree.fromstring(book.read(path)).iter(f"{NS}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = 0
            for letter in letters:
                col = col * 26 + ord(letter) - 64
            kind, value = c.get("t", "n"), c.find(f"{NS}v")
            code, date = formats[int(c.get("s", 0))] if int(c.get("s", 0)) < len(formats) else ("General", False)
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{NS}t"))
            elif value is None or kind in ("b", "e"):
                continue
            elif kind == "s":
                text = shared[int(value.text)]
            elif kind == "str":
                text = value.text or ""
            elif date:
                continue
            else:
                out.append((name, sheet.get("name"), int(row), col, float(value.text), None, code))
                continue
            out.append((name, sheet.get("name"), int(row), col, None, text, code))
    return out


#: Names of workbooks that are read, in any case.
WORKBOOKS = "*.[xX][lL][sStT][xXmM]"


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the workbooks under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", WORKBOOKS).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under a path; a workbook that can't be read gives one row with its error as txt and row 0."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += read_sheet_cells(bytes(data), name)
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((name, None, 0, 0, None, f"error: {e}", None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return workbook_files(spark, path).mapInPandas(run, CELLS)


def file_status(cells: DataFrame, series: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(file, status, sheet_count, dataset_count, numeric_value_count, error): success; error if a workbook can't be read or,
    of `asked` (file), isn't there or is of another kind; skipped if truncation left none of its series."""
    read = cells.groupBy("file").agg(F.count_distinct("sheet").alias("sheet_count"), F.max(F.when(F.col("row") == 0, F.col("txt"))).alias("error"))
    kept = series.groupBy("file").agg(F.count("*").alias("dataset_count"), F.sum("n").alias("numeric_value_count"))
    out = (asked.select("file").distinct().join(read, "file", "left") if asked is not None else read).join(kept, "file", "left").na.fill(0, ["sheet_count", "dataset_count", "numeric_value_count"])
    wrong = F.when(~F.lower("file").rlike(r"\.(xlsx|xlsm|xltx|xltm)$"), "error: not a workbook of a known kind").when(F.col("sheet_count") == 0, "error: there is no such file")
    out = out.withColumn("error", F.coalesce("error", wrong))
    cut = F.col("skipped") if "skipped" in series.columns else F.lit(False)
    left_out = series.groupBy("file").agg(F.bool_and(cut).alias("_none"))
    out = out.join(left_out, "file", "left")
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("_none"), "skipped").otherwise("success")).drop("_none")


def numeric_cells(cells: DataFrame) -> DataFrame:
    """Cells with a number (typed or coerced from text), their displayed text and its decimals."""
    value = F.coalesce("num", coerce_number(F.col("txt")))
    percent = F.coalesce(F.element_at(F.split("number_format", ";"), 1).contains("%"), F.lit(False))
    out = cells.where("row > 0").withColumn("value", value).where("value is not null")
    out = out.withColumn("raw", F.coalesce(F.trim("txt"), display_text("num", format_decimals(F.col("number_format")).cast("double"), percent)))
    return out.withColumns(decimal_metadata(F.col("raw")))


def segments(cells: DataFrame, max_gap: int = 2, min_n: int = 3) -> DataFrame:
    """(file, sheet, orientation, line, segment, pos, ..., ds): columns, then rows, cut where over max_gap cells are
    empty, or where a title stands in a gap: between the rows within six columns, or between the columns up to five
    rows above. Segments of under min_n values go."""
    numbers = numeric_cells(cells)
    titles = cells.where(F.col("txt").rlike(TITLE)).select("file", "sheet", F.col("row").alias("trow"), F.col("col").alias("tcol"))
    out = None
    for orientation, line, place in (("column", "col", "row"), ("row", "row", "col")):
        w = Window.partitionBy("file", "sheet", line).orderBy(place)
        rows = numbers.withColumn("prev", F.lag(place).over(w)).withColumn("gap", F.col(place) - F.col("prev") - 1)
        gaps = rows.where("gap between 1 and " + str(max_gap)).select("file", "sheet", "row", "col", "prev")
        near = (F.col("trow") > F.col("prev")) & (F.col("trow") < F.col("row")) & (F.abs(F.col("tcol") - F.col("col")) <= 6) if orientation == "column" else (F.col("tcol") > F.col("prev")) & (F.col("tcol") < F.col("col")) & (F.col("trow") - F.col("row")).between(-5, 0)
        split = gaps.join(titles, ["file", "sheet"]).where(near).select("file", "sheet", "row", "col").distinct().withColumn("split", F.lit(True))
        rows = rows.join(split, ["file", "sheet", "row", "col"], "left")
        new = F.col("prev").isNull() | (F.col("gap") > max_gap) | F.coalesce("split", F.lit(False))
        rows = rows.withColumn("segment", F.sum(new.cast("int")).over(w))
        part = Window.partitionBy("file", "sheet", line, "segment")
        rows = rows.withColumns({"orientation": F.lit(orientation), "line": F.col(line), "pos": F.row_number().over(part.orderBy(place)) - 1, "n": F.count("*").over(part), "first": F.min(place).over(part), "last": F.max(place).over(part)})
        rows = rows.where(F.col("n") >= min_n).select("file", "sheet", "orientation", "line", "segment", "pos", "row", "col", "value", "raw", "decimal_places", "last_decimal_digit", "suffix_2", "n", "first", "last", (F.col("last") - F.col("first") + 1 - F.col("n")).alias("missing_count"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("ds", F.concat_ws("::", "file", "sheet", "orientation", "line", "first", "last"))


def letters(col: Column) -> Column:
    """A column's letters."""
    one = lambda at: F.char(F.lit(65) + at)
    third, second = F.floor((col - 703) / 676).cast("int"), F.pmod(F.floor((col - 27) / 26).cast("int"), F.lit(26))
    return F.concat(F.when(col > 702, one(third)).otherwise(""), F.when(col > 26, one(second)).otherwise(""), one(F.pmod(col - 1, F.lit(26))))


def _nearest(points: DataFrame, texts: DataFrame, down: bool, reach: int) -> DataFrame:
    """(id, txt): the nearest text up to `reach` cells above (or left of) each point (id, file, sheet, row, col)."""
    steps = points.select("id", "file", "sheet", "row", "col", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"))
    steps = steps.withColumn("row" if down else "col", F.col("row" if down else "col") - F.col("k"))
    return steps.join(texts, ["file", "sheet", "row", "col"]).groupBy("id").agg(F.min_by("txt", "k").alias("txt"))


def _texts(cells: DataFrame) -> DataFrame:
    return cells.where("row > 0 and txt is not null").select("file", "sheet", "row", "col", F.regexp_replace("txt", r"^\s+|\s+$", "").alias("txt")).where("txt <> ''")


def labels(found: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a segment: header (the nearest text up to five cells before it, else that in the first row or column, else its
    place), title (the nearest within five rows above and six columns to either side), range, label, designed."""
    heads = found.groupBy("ds", "file", "sheet", "orientation", "line", "first", "last").agg(F.min("row").alias("row"), F.min("col").alias("col"), F.max("row").alias("r1"), F.max("col").alias("c1"), F.first("n").alias("n"), F.first("missing_count").alias("missing_count")).withColumnRenamed("ds", "id")
    texts, parts = _texts(cells), []
    for orientation, down in (("column", True), ("row", False)):
        own = heads.where(F.col("orientation") == orientation)
        edge = texts.where("row = 1" if down else "col = 1").select("file", "sheet", "col" if down else "row", F.col("txt").alias("_edge"))
        place = F.concat(F.lit("Column "), letters(F.col("col"))) if down else F.concat(F.lit("Row "), F.col("row").cast("string"))
        own = own.join(_nearest(own, texts, down, 5), "id", "left").join(edge, ["file", "sheet", "col" if down else "row"], "left")
        parts.append(own.withColumn("header", F.coalesce("txt", "_edge", place)).drop("txt", "_edge"))
    out = parts[0].unionByName(parts[1])
    titles = texts.where(F.col("txt").rlike(TITLE)).select("file", "sheet", F.col("row").alias("tr"), F.col("col").alias("tc"), "txt")
    steps = heads.select("id", "file", "sheet", "row", "col", "c1", F.explode(F.expr("sequence(1, 5)")).alias("up")).withColumn("tr", F.col("row") - F.col("up"))
    near = steps.join(titles, ["file", "sheet", "tr"]).where("tc between col - 6 and c1 + 6")
    best = near.groupBy("id").agg(F.min_by("txt", F.struct("up", F.least(F.abs(F.col("tc") - F.col("col")), F.abs(F.col("tc") - F.col("c1"))).alias("d"), "tc")).alias("table_title"))
    name = F.element_at(F.split("file", "/"), -1)
    at = F.concat(letters(F.col("col")), F.col("row").cast("string"), F.lit(":"), letters(F.col("c1")), F.col("r1").cast("string"))
    line = F.when(F.col("orientation") == "column", letters(F.col("col"))).otherwise(F.concat(F.lit("Row "), F.col("row").cast("string")))
    out = out.join(best, "id", "left").withColumns({"range": at, "label": F.concat(F.concat_ws("/", name, "sheet", line), F.lit(" "), "header")})
    out = out.withColumns({"dataset_id": F.concat_ws("::", name, "sheet", "orientation", "range"), "designed": designed(F.col("label")) | designed(F.col("header"))})
    return out.withColumnRenamed("id", "ds").drop("row", "col", "r1", "c1")


def cell_labels(found: DataFrame, cells: DataFrame) -> DataFrame:
    """found with `cell_label`: the nearest text up to four cells left of a cell of a column, above a cell of a row, else its row or column."""
    texts, parts = _texts(cells), []
    for orientation, down in (("column", False), ("row", True)):
        own = found.where(F.col("orientation") == orientation).withColumn("id", F.struct("ds", "pos"))
        place = F.concat(F.lit("Column "), letters(F.col("col"))) if down else F.concat(F.lit("Row "), F.col("row").cast("string"))
        parts.append(own.join(_nearest(own, texts, down, 4), "id", "left").withColumn("cell_label", F.coalesce("txt", place)).drop("txt", "id"))
    return parts[0].unionByName(parts[1])


def in_loading_order(series: DataFrame, per_file: int | None = None, in_all: int | None = None) -> DataFrame:
    """Segments (as of `labels`) with `dataset_idx` from 0 by file, sheet, columns before rows, and place; `skipped` if limits leave them out."""
    kind = F.when(F.col("orientation") == "column", 0).otherwise(1)
    own = F.row_number().over(Window.partitionBy("file").orderBy("sheet", kind, "line", "first"))
    out = series.withColumns({"_own": own, "_kind": kind})
    kept = out if per_file is None else out.where(F.col("_own") <= per_file)
    kept = scratch.numbered(kept, "_k", "file", "sheet", "_kind", "line", "first").withColumn("dataset_idx", (F.col("_k") - 1).cast("int"))
    kept = kept.withColumn("skipped", F.lit(False) if in_all is None else F.col("_k") > in_all)
    rest = out.limit(0) if per_file is None else out.where(F.col("_own") > per_file)
    return kept.drop("_k").unionByName(rest.withColumns({"dataset_idx": F.lit(None).cast("int"), "skipped": F.lit(True)})).drop("_own", "_kind")


def designed(label: Column) -> Column:
    """Whether a label holds a keyword of designed sequences, anywhere in it."""
    return F.lower(label).rlike("|".join(DESIGNED))


def supplementary_series(table: DataFrame, label: str) -> DataFrame:
    """(label, group_label, pos, value) of every other column of a text table with two numbers or more; groups stay on their row."""
    others = [c for c in table.columns if c not in (label, "_row")]
    rows = table.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.col(label).alias("group_label"), *[F.col(c).cast("string").alias(c) for c in others]).unpivot(["_row", "group_label"], others, "label", "text")
    rows = rows.withColumn("value", coerce_number(F.col("text"))).where("value is not null")
    return rows.withColumns({"pos": F.row_number().over(Window.partitionBy("label").orderBy("_row")), "n": F.count("*").over(Window.partitionBy("label"))}).where("n >= 2").drop("_row", "text", "n")


#: File stems that mark the main paper (fixed values).
PRIMARY = ("paper", "article", "manuscript", "main", "论文", "正文")


def case_files(files: DataFrame) -> DataFrame:
    """(path, length): role (paper, raw_data), and which paper is primary: a hinted name first by name, else the largest."""
    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    stem, suffix = F.regexp_extract(name, r"^(.*?)\.[^.]*$", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    role = F.when(suffix == "pdf", "paper").when(suffix.isin("xlsx", "xlsm", "xltx", "xltm"), "raw_data")
    rows = files.withColumns({"name": name, "role": role, "hinted": stem.isin(*PRIMARY)}).where("role is not null")
    order = Window.partitionBy("role").orderBy(F.desc("hinted"), F.when(F.col("hinted"), F.col("name")), F.desc("length"), "name")
    return rows.withColumn("primary", (F.col("role") == "paper") & (F.row_number().over(order) == 1))


def discover_case(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files of a case folder (not those of folders in it) as `case_files`, and errors (error): no such folder, no paper, no workbook."""
    empty = spark.createDataFrame([], "path string, length long")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return case_files(empty), spark.createDataFrame([(f"no such folder: {folder}",)], "error string")
    if not fs.getFileStatus(path).isDirectory():
        return case_files(empty), spark.createDataFrame([(f"not a folder: {folder}",)], "error string")
    files = case_files(spark.read.format("binaryFile").load(folder).select("path", "length"))
    have = files.agg(F.count_if(F.col("role") == "paper").alias("papers"), F.count_if(F.col("role") == "raw_data").alias("workbooks"))
    errors = have.select(F.explode(F.array_compact(F.array(F.when(F.col("papers") == 0, "no PDF of the paper"), F.when(F.col("workbooks") == 0, "no workbook")))).alias("error"))
    return files, errors
