"""File sources: folder scans, format sniffing, text extraction from office files, failure ledgers, sinks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import paths
from corpusloom.functions import text as tx

#: Folders that a corpus scan and a mount import leave out.
SCAN_SKIPS, IMPORT_SKIPS = ["node_modules", "target", "__pycache__"], ["node_modules", ".git", "target", "__pycache__", ".venv"]
#: The most text that is kept of a file, and seconds for each extractor.
MOST_BYTES = 1 << 20
TIMEOUTS = {"office": 45, "pdf": 120, "pdftotext": 180, "spreadsheet": 90, "ocr": 300, "summary": 240}


def scan(spark: SparkSession, root: str, hidden: bool = False, content: bool = True) -> DataFrame:
    """SRC-01: files below root (ino, filepath, size, data), numbered by path, without dot entries and build folders."""
    return _numbered(_files(spark, root, content).where(~_skipped(SCAN_SKIPS, not hidden)))


def import_list(spark: SparkSession, root: str) -> DataFrame:
    """SRC-02: (filepath, real path) of a mount import, without contents, dependency folders and OS noise."""
    files = _files(spark, root, False).where(~_skipped(IMPORT_SKIPS, False) & ~paths.is_noise(F.col("filepath")))
    return files.where(paths.base_name(F.col("filepath")) != "package-lock.json").select("filepath", "real")


def _files(spark: SparkSession, root: str, content: bool) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^\w+:/*", "/")
    own = read.select(F.substring(plain, F.lit(len(base) + 1), F.length(plain)).alias("filepath"), F.col("path").alias("real"), F.col("length").alias("size"), *(["content"] if content else []))
    return own.withColumnRenamed("content", "data") if content else own


def _skipped(names: list[str], dots: bool) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains("filepath", F.lit(f"/{n}/"))
    return out | F.col("filepath").rlike(r"/\.") if dots else out


def _numbered(files: DataFrame) -> DataFrame:
    """Numbers in order of paths: within range partitions, shifted by what the ones before hold."""
    from corpusloom.plans.lineage import cut

    keys = cut(files.select("filepath").repartitionByRange("filepath").withColumn("_p", F.spark_partition_id()))
    base = keys.groupBy("_p").agg(F.count("*").alias("n")).select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("base"))
    ino = keys.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("filepath"))).join(F.broadcast(base), "_p").select("filepath", (F.col("base") + F.col("_r")).cast("long").alias("ino"))
    return files.join(ino, "filepath")


def sniff(data: Column) -> Column:
    """SRC-05: a file's format by its bytes, whatever its name."""
    def starts(hexed: str) -> Column:
        return F.startswith(F.hex(F.substring(data, 1, len(hexed) // 2)), F.lit(hexed))

    def holds(raw: bytes) -> Column:
        return F.contains(data, F.lit(raw))

    opening = F.lower(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"))
    tag = F.regexp_replace(opening, r"^[ \t\r\n\f]+", "")
    wide = lambda s: s.encode("utf-16-le")
    return (
        F.when(starts("25504446"), "pdf")
        .when(starts("FFD8FF"), "jpeg")
        .when(starts("504B0304"), F.when(holds(b"word/document.xml"), "docx").when(holds(b"xl/workbook.xml"), "xlsx").when(holds(b"ppt/presentation.xml"), "pptx").otherwise("unknown"))
        .when(starts("D0CF11E0"), F.when(holds(wide("Workbook")), "xls").when(holds(wide("PowerPoint Document")), "ppt").otherwise("unknown"))
        .when(F.startswith(tag, F.lit("<html")) | F.startswith(tag, F.lit("<!doctype")), "html")
        .otherwise("unknown")
    )


def route(path: Column, data: Column) -> Column:
    """SRC-13, SRC-14: text that is valid UTF-8 goes in as it is, tables by name through the summary, the rest to the
    extractor of its format."""
    kind, name = sniff(data), F.lower(path)
    utf8 = F.is_valid_utf8(data.cast("string"))
    table = F.endswith(name, F.lit(".csv")) | F.endswith(name, F.lit(".json"))
    return F.when((kind == "unknown") & utf8 & table & (F.trim(data.cast("string")) != ""), "table").when((kind == "unknown") & utf8, "text").when(kind != "unknown", kind).otherwise("unindexed")


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def ooxml_text(raw: bytes) -> str:
    """SRC-06: text runs, a line end at each paragraph's end."""
    out = []
    for _, e in ElementTree.iterparse(io.BytesIO(raw), events=("end",)):
        if _tag(e) == "t":
            out.append(e.text or "")
        elif _tag(e) == "p":
            out.append("\n")
    return "".join(out).strip()


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ooxml_text(z.read("word/document.xml"))


def pptx_text(data: bytes) -> str:
    """SRC-07: slides by number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return "\n".join(t for _, n in slides if (t := ooxml_text(z.read(n))))


def xlsx_sheets(data: bytes) -> list[tuple[str, str]]:
    """SRC-08: (sheet, text): cells that aren't empty parted by tabs, rows by line ends; no empty sheets."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {*z.namelist()}
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [e.get("name") for e in book.iter() if _tag(e) == "sheet"]
        out = []
        for i, name in enumerate(sheets, 1):
            part = f"xl/worksheets/sheet{i}.xml"
            if part not in names:
                continue
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(part)).iter() if _tag(e) == "row"):
                cells = []
                for c in (e for e in row if _tag(e) == "c"):
                    value = next((v.text or "" for v in c.iter() if _tag(v) == "v"), "")
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                    if value.strip():
                        cells.append(value)
                if cells:
                    rows.append("\t".join(cells))
            if rows:
                out.append((name, "\n".join(rows)))
        return out


def html_text(data: bytes) -> str:
    from html.parser import HTMLParser

    class Text(HTMLParser):
        out: list[str]

        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style") and self.off > 0

        def handle_data(self, text):
            if not self.off and text.strip():
                self.out.append(text.strip())

    parser = Text()
    parser.feed(data.decode("utf-8", "replace"))
    return "\n".join(parser.out)


#: SRC-09, SRC-11: formats without a parser here (pdf, legacy office, images) are seams: name an extractor for them.
EXTRACTORS = {"docx": docx_text, "pptx": pptx_text, "xlsx": lambda d: "\n".join(t for _, t in xlsx_sheets(d)), "html": html_text, "text": lambda d: d.decode(), "table": lambda d: d.decode()}


def extract(files: DataFrame, extractors: dict | None = None, most: int = MOST_BYTES) -> DataFrame:
    """SRC-12: files (filepath, data) with route, text (at most so many bytes, whole characters) and reason; a file whose
    extractor fails, or that has none, keeps a reason and a null text; none stops the job."""
    known = {**EXTRACTORS, **(extractors or {})}
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])

    @F.pandas_udf(schema)
    def run(routes: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for kind, raw in zip(routes, data, strict=True):
            try:
                if kind not in known:
                    out.append((None, f"no extractor for {kind}"))
                    continue
                text = known[kind](bytes(raw or b""))
                cut = text.encode()[:most].decode("utf-8", "ignore")
                out.append((cut, None) if cut.strip() else (None, "empty"))
            except Exception as error:  # noqa: BLE001  a file's parser may raise anything; the ledger keeps it
                out.append((None, f"{type(error).__name__}: {error}"[:200]))
        return pd.DataFrame(out, columns=schema.names)

    own = files.withColumn("route", route(F.col("filepath"), F.col("data")))
    return own.withColumn("_x", run("route", "data")).select(*files.columns, "route", "_x.text", "_x.reason")


def ledger(extracted: DataFrame) -> DataFrame:
    """SRC-16: a line for each file without a text: filepath, stage, reason, bytes."""
    failed = extracted.where("text IS NULL")
    return failed.select("filepath", F.when(F.col("reason") == "unreadable", "read").otherwise("extract").alias("stage"), "reason", F.octet_length("data").cast("long").alias("bytes"))


def sheet_rows(files: DataFrame) -> DataFrame:
    """SRC-08, SRC-15: (filepath, sheet, raw_text) of workbooks; the index may hold a summary over it (CHK-07)."""
    schema = T.ArrayType(T.StructType([T.StructField("sheet", T.StringType()), T.StructField("raw_text", T.StringType())]))

    @F.pandas_udf(schema)
    def run(data: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return [{"sheet": a, "raw_text": b} for a, b in xlsx_sheets(bytes(raw))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return []

        return data.map(one)

    return files.where(sniff(F.col("data")) == "xlsx").select("filepath", F.inline(run("data")))


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-20: JSON lines; a line that is no JSON is skipped."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-20."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path)


def write_tables(path: str, **tables: DataFrame) -> None:
    """SRC-18: a store is a folder of Parquet tables; those with a container are partitioned by it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("container") if "container" in df.columns else writer).parquet(f"{path}/{name}")


def write_text(path: str, lines: DataFrame) -> None:
    """SNK-03: an artefact's lines in order, as one small text file."""
    lines.repartitionByRange(1, "line_no").sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def indexable(extracted: DataFrame) -> DataFrame:
    """CHK-01 and CHK-02 over extracted texts: chunks (filepath, ord, text)."""
    own = extracted.where("text IS NOT NULL").select("filepath", tx.head(F.col("text")).alias("text"))
    return tx.windows(own).select("filepath", "ord", F.col("chunk").alias("text"))
