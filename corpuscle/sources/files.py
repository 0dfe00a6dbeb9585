"""Files as tables: directory scans, extraction with plug-ins, recognised pages, metadata files, JSON stores."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INGESTED = ("pdf", "epub", "txt", "html", "htm", "djvu", "mobi")
SCANNED = (*INGESTED, "odt", "docx", "doc")
FILE = "rel_path string, text string, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, folder: str, kinds: tuple = SCANNED, only: str | None = None, exclude: str | None = None) -> DataFrame:
    """path, modificationTime, length and ext of files below a folder, hidden folders left out. Contents aren't read unless selected."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).withColumn("ext", extension(F.col("path")))
    # hidden folders above the given one don't matter
    below = F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(re.sub("^[a-z]+:/*", "/", folder).rstrip("/")), F.lit(""))
    x = x.where(F.col("ext").isin(*kinds) & ~below.rlike(r"/\.[^/]+"))
    if only:
        x = x.where(F.contains(F.lower("path"), F.lit(only.lower())))
    return x.where(~F.contains(F.lower("path"), F.lit(exclude.lower()))) if exclude else x


def scan_report(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _plain(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


_SKIPPED = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>")
_BREAKS = re.compile(r"(?is)</?(?:p|div|br|h[1-6]|li|tr|section|article|blockquote)(?:\s[^>]*)?/?>")


def html_paragraphs(page: str) -> str:
    text = html.unescape(re.sub(r"(?s)<[^>]*>", "", _BREAKS.sub("\n\n", _SKIPPED.sub("", page))))
    return "\n\n".join(p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", text)) if p)


def _epub(data: bytes) -> str:
    """The pages of the spine in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        package = next((n for n in names if n.endswith(".opf")), None)
        order = [n for n in names if n.endswith((".xhtml", ".html", ".htm"))]
        if package:
            opf = _plain(z.read(package))
            tags = [dict(re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', t)) for t in re.findall(r"<item\b[^>]*>", opf)]
            href = {t.get("id"): t.get("href", "") for t in tags}
            spine = [href.get(i, "") for i in re.findall(r'<itemref\b[^>]*idref\s*=\s*"([^"]*)"', opf)]
            order = [n for h in spine if h for n in names if n.endswith("/" + h) or n == h] or order
        return "\n\n".join(t for t in (html_paragraphs(_plain(z.read(n))) for n in order) if t)


#: ext -> bytes to text. PDF, DJVU and MOBI need libraries or programs; callers add theirs.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": _plain, "html": _plain, "htm": _plain, "epub": _epub}


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """rel_path, text, error: a file that can't be read is a row with its error, not a failed job."""
    use = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, ext, data in b[["path", "ext", "content"]].itertuples(index=False):
                try:
                    out.append((path, use[ext](bytes(data)), None))
                except KeyError:
                    out.append((path, None, f"no extractor for {ext}"))
                except Exception as e:  # noqa: BLE001  whatever a broken file makes a library raise
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["rel_path", "text", "error"])

    return files.select("path", "ext", "content").mapInPandas(run, FILE)


def preferring_recognised(extracted: DataFrame, recognised: DataFrame) -> DataFrame:
    """Recognised text wins over the file's own. recognised: rel_path, ocr_text."""
    return extracted.join(recognised, "rel_path", "left").withColumn("text", F.coalesce("ocr_text", "text")).drop("ocr_text")


def recognised_pages(texts: DataFrame, key: str = "rel_path") -> DataFrame:
    """(key, page, text) from texts with lines `--- Page n ---`; lines before the first mark belong to no page."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    mark = F.regexp_extract("line", r"^--- Page (\d+) ---$", 1)
    so_far = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("mark", F.nullif(mark, F.lit("")).cast("int")).withColumn("page", F.last("mark", ignorenulls=True).over(so_far))
    x = x.where("page IS NOT NULL AND mark IS NULL").groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return x.select(key, "page", F.regexp_replace(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), r"^\s+|\s+$", "").alias("text"))


def package_metadata(texts: DataFrame, key: str = "rel_path") -> DataFrame:
    """Title and subjects of Dublin Core package files."""
    clean = F.regexp_replace(F.regexp_replace("text", r"<(/?)dc:", "<$1"), r'\sxmlns(:\w+)?="[^"]*"', "")
    clean = F.regexp_replace(clean, r"\s\w+:\w+=\"[^\"]*\"", "")
    return texts.select(key, F.xpath_string(clean, F.lit("//title")).alias("title"), F.xpath(clean, F.lit("//subject/text()")).alias("tags"))


def progress(lines: DataFrame) -> DataFrame:
    """i, n, done, skip, err from progress lines; others go. Works on a stream of lines too."""
    form = r"\[(\d+)/(\d+)\].*?done=(\d+).*?skip=(\d+).*?err=(\d+)"
    got = [F.regexp_extract("value", form, k + 1).cast("long").alias(c) for k, c in enumerate(("i", "n", "done", "skip", "err"))]
    return lines.where(F.col("value").rlike(form)).select(*got)


GOLDEN = "query string, expected_title string, set string, filter_kind string, mode string, expected_works array<string>, expected_titles array<string>"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; without a mode, rows with expected works are of mode topic."""
    x = spark.read.schema(GOLDEN).json(path).withColumn("expected_works", F.coalesce("expected_works", "expected_titles")).drop("expected_titles")
    return x.withColumn("mode", F.coalesce("mode", F.when(F.col("expected_works").isNotNull(), "topic").otherwise("retrieval")))


QUESTION = "struct<qid:string,q:string,type:string,difficulty:string,choices:array<string>,answer:string,unit:string,provenance:struct<title:string,section_title:string,parent_id:string,excerpt_snippet:string>>"


def quizzes(spark: SparkSession, path: str) -> DataFrame:
    """Quiz files: one row for each question."""
    x = spark.read.schema(f"id string, questions array<{QUESTION}>").option("multiLine", True).json(path)
    return x.select(F.col("id").alias("quiz_id"), F.explode("questions").alias("question"))


def json_object(text: Column, schema: str) -> Column:
    """The object from the first brace to the last one, as answers with fences or prose around it have it."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


KEYS = ("Q", "ANSWER", "DIFFICULTY", "TYPE")


def question_blocks(texts: DataFrame, key: str = "doc") -> DataFrame:
    """Questions from plain blocks between lines of dashes: `KEY: value` lines and choices A to D."""
    blocks = texts.select(key, F.posexplode(F.split("text", r"(?m)^-{3,}\s*$")).alias("i", "block")).where("trim(block) <> ''")
    got = [F.trim(F.regexp_extract("block", rf"(?im)^\s*{k}\s*:\s*(.+)$", 1)).alias(k.lower()) for k in KEYS]
    choices = F.transform(F.regexp_extract_all("block", F.lit(r"(?m)^\s*([A-D][).:]\s*.+)$"), F.lit(1)), lambda c: F.trim(c))
    return blocks.select(key, "i", *got, choices.alias("choices")).where("q <> ''")


def tool_call(text: Column) -> Column:
    """Name and JSON of `call: name({...})`, or null."""
    name = F.nullif(F.regexp_extract(text, r"(?is)call:\s*(\w+)\s*\(", 1), F.lit(""))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.regexp_extract(text, r"(?is)call:\s*\w+\s*\((\{.*\})\s*\)", 1).alias("arguments")))
