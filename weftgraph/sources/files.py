"""Folders of files as tables: scan, classification, word counts, office texts, hashes and manifests."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from weftgraph.functions import text as T

#: From these many words a graph pays; beyond the second, or that many files, a warning is due.
OUT = "kg-out"  # results, which aren't scanned; answers saved there are listed by their own folder
GRAPH_WORDS, MANY_WORDS, MANY_FILES = 50_000, 500_000, 200


def ignore_regex(patterns: list[str]) -> str:
    """One pattern for lines of an ignore file: a path goes if it, a part of it or any of its beginnings matches; comments and blanks don't count."""
    globs = [p.strip().strip("/") for p in patterns if p.strip() and not p.strip().startswith("#")]
    one = [fnmatch.translate(g).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z").replace("(?>", "(?:") for g in globs]
    return r"(?s)(^|/)(" + "|".join(one) + r")(/|$)" if one else "(?!)"


def ignore_patterns(root: str | Path, name: str = ".kgignore") -> list[str]:
    """Lines of the ignore files of a folder and of those above it, up to the root of its repository."""
    out: list[str] = []
    for folder in (Path(root).resolve(), *Path(root).resolve().parents):
        if (folder / name).is_file():
            out += (folder / name).read_text(errors="replace").splitlines()
        if (folder / ".git").exists():
            break
    return out


def listing(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, content) below a folder, without hidden, noise, lock, secret and ignored files; paths are relative.

    Filters touch paths only, so the content of what they drop isn't read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    df = df.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"), "content")
    p = F.col("path")
    keep = ~p.startswith(f"{OUT}/") & ~T.is_hidden(p) & ~T.in_noise_folder(p) & ~T.is_lock_file(p) & ~T.is_sensitive(p)
    return df.filter(keep & ~p.rlike(ignore_regex(ignore or [])))


def decoded(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement sign, as a scan meets files of every kind."""
    return F.make_valid_utf8(content.cast("string"))


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, file_type, words, size, mtime) of the files that count; office files and videos have no words here."""
    df = listing(spark, root, ignore)
    plain = F.when(F.lower("path").rlike(r"\.(md|mdx|html|txt|rst)$"), decoded(F.col("content")))
    kind = T.file_type(F.col("path"), plain)
    office = F.lower("path").rlike(r"\.(docx|xlsx|pdf)$")
    counted = ~office & kind.isin("code", "document", "paper")
    return df.select("path", kind.alias("file_type"), F.when(counted, T.word_count(decoded(F.col("content")))).when(office, _office_words("path", "content")).otherwise(0).alias("words"), "size", "mtime").filter("file_type is not null")


@F.pandas_udf(IntegerType())
def _office_words(path: pd.Series, content: pd.Series) -> pd.Series:
    """Words of office files and PDFs; other files, whose content isn't needed, count none."""
    return pd.Series([len(bytes_text(p, c).split()) if p.lower().endswith((".docx", ".xlsx", ".pdf")) else 0 for p, c in zip(path, content)], dtype="int32")


def bytes_text(path: str, data: bytes) -> str:
    end = path.lower().rsplit(".", 1)[-1]
    return docx_text(data) if end == "docx" else xlsx_text(data) if end == "xlsx" else pdf_text(data)


def summary(files: DataFrame) -> DataFrame:
    """One row: files, words, needs_graph, warning."""
    t = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("words"), F.lit(0)).cast("bigint").alias("words"))
    warning = F.when(F.col("words") < GRAPH_WORDS, F.lit("small corpus: a graph may not be needed")).when((F.col("words") > MANY_WORDS) | (F.col("files") > MANY_FILES), F.lit("large corpus: extraction will take long"))
    return t.select("files", "words", (F.col("words") >= GRAPH_WORDS).alias("needs_graph"), warning.alias("warning"))


def totals(files: DataFrame) -> DataFrame:
    """(file_type, files, words) of each type."""
    return files.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("words").cast("bigint").alias("words")).orderBy("file_type")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Headings of three levels, lists, paragraphs and tables as Markdown; a broken file gives the empty text."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for part in body if body is not None else []:
        if part.tag == f"{_W}p":
            style = part.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "").lower().replace(" ", "")
            level = re.fullmatch(r"heading([123])", name)
            mark = "#" * int(level[1]) + " " if level else "- " if name.startswith("list") else ""
            if said(part):
                out.append(mark + said(part))
        elif part.tag == f"{_W}tbl":
            rows = [[said(c) for c in r.iter(f"{_W}tc")] for r in part.iter(f"{_W}tr")]
            for k, row in enumerate(rows):
                out.append("| " + " | ".join(row) + " |")
                if k == 0:
                    out.append("|" + " --- |" * len(row))
    return "\n\n".join(out)


def xlsx_text(data: bytes) -> str:
    """A Markdown table for each sheet with its name as heading; a broken file gives the empty text."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = z.namelist()
        texts = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")] if "xl/workbook.xml" in names else []
        out = []
        for k, name in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))):
            out.append(f"## {titles[k] if k < len(titles) else name}")
            for i, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_X}row")):
                cells = []
                for c in row.iter(f"{_X}c"):
                    v = c.find(f"{_X}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    cells.append(texts[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
                out.append("| " + " | ".join(x or "" for x in cells) + " |")
                if i == 0:
                    out.append("|" + " --- |" * len(cells))
        return "\n".join(out)
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError):
        return ""


_OPS = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>|T[Jj*dDm']|\bET\b|[\[\]]|-?\d+(?:\.\d+)?")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(data: bytes) -> str:
    """What the text operators of a PDF's content streams show, plain or deflated, in simple encodings; a file that can't be read gives the empty text.

    Fonts with encodings of their own, encrypted files and scans have none.
    """
    if not data.startswith(b"%PDF"):
        return ""
    out = []
    for m in re.finditer(rb"<<(.{0,2000}?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end if end >= 0 else len(data)]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" not in body:
            continue
        said: list[str] = []
        for op in _OPS.findall(body):
            if op[:1] == b"(":
                raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1].isdigit() else _ESCAPES.get(x[1], x[1]), op[1:-1], flags=re.S)
                said.append(raw.decode("latin-1"))
            elif op[:1] == b"<":
                digits = re.sub(rb"\s", b"", op[1:-1])
                said.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
            elif op in (b"T*", b"Td", b"TD", b"Tm", b"'", b"ET"):
                said.append("\n")
            elif re.fullmatch(rb"-\d+(?:\.\d+)?", op) and float(op) < -200:
                said.append(" ")  # a wide gap within a line
        text = re.sub(r"\n{2,}", "\n", "".join(said)).strip()
        if text:
            out.append(text)
    return "\n\n".join(out)


def office_texts(files: DataFrame) -> DataFrame:
    """(path, sidecar, text) of the office files of a listing; the sidecar's name ends with eight digits of the path's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [bytes_text(p, c) for p, c in zip(b["path"], b["content"])]})

    out = files.filter(F.lower("path").rlike(r"\.(docx|xlsx)$")).select("path", "content").mapInPandas(run, "path string, text string")
    stem = F.regexp_replace(T.basename(F.col("path")), r"\.[^.]*$", "")
    return out.select("path", F.concat(stem, F.lit("_"), F.substring(F.sha2("path", 256), 1, 8), F.lit(".md")).alias("sidecar"), "text")


def file_hash(content: Column, path: Column) -> Column:
    """Hash of a file's content and path; Markdown counts without its front matter."""
    text = decoded(content)
    body = F.when(F.lower(path).endswith(".md"), F.encode(T.strip_front_matter(text), "UTF-8")).otherwise(content)
    return F.sha2(F.concat(body, F.lit(b"\x00"), F.encode(path, "UTF-8")), 256)


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with what the cache holds, misses) by content hash."""
    keyed = files.withColumn("hash", file_hash(F.col("content"), F.col("path")))
    return keyed.drop("content").join(cache, "hash"), keyed.join(cache.select("hash"), "hash", "left_anti")


def save_manifest(files: DataFrame, path: str) -> None:
    files.select("path", "mtime").write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, mtime double").parquet(path)
