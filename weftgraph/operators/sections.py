"""Sections of documents, found within each row: no line becomes a row before its section is known, and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import WHITE, slug

_BLANK = r"^[ \t\n\x0B\f\r]*$"


def heading(line: Column) -> Column:
    """The text of a heading line, null for other lines and for signs alone."""
    text = F.regexp_replace(F.regexp_replace(line, r"^[ \t\n\x0B\f\r]+", ""), r"[ \t\n\x0B\f\r]+$", "")
    label = F.trim(F.regexp_replace(text, r"^#+", ""))
    return F.when(text.startswith("#") & (label != ""), label)


def label_of(body: Column, most: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(body, WHITE, " "))
    return F.when(flat == "", F.lit("Untitled section")).when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def _strip(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+", ""), r"[ \t\n\x0B\f\r]+$", "")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, line, label, body): a section for each heading, with what precedes the first; without headings, for each paragraph.

    A section's line is its first body line, the heading's own if it has none.
    Null or blank texts have no section.
    """
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\n$", "")
    d = docs.select(F.col(key), F.split(flat, "\n").alias("lines"))
    index = F.sequence(F.lit(0), F.size("lines") - 1)
    at = lambda i: F.element_at(F.col("lines"), i + 1)
    d = d.withColumn("heads", F.filter(index, lambda i: heading(at(i)).isNotNull()))
    d = d.withColumn("starts", F.filter(index, lambda i: ~at(i).rlike(_BLANK) & ((i == 0) | F.coalesce(F.get(F.col("lines"), i - 1), F.lit("")).rlike(_BLANK))))
    end = lambda marks, k: F.coalesce(F.get(F.col(marks), k + 1), F.size("lines"))

    def headed(h: Column, k: Column) -> Column:
        size = end("heads", k) - h - 1
        return F.struct((h + F.when(size > 0, 2).otherwise(1)).alias("line"), heading(at(h)).alias("label"), _strip(F.array_join(F.slice(F.col("lines"), h + 2, size), "\n")).alias("body"))

    before = F.slice(F.col("lines"), F.lit(1), F.element_at("heads", 1))
    intro = _strip(F.array_join(F.filter(before, lambda x: ~x.rlike(_BLANK)), "\n"))
    first = F.element_at(F.filter(index, lambda i: ~at(i).rlike(_BLANK)), 1)
    lead = F.filter(F.array(F.struct((first + 1).alias("line"), label_of(intro).alias("label"), intro.alias("body"))), lambda s: s["body"] != "")

    def paragraph(i: Column, k: Column) -> Column:
        body = F.array_join(F.filter(F.slice(F.col("lines"), i + 1, end("starts", k) - i), lambda x: ~x.rlike(_BLANK)), "\n")
        return F.struct((i + 1).alias("line"), label_of(body).alias("label"), body.alias("body"))

    parts = F.when(F.size("heads") > 0, F.concat(lead, F.transform("heads", headed))).otherwise(F.transform("starts", paragraph))
    return d.select(key, F.posexplode(parts).alias("at", "s")).select(key, "at", F.col("s.line").alias("line"), F.col("s.label").alias("label"), F.col("s.body").alias("body"))


def document_nodes(docs: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes of files and their sections, and the `contains` edges between them."""
    files = docs.select(slug(F.col(path)).alias("id"), F.substring_index(path, "/", -1).alias("label"), F.lit("document").alias("file_type"), F.col(path).alias("source_file"), F.lit("L1").alias("source_location"), F.lit("file").alias("node_type"))
    s = sections(docs, path, text)
    sid = F.concat(slug(F.col(path)), F.lit("_section_"), (F.col("at") + 1).cast("string"))
    parts = s.select(sid.alias("id"), "label", F.lit("document").alias("file_type"), F.col(path).alias("source_file"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"), F.lit("section").alias("node_type"))
    edges = s.select(slug(F.col(path)).alias("source"), sid.alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))
    return files.unionByName(parts), edges
