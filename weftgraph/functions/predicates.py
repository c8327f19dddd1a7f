"""Predicates on nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.text import basename

STRUCTURAL = ("contains", "imports", "imports_from", "method")


def is_file_node(label: str | Column = "label", source: str | Column = "source_file", degree: str | Column = "degree", query: bool = False) -> Column:
    """A node that stands for a file, or for a method stub: `.x()`, or `x()` with one edge at most.

    With query=True, nodes without a source file never count, as queries treat them.
    """
    label, source, degree = (F.col(x) if isinstance(x, str) else x for x in (label, source, degree))
    call = label.endswith("()")
    found = ((source != "") & (basename(source) == label)) | (call & (label.startswith(".") | (degree <= 1)))
    return (label != "") & found & (source != "") if query else (label != "") & found


def is_concept_node(source: str | Column = "source_file") -> Column:
    """A node without a source file, or whose source has no file ending."""
    source = F.col(source) if isinstance(source, str) else source
    return (source == "") | ~basename(source).contains(".")


def is_structural(relation: str | Column = "relation") -> Column:
    return (F.col(relation) if isinstance(relation, str) else relation).isin(*STRUCTURAL)


def confidence_rank(confidence: str | Column = "confidence") -> Column:
    """0 for AMBIGUOUS, 1 for INFERRED, 2 for all else."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c == "AMBIGUOUS", 0).when(c == "INFERRED", 1).otherwise(2)


def default_score(confidence: str | Column = "confidence") -> Column:
    """The score of an edge that was written without one."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c == "INFERRED", F.lit(0.5)).when(c == "AMBIGUOUS", F.lit(0.2)).otherwise(F.lit(1.0))


def relation_matches(part: str, relation: str | Column = "relation") -> Column:
    return F.lower(F.col(relation) if isinstance(relation, str) else relation).contains(part.lower())
