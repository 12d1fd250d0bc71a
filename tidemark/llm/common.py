"""What the operators of this subpackage share: tables in the shared folder, and word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import discard, release, scratch_path, shared_dir, ship, written

__all__ = ["SPACES", "discard", "free_name", "release", "scratch_path", "shared_dir", "ship", "with_text", "words_of", "written"]

#: Fixed: what separates words, as in the contracts (`[^\x20\x09-\x0D]+` is a word).
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it takes to be no column of an input (Spark's names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, renamed, so that no further column of the input can clash; for Python workers."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
