"""Shared helpers: tables, staged intermediates, column names that may clash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks; a word is a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Temporary folders of local sessions (tests), by application.
LOCAL_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_ROOTS:
        LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-staged-")
    return LOCAL_ROOTS[app]


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/staged-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: one computation, no lineage,
    and a lost executor costs a re-read only. The folder's own retention removes the files."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A staged side of a few numbers a row travels to all tasks up to so many rows; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def small_side(rows: DataFrame) -> DataFrame:
    """rows (staged, a few numbers each) with a hint to broadcast them where their counted size is within the bound."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def set_aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rename input columns that clash with output columns to <name>_in (again until the name is free)."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        for column in [c for c in df.columns if c.lower() == name.lower()]:
            new = f"{column}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(column, new)
    return df


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator needs, under fixed names; whatever else docs has cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: word starts are non-blanks after a blank or the beginning."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
