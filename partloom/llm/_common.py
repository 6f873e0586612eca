"""Helpers that every training-data operator shares."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_folder, remove_folder, settle, shared_dir  # noqa: F401

#: The white space of every word rule here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Bind a costly column once: ``body`` sees a lambda variable, which the optimizer can't inline again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files lie; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_copy(path: str) -> str:
    """A tokenizer file as executors see it: the given path, or the same file of this machine's own install."""
    return path if os.path.exists(path) else tokenizer_path(os.path.basename(path))
