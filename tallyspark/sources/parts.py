"""Text corpora, and tables that are built part by part and can be taken up again."""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.control import write_json


def documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Whole text files below a folder: path, name, text."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return files.select(at.alias("path"), F.element_at(F.split(at, "/"), -1).alias("name"), F.col("value").alias("text"))


#: The namespace of paragraphs, texts and styles in a word-processor file. Fixed value.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_text(content: bytes) -> str:
    """The paragraphs of a .docx file as Markdown: heading styles become `#` to `###`, empty paragraphs go."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{WORD}p"):
        text = "".join(t.text or "" for t in p.iter(f"{WORD}t")).strip()
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name = (style.get(f"{WORD}val") or "").lower() if style is not None else ""
        level = int(name[7:]) if name.startswith("heading") and name[7:].isdigit() else 0
        if text:
            out.append(f"{'#' * min(level, 3)} {text}" if level else text)
    return "\n\n".join(out)


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """The .docx files below a folder: path, name, text. A file that can't be read has a null text."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = []
            for content in rows.content:
                try:
                    texts.append(word_text(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": rows.path, "name": rows.path.str.rsplit("/", n=1).str[-1], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(made, "path string, name string, text string")


def write_as(df: DataFrame, path: str, kind: str = "csv", order: list[str] | None = None) -> None:
    """Write a table as csv (with a header), json or parquet; sorted by `order` if given, over as many files as it has parts."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format: {kind}")
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_arrays(df: DataFrame, path: str, arrays: list[str], most: int = 1_000_000) -> None:
    """A table's numeric and fixed-length array columns as one .npz file, for training elsewhere.

    A path that ends in .npy takes the one array there is. The file is one machine's to read, so the table may have `most`
    rows; a larger one raises and belongs in Parquet.
    """
    rows = df.select(*arrays).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write Parquet instead")
    made = {c: np.array(rows[c].tolist()) for c in arrays}
    if path.endswith(".npy"):
        (only,) = made.values()
        np.save(path, only)
    else:
        np.savez_compressed(path, **made)


def write_parameters(path: str, **values) -> None:
    """A fitted model's parameters as one JSON file, written whole or not at all: numbers, texts, lists, dictionaries and arrays."""

    def plain(x):
        if isinstance(x, np.ndarray):
            return {"array": x.tolist(), "dtype": x.dtype.str, "shape": list(x.shape)}
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    write_json(path, plain(values))


def read_parameters(path: str) -> dict:
    """What write_parameters wrote; tuples come back as lists, keys of dictionaries as texts."""

    def whole(x):
        if isinstance(x, dict):
            return np.array(x["array"], x["dtype"]).reshape(x["shape"]) if set(x) == {"array", "dtype", "shape"} else {k: whole(v) for k, v in x.items()}
        return [whole(v) for v in x] if isinstance(x, list) else x

    with open(path, encoding="utf-8") as f:
        return whole(json.load(f))


def optional(spark: SparkSession, path: str, schema: str, reader: str = "csv") -> DataFrame:
    """A source that may not be there: then a table of its schema without rows."""
    try:
        return spark.read.format(reader).schema(schema).option("header", True).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def combined_lines(history: DataFrame, live: DataFrame, key: list[str], season: str, value: str) -> DataFrame:
    """Live lines, the mean of their sources, in place of history for their seasons."""
    now = live.groupBy(*key, season).agg(F.avg(value).alias(value))
    kept = history.join(F.broadcast(now.select(season).distinct()), season, "left_anti")  # a season or so
    return kept.select(*key, season, value).unionByName(now)


def build_parts(spark: SparkSession, root: str, column: str, wanted: list[str], make: Callable[[str], DataFrame], budget: float | None = None, clock: Callable[[], float] = time.monotonic) -> list[str]:
    """Make and write the partitions of `root` that aren't there yet; the names of those made. A part is whole or absent.

    With a `budget` of seconds, no part is begun once it is used up; the next call takes up where this one stopped.
    """
    began = clock()
    try:
        have = {str(r[0]) for r in spark.read.parquet(root).select(column).distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = set()
    made = []
    for name in wanted:
        if name in have or budget is not None and clock() - began >= budget:
            continue
        made.append(name)
        rows = make(name).withColumn(column, F.lit(name))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(root)
    return made
