"""Sources and sinks: CSV, JSON lines, Parquet, whole texts, mixed folders, binary documents."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard row of a corpus.
CORPUS = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("topic_id", T.StringType())])
#: Column names under which each field may come, the first that is there counts.
CANDIDATES = {"text": ("text", "essay", "input_text", "document"), "label": ("generated", "label", "class", "is_ai"), "source": ("source", "prompt_name", "prompt_id"), "topic_id": ("topic_id", "prompt_name", "prompt_id", "prompt", "instructions")}


def discover(df: DataFrame) -> DataFrame:
    """``df`` as CORPUS; a missing text or label is an error, other missing fields are null."""
    found = {k: next((c for c in names if c in df.columns), None) for k, names in CANDIDATES.items()}
    for k in ("text", "label"):
        if not found[k]:
            raise ValueError(f"no column for {k} among {df.columns}")
    of = lambda f: F.col(f"`{found[f.name]}`") if found[f.name] else F.lit(None)
    whole = lambda f: F.nullif(of(f).cast("string"), F.lit("")) if f.name == "label" else of(f)
    return df.select(*[whole(f).cast(f.dataType).alias(f.name) for f in CORPUS])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings. A field without quotes and characters is null, one with quotes only is empty: what stands for null
    while Spark reads is drawn anew, so that no text is that."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex)


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as ``read_csv`` reads it: blanks are kept, empty texts are quoted and nulls are not."""
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")


def read_corpus(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A corpus file of any naming as CORPUS."""
    return discover(read_csv(spark, path) if kind == "csv" else spark.read.format(kind).load(path))


def read_splits(spark: SparkSession, folder: str, names: Iterable[str] = ("train", "val", "test")) -> DataFrame:
    """The splits of a folder with a column split; one that is missing is an error."""
    out = None
    for n in names:
        part = spark.read.parquet(f"{folder}/{n}").withColumn("split", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def write_splits(df: DataFrame, folder: str, split: str = "split") -> None:
    for n in ("train", "val", "test"):
        df.where(F.col(split) == n).drop(split).write.mode("overwrite").parquet(f"{folder}/{n}")


def read_folder(spark: SparkSession, folder: str, kinds: Iterable[str] = ("parquet", "csv", "txt")) -> DataFrame:
    """All texts of a folder's Parquet, CSV and text files but readme*, with label 0; empty and typed if none."""
    out = spark.createDataFrame([], CORPUS)
    for k in kinds:
        try:
            r = spark.read.option("pathGlobFilter", f"[!rR]*.{k}").option("recursiveFileLookup", "true")
            if k == "txt":
                d = r.text(folder, wholetext=True).select(F.col("value").alias("text"))
            elif k == "csv":
                d = r.csv(folder, header=True, multiLine=True, escape='"')
            else:
                d = r.parquet(folder)
            if not d.columns:
                continue
            out = out.unionByName(discover(d.withColumn("label", F.lit(0))))
        except Exception as e:  # noqa: BLE001 - Spark says so if a kind has no file
            if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def read_papers(spark: SparkSession, folder: str, least: int = 1000, most: int = 8000) -> DataFrame:
    """(path, text, n_tokens) of whole text files within a range of tokens."""
    from ..functions.text import n_tokens

    d = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return d.withColumn("n_tokens", n_tokens("text")).where(F.col("n_tokens").between(least, most))


def read_jsonl(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON lines, or a JSON array; malformed lines are skipped."""
    return spark.read.schema(schema).option("multiLine", array).option("mode", "DROPMALFORMED").json(path)


def kind_of(content: Column, name: Column) -> Column:
    """pdf, docx, doc or text by a file's first bytes, else by its name. A zip is a .docx if the name of the part with
    the text, which zips store plainly, stands in it."""
    head = F.hex(F.substring(content, 1, 8))
    ends = lambda x: F.lower(name).endswith(x)
    part = F.contains(content, F.lit(b"word/document.xml"))
    return F.when(head.startswith("255044462D"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "doc").when(head.startswith("504B0304") & part, "docx").when(ends(".pdf"), "pdf").when(ends(".docx"), "docx").when(ends(".doc"), "doc").otherwise("text")


#: The extensions that are taken, and the most bytes of a file.
EXTENSIONS, MOST_BYTES = ("pdf", "docx", "doc"), 25 * 1024 * 1024


def guarded(name: Column, size: Column, text: Column) -> Column:
    """unsupported, too_large, empty or ok of a file's name, its bytes and the text read from it."""
    return F.when(~F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*EXTENSIONS), "unsupported").when(size > MOST_BYTES, "too_large").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("ok")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> tuple[str, int]:
    """The paragraphs and table rows of a .docx, joined by empty lines, and its pages at 450 words each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            out.append(said(e))
        elif e.tag == f"{_W}tbl":
            out += [" | ".join(said(c) for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr")]
    text = "\n\n".join(x for x in out if x)
    return text, max(1, -(-len(text.split()) // 450))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, pages) of .docx files; a file that cannot be read has a null text."""

    @F.pandas_udf("text string, pages int")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                rows.append(docx_text(b))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["text", "pages"])

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("x")).select("path", "x.text", "x.pages")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The inputs that a partial result does not have yet."""
    return inputs.join(done.select(key), key, "left_anti")
