"""Readers with explicit schemas for labels, probabilities, id lists, sidecars, ledgers and images."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecrest.functions import keys as K
from sievecrest.operators.checks import require_columns
from sievecrest.operators.joins import prefixed

CORRUPT = "_corrupt"


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, name, stem, length) below a folder; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length")
    return files.select("path", K.base_name(F.col("path")).alias("name"), K.stem(F.col("path")).alias("stem"), "length")


def read_image_dir(spark: SparkSession, root: str, suffixes: Sequence[str] = K.IMAGE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """Image files below a folder by case-insensitive suffix; order them where order matters."""
    files = list_files(spark, root, recursive)
    return files.where(K.suffix(F.col("path")).isin(*[s.lower() for s in suffixes]))


def read_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Decoded images (``image`` struct of the image source); unreadable files are dropped."""
    return (
        spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "true").load(root)
        .withColumn("name", K.base_name(F.col("image.origin")))
    )


def read_class_dirs(spark: SparkSession, root: str, classes: Mapping[str, int], recursive: bool = True) -> DataFrame:
    """(id, label, class, group, source path) from one folder per class.

    Fails on a class without files and, while rows flow, on a file name used twice.
    """
    out = None
    for name, label in classes.items():
        part = read_image_dir(spark, f"{root.rstrip('/')}/{name}", recursive=recursive)
        if part.isEmpty():
            raise ValueError(f"no images for class {name}")
        part = part.select(
            F.col("name").alias("id"), F.lit(int(label)).alias("label"), F.lit(name).alias("class"),
            F.concat(F.lit(f"{name}:"), K.infer_group(F.col("name"))).alias("group"), "path",
        )
        out = part if out is None else out.unionByName(part)
    single = out.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    checked = single.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate image name: "), F.col("id"))).isNull())
    return out.join(checked.select("id"), "id")


def read_labels(spark: SparkSession, path: str | Sequence[str], id_col: str = "id", label: str = "label") -> DataFrame:
    """``id`` as string and ``label`` as int; a missing column is an error, extra columns are dropped."""
    df = spark.read.option("header", True).csv(path)
    require_columns(df, [id_col, label])
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("label"))


def read_probs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(id, prob_pos_corrected) from the corrected column, else the raw one; repeated ids fail the job."""
    df = spark.read.option("header", True).csv(path)
    require_columns(df, ["id"])
    found = [c for c in ("prob_pos_corrected", "prob_pos") if c in df.columns]
    if not found:
        raise ValueError("need prob_pos_corrected or prob_pos")
    rows = df.groupBy(F.col("id").cast("string").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.col(found[0]).cast("double")).alias("prob_pos_corrected")
    )
    ok = F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate id: "), F.col("id"))).isNull()
    return rows.where(ok).select("id", "prob_pos_corrected")


def read_prefixed(spark: SparkSession, path: str, prefix: str, key: str = "id") -> DataFrame:
    return prefixed(spark.read.option("header", True).csv(path), prefix, key)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed non-blank lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"))
    return lines.where(F.col("id") != "").distinct()


def read_number_list(spark: SparkSession, path: str) -> DataFrame:
    """Integers of an id list: a bare number or the stem of a file name."""
    return read_id_list(spark, path).select(K.id_number(F.col("id")).alias("number")).where(F.col("number").isNotNull()).distinct()


def discover_prob_tables(spark: SparkSession, folder: str, exclude: Sequence[str] = (), recursive: bool = False) -> DataFrame:
    """All probability CSV files of a folder in long form with file name (``model``) and folder."""
    df = (
        spark.read.option("header", True).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.csv")
        .schema("id string, prob_pos_corrected double").csv(folder)
    )
    out = df.select(
        "id", "prob_pos_corrected", F.col("_metadata.file_name").alias("model"),
        F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1).alias("folder"),
    )
    return out.where(~F.col("model").isin(*exclude)) if exclude else out


def read_json_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row from a JSON object; an array or another value is an error."""
    df = spark.read.option("multiLine", True).json(path)
    if CORRUPT in df.columns or "_corrupt_record" in df.columns:
        raise ValueError(f"{path} is not a JSON object")
    if df.limit(2).count() != 1:
        raise ValueError(f"{path} must hold one JSON object")
    return df


# The ledger's columns.
LEDGER_COLUMNS = ("commit", "primary_metric", "secondary_metric", "runtime_or_cost", "status", "description")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated run ledger; a row with a wrong field count or metric keeps its text in ``_corrupt``.

    Checked on the raw line: the CSV reader only validates columns a query asks for.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("\t".join(LEDGER_COLUMNS)))
    parts = lines.select("value", F.split("value", "\t").alias("_f"))
    fields = {c: F.try_element_at("_f", F.lit(i + 1)) for i, c in enumerate(LEDGER_COLUMNS)}
    metric = fields["primary_metric"].try_cast("double")
    broken = (F.size("_f") != len(LEDGER_COLUMNS)) | (metric.isNull() & (F.coalesce(fields["primary_metric"], F.lit("")) != ""))
    return parts.select(
        *[(metric if c == "primary_metric" else e).alias(c) for c, e in fields.items()], F.when(broken, F.col("value")).alias(CORRUPT)
    )


def discover_artifacts(files: DataFrame, suffix: str = ".pt", needs: str = "train_args.json") -> DataFrame:
    """(tag, path) of ``best`` and ``soup*`` files in folders that also hold the ``needs`` file."""
    parts = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), K.base_name(F.col("path")).alias("name"))
    wanted = parts.where((K.suffix(F.col("path")) == suffix) & ((K.stem(F.col("path")) == "best") | K.stem(F.col("path")).startswith("soup")))
    holders = parts.where(F.col("name") == needs).select("dir").distinct()
    return wanted.join(holders, "dir", "left_semi").select(F.concat(K.base_name(F.col("dir")), F.lit("/"), F.col("name")).alias("tag"), "path")
