"""Tables to files."""

from __future__ import annotations

import csv
import glob
import os
import re
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import col

#: Field separators by extension (fixed values).
SEPARATORS = {"csv": ",", "psv": "|", "tsv": "\t", "txt": "\t"}


def text_booleans(df: DataFrame, as_ints: bool = False) -> DataFrame:
    """``df`` with booleans as true/false in text, or 1/0."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean"]
    new = {n: col(n).cast("int") if as_ints else F.when(col(n), "true").when(~col(n), "false") for n in names}
    return df.withColumns(new) if new else df


def kind_of(path: str) -> str:
    kind = "csv" if path == "-" else os.path.splitext(path)[1].lstrip(".").lower()
    if kind != "parquet" and kind not in SEPARATORS:
        raise ValueError(f"can't write {path}: unknown extension")
    return kind


def check_writable(spark: SparkSession, path: str) -> None:
    """Raises an error if a table can't be written to a path: before the work, not after it. What is there stays."""
    kind_of(path)
    if path == "-":
        return
    if re.match(r"(?!file:)[A-Za-z][\w+.-]+:", path):  # the file system asks its own permissions
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        store, up = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place.getParent()
        while up is not None and not store.exists(up):
            up = up.getParent()
        if up is not None:
            store.access(up, jvm.org.apache.hadoop.fs.permission.FsAction.WRITE)
        return
    up = os.path.dirname(os.path.abspath(path.removeprefix("file://")))
    while not os.path.exists(up):
        up = os.path.dirname(up)
    if not os.path.isdir(up) or not os.access(up, os.W_OK):
        raise PermissionError(f"can't write {path}: no folder to write in")


def save(df: DataFrame, path: str, single_file: bool = False, boolean_ints: bool = False) -> None:
    """Writes ``df`` as its path's extension says: parquet, csv, psv, tsv or txt; ``-`` prints it as CSV.

    Spark writes a folder of part files. ``single_file`` makes it one file instead, by one task, for local paths.
    """
    kind = kind_of(path)
    if path == "-":
        rows = text_booleans(df, boolean_ints)
        out = csv.writer(sys.stdout, lineterminator="\n")
        out.writerow(rows.columns)
        out.writerows(rows.toLocalIterator())
        return
    target = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path))) + "/out" if single_file else path
    if kind == "parquet":
        if boolean_ints:
            df = text_booleans(df, True)
        (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(target)
    else:
        rows = text_booleans(df, boolean_ints)
        (rows.coalesce(1) if single_file else rows).write.mode("overwrite").csv(target, header=True, sep=SEPARATORS[kind], encoding="UTF-8", quote='"', escape='"', emptyValue='""')
    if single_file:
        part = glob.glob(f"{target}/part-*")[0]
        if os.path.isdir(path):
            shutil.rmtree(path)
        os.replace(part, path)
        shutil.rmtree(os.path.dirname(target))
