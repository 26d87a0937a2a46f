"""What the operators need of the cluster: the package's source on the executors, and a folder that all of them share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for a session's context, so that its tasks import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_fluence_sent", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fluence-")) / "fluence_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._fluence_sent = True


def shipped(query):
    """query, which sends the package before it runs."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local one only where it is unset and all executors are this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def merged(df: DataFrame) -> DataFrame:
    """df for joins by keys with tables that grow as it does: both are shuffled and merged, even where Spark takes one for small
    enough to be collected at the driver and broadcast. A query of many joins held all these tables there."""
    return df.hint("merge")


def stored_bytes(df: DataFrame) -> int:
    """The size of the files that df is read from, by their listing: no row of them is read. 0 where there are none."""
    files = [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in df.inputFiles()]
    return df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0 if files else 0


def kept(df: DataFrame, plain: bool = True) -> DataFrame:
    """df written to the shared folder and read back, for steps that several branches read: it is made once, plans stay small, and a
    lost executor loses nothing. The files belong to the session that asked and are cleared with its checkpoint folder.

    They are plain: Spark takes a file's size for the size of its rows, and spans or cells shrink a hundredfold when they are encoded,
    so that tables of any number of rows would be collected at the driver and broadcast. Not so (plain=False) for large tables with
    numbers that hardly shrink."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    out = df.write.option("compression", "none").option("parquet.enable.dictionary", "false") if plain else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
