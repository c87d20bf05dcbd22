"""What the operators share: inputs, the shared folder, word splitting, code for the workers."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tranche.session import ensure_checkpoint_dir

#: Runs of letters (any script); digits and underscores are no letters.
LETTERS = re.compile(r"[^\W\d_]+")

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table (other columns are never read)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Rows of an Arrow batch sent to a worker at most: texts can be long.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once per application.

    Cluster workers need not have the repository on their path; Spark's own
    file distribution carries a small zip of the sources to each of them.  The
    session's Arrow batches are limited to ``BATCH_ROWS``, unless they are smaller.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tranche-code-"), "tranche_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slices(batch, rows: int = 256):
    """An Arrow batch in runs of at most ``rows`` rows, so that few texts are Python objects at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def texts(batch, name: str = "text"):
    """Texts of an Arrow batch one by one, null as empty."""
    return (t or "" for some in slices(batch) for t in some.column(name).to_pylist())


def raw_texts(batch, name: str = "text"):
    """UTF-8 bytes of the texts of an Arrow batch one by one, null as empty."""
    return (t or b"" for some in slices(batch) for t in some.column(name).cast("binary").to_pylist())


def tidy(run):
    """A function for mapInArrow that, when a task ends, gives back the memory it no longer uses: workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()

    return wrapped


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, chosen by a hash of the id.

    The choice is made on the narrow label table first, so only ids (at most
    ``rows`` of them, hence a bounded broadcast) meet the documents.  Null
    labels and null ids are no examples; of several labels of one id the
    largest counts.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(keep)
              .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return (documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "label"))
