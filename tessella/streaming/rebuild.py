"""Keeps a bundle up to date with a folder of documents.

A change of a type or timeline can change any row: a micro-batch that brings one rebuilds the whole bundle. Other documents
change their own rows alone; a batch of these is parsed by itself, with the declarations that the bundle keeps, and only the
parts of the bundle that hold its rows are written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources import bundle, markdown

_ERRORS = "severity = 'error'"


def rebuild(spark: SparkSession, documents: DataFrame, target: str) -> None:
    """Writes the bundle of all documents (path, text)."""
    graph, diagnostics = markdown.load(documents)
    bundle.write(graph, target, errors=diagnostics.where(_ERRORS).count(), declared=documents.where(markdown.DECLARES))
    markdown.release(graph)


def apply(spark: SparkSession, changed: DataFrame, target: str) -> bool:
    """Takes changed or new documents (path, text) into a bundle; False where that needs all documents."""
    if not bundle.exists(spark, target) or changed.where(markdown.DECLARES).head(1):
        return False
    held = bundle.declared(spark, target)
    if held is None or held.join(changed, "path", "left_semi").head(1):
        return False
    graph, diagnostics = markdown.load(held.unionByName(changed.select("path", "text")))
    try:
        errors = diagnostics.where(_ERRORS).count()
        ids = changed.select(F.col("path").alias("source")).join(graph.nodes.select("source", "id"), "source", "left")
        return bundle.update(graph, target, ids, errors)
    finally:
        markdown.release(graph)


def watch(spark: SparkSession, documents: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream; once: handles what is there and stops."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(documents, wholetext=True)
    files = markdown.documents(files, documents)

    def step(batch, _):
        if not batch.isEmpty():
            session = batch.sparkSession
            if not apply(session, batch, target):
                rebuild(session, markdown.read(session, documents), target)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()
