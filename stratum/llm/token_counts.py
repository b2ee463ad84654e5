"""Token counts by a separator scan of flat token files.

A flat token file is nothing but ids, one document after another, each ended by the end-of-document
id; no index says where documents begin. The scan reads fixed blocks of the files in parallel, finds
the end ids of each block with one vectorised search, and a prefix scan over the blocks' summaries
(ids before, documents before, ids of the document that is open at the block's start) stitches the
documents that cross block boundaries.
"""

from __future__ import annotations

import contextlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.flat import flat, steps
from stratum.llm.shared import cut
from stratum.llm.tokens import WORD_TOKENIZER, word_encoder

#: What ends a document: 16 bits that no id of the vocabulary has, so that every id of a text is kept and counted.
END_ID = 65_535
#: The word tokenizer's own <|endoftext|>, which a text yields where it spells that name.
SPELLED_ID = 49_407
#: Bytes of a block: what one read and one search hold in memory.
BLOCK_BYTES = 8 << 20


def write_token_files(docs: DataFrame, folder: str, text: str = "text", tokenizer: str = WORD_TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts into flat files of little-endian unsigned 16-bit ids, one file a partition.

    Returns file, ordinal (the document's number in its file, from 0), doc_id and n_end_ids; it is
    materialised, so the files exist. A task writes under its attempt's name and renames at its end: a
    lost or repeated task leaves no partial file. ``end_id`` must be no id of the tokenizer; n_end_ids counts the ids
    of its end marker that the text itself spells. ``folder`` must be in a file system that all executors reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), word_encoder(tokenizer)
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{task.partitionId():06d}.u16"
        own = f"{root}/_{name}.{task.taskAttemptId()}"
        doc_ids: list[int | None] = []
        n_odd: list[int] = []
        with system.open_output_stream(own) as out:
            for part in steps(batches, text):
                ids, at = encoder.encode_flat(*flat(part.column(text)))
                if len(ids) and int(ids.max()) >= end_id:
                    raise ValueError(f"the tokenizer has ids from {end_id} on, which end documents")
                n_odd += np.diff(np.searchsorted(np.flatnonzero(ids == SPELLED_ID), at)).tolist()
                out.write(np.insert(ids.astype("<u2"), at[1:], end_id).tobytes())
                doc_ids += part.column("doc_id").to_pylist()
        if not doc_ids:
            system.delete_file(own)
            return
        if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            with contextlib.suppress(OSError):
                system.delete_file(f"{root}/{name}")
        system.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(doc_ids)), pa.array(np.arange(len(doc_ids))), pa.array(doc_ids, pa.int64()), pa.array(n_odd, pa.int64())], ["file", "ordinal", "doc_id", "n_end_ids"])

    return cut(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "file string, ordinal long, doc_id long, n_end_ids long"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file and n_bytes of the flat token files in ``folder``, as Spark lists it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.u16").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"))


def separator_scan(files: DataFrame, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: file, ordinal, start (ids before it in its file), n_tokens (without the end id).

    ``files`` holds file and n_bytes. Ids after a file's last end id form a document of their own
    (an unended one); a file without ids has no documents.
    """
    if block_bytes % 2:
        raise ValueError("a block must hold whole ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, row["n_bytes"] - row["block"] * block_bytes), row["block"] * block_bytes), "<u2")
                ends = np.flatnonzero(ids == end_id)
                if row["last"] and (not len(ends) or ends[-1] != len(ids) - 1):
                    ends = np.append(ends, len(ids))  # an unended document
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.astype("<i8").tobytes()], pa.binary())], ["file", "block", "n_ids", "n_ends", "last_end", "ends"])

    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / block_bytes))).alias("block")
    todo = files.filter("n_bytes > 1").select("file", "n_bytes", blocks).withColumn("last", F.col("block") == F.floor((F.col("n_bytes") - 1) / block_bytes))
    found = todo.repartition("file", "block").mapInArrow(scan, "file string, block long, n_ids long, n_ends long, last_end long, ends binary")
    # The prefix scan: a file's block summaries (three numbers each) in order.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        found.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("docs_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("open_from", F.coalesce(F.max(F.col("ids_before") + F.col("last_end") + 1).over(before), F.lit(0)))
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], "<i8") + row["ids_before"]
                starts = np.concatenate([[row["open_from"]], ends[:-1] + 1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(ends)), pa.array(row["docs_before"] + np.arange(len(ends))), pa.array(starts), pa.array(ends - starts)], ["file", "ordinal", "start", "n_tokens"])

    return stitched.filter("n_ends > 0").select("file", "ends", "ids_before", "docs_before", "open_from").mapInArrow(documents, "file string, ordinal long, start long, n_tokens long")


def token_counts(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_end_ids, file, ordinal, start of every document, by way of flat files in ``folder``.

    n_tokens counts every id of the text; n_end_ids those among them that the text gets by spelling the end marker. A null or empty text has 0 tokens. Equal doc_ids each keep their row; an empty table gives none.
    """
    names = write_token_files(docs, folder, text)
    counted = separator_scan(names.select("file").distinct().join(token_files(docs.sparkSession, folder), "file") if names.take(1) else docs.sparkSession.createDataFrame([], "file string, n_bytes long"), folder)
    return names.hint("merge").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "n_end_ids", "file", "ordinal", "start")
