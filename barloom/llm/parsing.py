"""Dedup of repeated byte strings by anchor hashes, in place of a suffix array over a prefix-free parse."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, keep_columns, read
from barloom.llm.repeats import merged, named, repeated
from barloom.llm.words import BYTE, flatten

# Length of a repeated string, positions among which its anchor is chosen, and bytes of the hash that chooses it.
LENGTH, PHRASE, TRIGGER = 400, 200, 16


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, first = flatten(texts)
    return BYTE[raw], first


CUT = "struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>"


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans, as bytes, with counts."""
    raw, first = flatten(texts)
    owner, start, end = merged(spans)
    edges = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edges, first[owner] + start, 1)
    np.add.at(edges, first[owner] + end, -1)
    kept = np.cumsum(edges)[:-1] == 0
    gone = np.bincount(owner, (end - start).astype(float), len(texts)).astype(np.int64)
    sizes = np.diff(first) - gone
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = raw[kept].tobytes()
    binary = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pa.StructArray.from_arrays(
        [binary.cast(pa.binary()), pa.array(np.diff(first)), pa.array(gone), pa.array(np.bincount(owner, minlength=len(texts)))],
        names=["kept", "n_bytes", "n_removed", "n_spans"])


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, phrase: int = PHRASE, trigger: int = TRIGGER) -> DataFrame:
    """``docs`` with ``kept`` (bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Removed is each byte of a text's UTF-8 covered by a string of ``length`` bytes that also starts anywhere
    else, in the same text or another; strings lie within one text and are judged on the input.

    This is not a prefix-free parse with a suffix array: no phrases, dictionary, parse or order of suffixes are made.
    Strings are grouped by hashes of the anchors that their content chooses (``repeats``), the least hash of
    ``trigger`` bytes among their first ``phrase`` positions. Equality of strings is that of 128-bit hashes.

    Null texts are empty and keep null ids; repeated rows remove each other if they are long enough. Columns of
    the names added are replaced; no rows give no rows.
    """
    source = named(docs, text)
    spans = repeated(source, bytes_of, length, phrase, trigger, earlier=False)

    @F.arrow_udf(CUT)
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return cut(texts, spans)

    made = ("kept", "n_bytes", "n_removed", "n_spans")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_th": F.xxhash64(body)})
    spans = spans.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = rows.join(spans.hint("merge"), ["_doc", "_th"], "left").withColumn("_cut", run(body, F.coalesce("_spans", none)))
    return joined.select(*[F.col(f"`{c}`") for c in keep_columns(docs, *made)], "_cut.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
