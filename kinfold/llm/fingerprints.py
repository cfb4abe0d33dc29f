"""Document fingerprints: one-permutation MinHash with optimal densification and packed b-bit values (operator 4).

Each distinct word shingle is hashed once; its upper bits choose one of BINS bins, each of which keeps its least hash. An
empty bin borrows from the bin that a fixed universal hash of (bin, attempt) names, attempt by attempt, until it hits a
filled one (Shrivastava 2017); after ATTEMPTS misses, which only sets of a few elements reach, from the next filled bin in
the ring. The low BITS bits of each bin are packed. Bins of unlike sets agree with chance C = 2**-BITS, so the likeness is
(matches - C) / (1 - C).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions
from ._text import U64, Bytes, column_bytes, mix, shingles, slices, tokens

BINS, BITS, ATTEMPTS = 512, 4, 64
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_TARGET = (mix(np.arange(BINS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15) + mix(np.arange(1, ATTEMPTS + 1, dtype=U64))[:, None]) % U64(BINS)).astype(np.int64)


def bins(texts: Bytes, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled): the low bits of each text's densified bins, one row for each text; whether it has any element."""
    n = len(texts)
    doc, h = shingles(tokens(texts), width)
    least = np.full(n * BINS, _NONE, U64)
    np.minimum.at(least, doc * BINS + (h >> U64(55)).astype(np.int64), h & U64((1 << 55) - 1))
    least = least.reshape(n, BINS)
    filled = least != _NONE
    has = filled.any(1)
    row, at = np.nonzero(~filled & has[:, None])
    out = least.copy()
    for target in _TARGET:
        if not len(row):
            break
        hit = filled[row, target[at]]
        out[row[hit], at[hit]] = least[row[hit], target[at[hit]]]
        row, at = row[~hit], at[~hit]
    step = 1
    while len(row):
        near = (at + step) % BINS
        hit = filled[row, near]
        out[row[hit], at[hit]] = least[row[hit], near[hit]]
        row, at, step = row[~hit], at[~hit], step + 1
    return (mix(out) & U64((1 << BITS) - 1)).astype(np.uint8), has


def packed(values: np.ndarray, has: np.ndarray) -> list[str]:
    """Base64 of two bins a byte; '' for a text without words."""
    raw = values[:, 0::2] << 4 | values[:, 1::2]
    return [base64.b64encode(raw[i].tobytes()).decode() if has[i] else "" for i in range(len(raw))]


def unpacked(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.stack([raw >> 4, raw & 15], 1).reshape(-1)


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Bias-corrected estimate of the Jaccard likeness, row by row; two texts without words are alike, one is not."""
    chance = 2.0**-BITS
    est = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(has_a & has_b, est, (has_a == has_b).astype(float))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(id, n_chars, fingerprint) of each row; a null text counts as empty."""

    def run(batches):
        for b in slices(batches, text, rows=1500):
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([len(x or "") for x in b.column(text).to_pylist()], pa.int64()), pa.array(packed(*bins(column_bytes(b.column(text)), width)), pa.string())], [id_col, "n_chars", "fingerprint"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, last, id, text) which, sorted by all but the text's size, have each row's successor right below it.

    Ids are cut into ranges of about equal counts. The first row of the range after (of the first, after the last) is put
    below each range, so that ranges are worked on apart: one exchange of the texts, and a row more for each range.
    Nulls come first; rows of one id are ordered by text, null first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = sorted({int(x) for x in rows.stat.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    bucket = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("id")))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    low = F.coalesce("id", F.lit(-(1 << 63)))
    heads = {r["bucket"]: r["low"] for r in rows.groupBy("bucket").agg(F.min(low).alias("low")).collect()}  # one for each range
    order = sorted(heads)
    after = [(b, heads[order[(i + 1) % len(order)]]) for i, b in enumerate(order)]
    tails = spark.createDataFrame(after, "bucket int, low long")
    first = rows.withColumn("low", low).join(F.broadcast(tails.select("low").distinct()), "low").groupBy("low").agg(F.first("id").alias("id"), F.min("text").alias("text"))
    ends = F.broadcast(tails).join(first, "low").select("bucket", F.lit(True).alias("last"), "id", "text")
    return rows.select("bucket", F.lit(False).alias("last"), "id", "text").union(ends)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Each row's fingerprint, that of its text with the last quarter replaced from the next document, and two likenesses."""
    rows = with_next(docs, id_col, text)
    dealt = rows.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "last", F.col("id").asc_nulls_first(), "text")

    def run(batches):
        held = None  # the row whose successor comes with the next slice
        for b in slices(batches, "text", rows=1500):
            values, has = bins(column_bytes(b.column("text")), width)
            now = (b.column("bucket").to_pylist(), b.column("last").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist(), values, has)
            if held is not None:
                now = tuple(np.concatenate((x, y)) if isinstance(y, np.ndarray) else x + y for x, y in zip(held, now, strict=True))
            bucket, last, ids, texts, values, has = now
            held = tuple(x[-1:] for x in now)
            use = [i for i in range(len(ids) - 1) if not last[i]]
            if not use:
                continue
            edited = []
            for i in use:
                cut = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            new, new_has = bins(column_bytes(pa.array(edited, pa.string())), width)
            at = np.array(use)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in use], pa.int64()), pa.array([len(texts[i]) for i in use], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in edited]), pa.array(packed(values[at], has[at])), pa.array(packed(new, new_has)),
                    pa.array(likeness(values[at], has[at], new, new_has)), pa.array(likeness(values[at], has[at], values[at + 1], has[at + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
