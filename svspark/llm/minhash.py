"""Operator 2: document fingerprints by MinHash.

A text's fingerprint holds, for each of PERMS universal hash permutations of
its five-word shingles, the least value. Texts that share one of BANDS bands of
it are candidates, joined in Spark; the Jaccard likeness of their whole shingle
sets verifies them (``linked`` in common), and ``class_id`` is the smallest
doc_id of the near duplicates so reached. At likeness 0.8 a pair shares no band
with a chance of (1 - 0.8**4)**16, under 0.0003.

Nulls count as empty texts. A text without words has the all-ones signature and
a class of its own. Documents are ordered by doc_id, nulls first, and where it
repeats by text hash; the next document is the next row of that order.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCKS, blocks, buckets_of, differences, linked, lower_words, mix, node_of, paired, parts, sets_apart, sifted, size_class, smallest_id, stars, table, texts_of, through, verified, width, word_shingles, written

PERMS, BANDS, ROUNDS = 64, 16, 2
_R = np.random.default_rng(7)
_A = _R.integers(1, 2**63, PERMS, dtype=np.uint64) | np.uint64(1)
_B = _R.integers(0, 2**63, PERMS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMS minima of (a*x+b) mod 2**64, upper 32 bits, in blocks of bounded size."""
    out = np.full(PERMS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048]
        out = np.minimum(out, (x[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    k = len(text) // 4
    return (text[: len(text) - k] + following[:k]) if k else text


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of one signature."""
    step = PERMS // BANDS
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in sig.reshape(BANDS, step).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
    return key


def near_classes(rows: DataFrame, texts: DataFrame, out: str = "class_id") -> DataFrame:
    """rows(doc_id, node, sig, n_shingles, fresh, ...) plus the near-duplicate class; rows marked fresh name each node at least once."""
    buckets = buckets_of(rows.sparkSession)

    def index(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            if len(node):
                keys = [band_keys(np.frombuffer(x.as_buffer(), "<u4")) for x in b.column("sig")]
                cls = np.array([size_class(n) for n in b.column("n_shingles").to_pylist()])
                yield blocks(np.concatenate(keys), np.repeat(cls, BANDS), np.zeros(len(cls) * BANDS, np.int64), np.zeros(len(cls) * BANDS, bool), np.repeat(node, BANDS), buckets)

    def verify(pairs, own):
        return through(sifted(pairs, own, sets_apart), lambda near: verified(near, own))

    def last(live, own):
        return through(paired(live, own, sets_apart), lambda near: verified(near, own))

    def deeper(live, own):
        pairs, sure = differences(live, own)
        return pairs, [sure, verify(pairs, own)]

    fresh = rows.where("fresh and n_shingles > 0").select("node", "sig", "n_shingles").mapInArrow(index, BLOCKS)
    return smallest_id(rows, linked(stars(fresh), lambda ids: written(texts_of(texts, ids)), verify, last, deeper, ROUNDS), out)


def _in_order(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt by ranges of the order, each followed by the first document of the next range (_sv_copy 1)."""
    spark, n = docs.sparkSession, width(docs.sparkSession)
    d = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_sv_i"), F.xxhash64("text").alias("_sv_h"))
    at = d.select("_sv_i", "_sv_h").repartitionByRange(n, "_sv_i", "_sv_h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("_sv_i", "_sv_h")).alias("lo"), F.max(F.struct("_sv_i", "_sv_h")).alias("hi"))
    edge = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in at.collect())  # one row per partition
    ids, hashes = (F.from_json(F.lit(json.dumps([hi[k] for _, hi in edge])), "array<bigint>") for k in (0, 1))

    def below(lo, step):
        i, h = F.try_element_at(ids, lo + step), F.try_element_at(hashes, lo + step)
        return F.when(F.coalesce((i < F.col("_sv_i")) | ((i == F.col("_sv_i")) & (h < F.col("_sv_h"))), F.lit(False)), lo + step).otherwise(lo)

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(edge)).bit_length()))))
    own = d.select("*", F.aggregate(steps, F.lit(0), below).alias("_sv_p"), F.lit(0).alias("_sv_copy"))
    heads = spark.createDataFrame([(*lo, (k - 1) % len(edge)) for k, (lo, _) in enumerate(edge)], "_sv_i long, _sv_h long, _sv_p int")
    copy = d.join(F.broadcast(heads), ["_sv_i", "_sv_h"]).select(*d.columns, "_sv_p", F.lit(1).alias("_sv_copy"))  # as many rows as partitions, more only where rows are equal
    return own.unionByName(copy).repartition(n, "_sv_p").sortWithinPartitions("_sv_p", "_sv_copy", "_sv_i", "_sv_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, fresh, n_chars, edited_sha256, sig, edited_sig, near_edited, near_next of docs(doc_id, text)."""

    def run(batches):
        last, seen = None, set()
        for batch in batches:
            for b in parts(batch):
                rows = []
                for i, t, p, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_sv_p", "_sv_copy"))):
                    s = word_shingles(t)
                    own = (i, t, p, copy, s, signature(s))
                    if last is not None and not last[3]:
                        x, sig = last[1], last[5]
                        e = edit(x, t)
                        es = signature(word_shingles(e))
                        w = lower_words(x.encode("utf-8", "surrogatepass"))
                        node = node_of(w) if w else None
                        fresh = node is not None and node not in seen and not seen.add(node)
                        rows.append((last[0], node, len(last[4]), fresh, len(x), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), sig.tobytes(), es.tobytes(), likeness(sig, es), likeness(sig, own[5])))
                    last = own
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], list(kinds))

    flat = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = flat.schema["doc_id"].dataType.simpleString()
    kinds = {"doc_id": pa.int32() if name == "int" else pa.int64(), "node": pa.int64(), "n_shingles": pa.int64(), "fresh": pa.bool_(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "sig": pa.binary(), "edited_sig": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return _in_order(flat).mapInArrow(run, f"doc_id {name}, node long, n_shingles long, fresh boolean, n_chars long, edited_sha256 string, sig binary, edited_sig binary, near_edited double, near_next double")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = near_classes(written(fingerprints(d)), d)
    return f.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), F.lower(F.hex("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
