"""Operator 3: benchmark decontamination by Wu-Manber search over words.

Null texts have no words and are clean; items without words are ignored;
repeated items count under each of their ids. The pattern tables of one pass
hold at most ``max_words`` benchmark words; a larger benchmark is searched in
blocks of items, one pass each, with the hits carried along. Rows are searched
one by one, so repeats agree. Input columns named ``_hit`` or ``_items``, or
beginning with ``_sv_``, are replaced.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import parts, table, without

WINDOW = 10
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class WuManber:
    """Shift tables over blocks of two words (one for one-word windows), suffix buckets, direct comparison."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        self.ids: dict[str, int] = {}
        by_len: dict[int, dict[tuple, set]] = {}
        for item, ws in items:
            if not ws:
                continue
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in ws]
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                by_len.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
        self.base = len(self.ids) + 1
        self.groups = []
        for m, pats in sorted(by_len.items()):
            b = min(2, m)
            shift: dict[int, int] = {}
            bucket: dict[int, list] = {}
            for p, own in pats.items():
                for q in range(b - 1, m):
                    k = p[q] + (p[q - 1] * self.base if b == 2 else 0)
                    shift[k] = min(shift.get(k, m), m - 1 - q)
                    if q == m - 1:
                        bucket.setdefault(k, []).append((list(p), own))
            self.groups.append((m, b, shift, bucket))

    def search(self, ws: list[str]) -> tuple[bytearray, set]:
        get = self.ids.get
        w = [get(x, 0) for x in ws]
        hit, items, base = bytearray(len(w)), set(), self.base
        for m, b, shift, bucket in self.groups:
            i, jump = m - 1, m - b + 1
            while i < len(w):
                k = w[i] + (w[i - 1] * base if b == 2 else 0)
                s = shift.get(k, jump) if w[i] else jump if b == 1 else m
                if s == 0:
                    part = w[i - m + 1 : i + 1]
                    for p, own in bucket[k]:
                        if p == part:
                            hit[i - m + 1 : i + 1] = b"\x01" * m
                            items |= own
                    s = 1
                i += s
        return hit, items


def _blocks(bench: DataFrame, max_words: int):
    """Lists of items of bounded size, streamed to the driver one partition at a time."""
    block, n = [], 0
    for r in bench.toLocalIterator():
        ws = words(r[1])
        if block and n + len(ws) > max_words:
            yield block
            block, n = [], 0
        block.append((r[0], ws))
        n += len(ws)
    yield block


def contamination(docs: DataFrame, bench: DataFrame, max_words: int = 500_000) -> DataFrame:
    """docs(doc_id, text, ...) plus ``_hit`` (a byte per word) and ``_items`` (ids of items found)."""
    spark = docs.sparkSession
    out, first = without(docs, "_hit", "_items"), True
    for block in _blocks(bench.select("item_id", "text"), max_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared, first=first):
            wm = WuManber(shared.value)
            for b in (x for y in batches for x in parts(y)):
                hits, found = [], []
                for j, t in enumerate(b.column("text").to_pylist()):
                    h, it = wm.search(words(t))
                    if not first:
                        h = bytes(x | y for x, y in zip(h, b.column("_hit")[j].as_py()))
                        it |= set(b.column("_items")[j].as_py())
                    hits.append(bytes(h))
                    found.append(sorted(it, key=str))
                keep = [c for c in b.schema.names if c not in ("_hit", "_items")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64()))], [*keep, "_hit", "_items"])

        fields = [f for f in out.schema.fields if f.name not in ("_hit", "_items")]
        out = out.mapInArrow(run, StructType([*fields, StructField("_hit", BinaryType()), StructField("_items", ArrayType(LongType()))]))
        first = False
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = (F.length("_hit") - F.length(F.translate(F.decode("_hit", "ISO-8859-1"), "\x01", ""))).cast("long")
    return c.select("doc_id", F.length("_hit").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", F.array_sort(F.col("_items").cast("array<string>"))), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
