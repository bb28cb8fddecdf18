"""Operator 6: token ids in sorted-string-table shards.

A shard holds documents in ascending doc_id order. Layout: data blocks, index
block, Bloom filter, fixed footer. A data block is a run of entries: shared
prefix length and rest length of the 8-byte big-endian key (sign bit flipped),
number of ids (uint32), then the ids as little-endian integers of the width
the header of the footer names. The sparse index has each block's first key,
offset and size; a lookup asks the Bloom filter, bisects the index and scans
one block. Files are written under a name that carries the attempt and then
moved, so a task that is run again replaces its own output.

A tokenizer whose pieces never cross ASCII white space encodes a text as its
parts between such white space, one after another; ids of parts are remembered
in a table of bounded size, and only new ones are encoded. Whether a tokenizer
is of that kind is read from its file; another encodes whole texts.

Null texts are empty and hold the end id alone. Repeated doc_ids stay, ordered
by text hash. Rows without doc_id sort first under the smallest key. Other
columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, shared_dir, table, width, written

MAGIC = b"SSTOKEN1"
FOOTER = "<QQQQQII8s"  # index offset, size, bloom offset, size, documents, bloom hashes, id width, magic
BLOCK, SHARD, KNOWN = 64 << 10, 64 << 20, 500_000
NULL_ID = -(1 << 63)


def _key(i: int) -> bytes:
    return struct.pack(">Q", i + (1 << 63))


def _bloom_at(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + j * b) % bits for j in range(hashes)]


class Writer:
    def __init__(self, out, id_width: int = 4):
        self.out, self.kind, self.width = out, {2: "<u2", 4: "<u4"}[id_width], id_width
        self.block, self.first, self.last, self.at = bytearray(), None, b"", 0
        self.index, self.keys = [], []

    def add(self, doc_id: int, ids) -> None:
        """ids: numbers, or their bytes at the width of the file."""
        key = _key(doc_id)
        same = 0
        if self.block:
            while same < 8 and key[same] == self.last[same]:
                same += 1
        else:
            self.first = key
        raw = ids if isinstance(ids, bytes) else np.asarray(ids, np.int64).astype(self.kind).tobytes()
        self.block += bytes((same, 8 - same)) + key[same:] + struct.pack("<I", len(raw) // self.width) + raw
        self.last = key
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self.flush()

    @property
    def size(self) -> int:
        return self.at + len(self.block)

    def flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.first, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = b"".join(k + struct.pack("<QQ", o, n) for k, o, n in self.index)
        bits = max(64, (10 * len(self.keys) + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for b in _bloom_at(k, bits, 7):
                bloom[b >> 3] |= 1 << (b & 7)
        self.out.write(index + bytes(bloom) + struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(bloom), len(self.keys), 7, self.width, MAGIC))
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n, bat, bn, self.count, self.hashes, w, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.kind, self.width = {2: "<u2", 4: "<u4"}[w], w
        raw = self.file.read_at(n, at)
        self.index = [(raw[i : i + 8], *struct.unpack_from("<QQ", raw, i + 8)) for i in range(0, n, 24)]
        self.bloom = self.file.read_at(bn, bat)

    def _block(self, k: int):
        _, at, n = self.index[k]
        raw, p, key = self.file.read_at(n, at), 0, b""
        while p < n:
            same, rest = raw[p], raw[p + 1]
            key = key[:same] + raw[p + 2 : p + 2 + rest]
            p += 2 + rest
            (m,) = struct.unpack_from("<I", raw, p)
            yield key, np.frombuffer(raw, self.kind, m, p + 4)
            p += 4 + m * self.width

    def __iter__(self):
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield struct.unpack(">Q", key)[0] - (1 << 63), ids

    def get(self, doc_id: int):
        """Ids of the first document of this id, or None."""
        key = _key(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_at(key, 8 * len(self.bloom), self.hashes)):
            return None
        k = max(0, bisect.bisect_left([x[0] for x in self.index], key) - 1)
        for j in range(k, min(k + 2, len(self.index))):
            for got, ids in self._block(j):
                if got == key:
                    return ids
        return None


class Encoder:
    """Texts to the bytes of their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.apart = self._splits(json.load(f))

    @staticmethod
    def _splits(spec: dict) -> bool:
        """Whether white space parts pieces: all of it becomes a blank, which a split removes, and no added token holds any."""
        norm = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        blank = any(n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm)
        only = all(n["type"] in ("NFC", "Lowercase", "Replace") for n in norm) and all(x.get("type") in ("Split", "ByteLevel") and not x.get("add_prefix_space") for x in pre)
        removed = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and r"[^\s" in pre[0]["pattern"].get("Regex", "") and " " not in pre[0]["pattern"].get("Regex", " ")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in spec.get("added_tokens", []))
        return bool(blank and only and removed and plain and not spec.get("post_processor"))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self._whole(texts)
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        own = set().union(*words)
        new = list(own.difference(self.known))
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, list(own)
        for lo in range(0, len(new), 4096):
            self.known.update(zip(new[lo : lo + 4096], self._whole([w.decode("utf-8", "surrogatepass") for w in new[lo : lo + 4096]])))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; its tasks share what it remembers."""
    held = sys.modules.setdefault("_svspark_encoders", types.ModuleType("_svspark_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes docs(doc_id, text) and writes shards; one row per shard: pid, part, uri, n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = _uri(folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; the cores belong to the other tasks
        enc = encoder(tokenizer_path)
        id_width = int(enc.kind[2])
        end = np.array([end_id], enc.kind).tobytes()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        pid, part, w, docs_n, toks_n = ctx.partitionId(), 0, None, 0, 0

        def finish():
            w.close()
            fs.move(tmp, f"{base}/{pid:08d}-{part:06d}.sst")
            return pa.RecordBatch.from_pydict({"pid": [pid], "part": [part], "uri": [f"{folder}/{pid:08d}-{part:06d}.sst"], "n_docs": [docs_n], "n_tokens": [toks_n]},
                                              schema=pa.schema([("pid", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for b in parts(batch):
                for i, ids in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()])):
                    if w is None:
                        tmp = f"{base}/_{pid:08d}-{part:06d}-{ctx.taskAttemptId()}"
                        w, docs_n, toks_n = Writer(fs.open_output_stream(tmp), id_width), 0, 0
                    w.add(NULL_ID if i is None else i, ids + end)
                    docs_n, toks_n = docs_n + 1, toks_n + len(ids) // id_width + 1
                    if w.size >= SHARD:
                        yield finish()
                        w, part = None, part + 1
        if w is not None:
            yield finish()

    flat = docs.select("doc_id", "text", F.xxhash64("text").alias("_sv_h"))
    flat = flat.repartitionByRange(width(spark), "doc_id", "_sv_h").sortWithinPartitions("doc_id", "_sv_h").select("doc_id", "text")
    return written(flat.mapInArrow(run, "pid int, part int, uri string, n_docs long, n_tokens long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    w = Window.orderBy("pid", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    placed = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).select("uri", "base")

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("base").to_pylist()):
                rows = []
                for i, ids in Reader(uri):
                    rows.append((None if i == NULL_ID else i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(width(shards.sparkSession), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
