"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import hashlib
import math
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; elsewhere an error, as executors share no local folder."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        got = tempfile.mkdtemp(prefix="svspark-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def written(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there. Then deletes the written tables ``done`` that only led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/svspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    release(*done)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written``; a collection on the driver lets Spark drop shuffle files that no plan needs."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less its columns named like a result (any case), which results replace, and those that begin with _sv_, which operators use inside."""
    own = {n.lower() for n in names}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in own and not c.lower().startswith("_sv_")))


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20):
    """Slices of an Arrow batch with at most ``most`` bytes of ``column``, or one row: what Python holds at once stays bounded."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def beside(docs: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """docs and the rows of each document in one stream: per key the rows in ``order`` (_sv_kind 0), then the documents (_sv_kind 1).

    Columns that only one side has are null on the other. Nothing is collected per document.
    """
    only_rows, only_docs = ([f for f in x.schema.fields if f.name not in key and f.name not in y.columns] for x, y in ((rows, docs), (docs, rows)))
    u = docs.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in only_rows), F.lit(1).alias("_sv_kind")).unionByName(
        rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in only_docs), F.lit(0).alias("_sv_kind")))
    return u.repartition(*key).sortWithinPartitions(*key, "_sv_kind", *order)


def documents_of(batches, key: list[str], columns: list[str], text: str):
    """From the stream of ``beside``: (slice of documents, [arrays of columns for each of them])."""
    held, held_key, pending = [np.zeros(0, np.int64)] * len(columns), None, [[] for _ in columns]
    for batch in batches:
        for b in parts(batch, text):
            kind = b.column("_sv_kind").to_numpy()
            at = np.flatnonzero(kind == 1)
            of, values = [], [b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
            keys = list(zip(*(b.column(c).take(pa.array(at)).to_pylist() for c in key)))
            last = 0
            for i, k in zip(at.tolist(), keys):
                if i > last or pending[0]:
                    held, held_key = [np.concatenate([*p, v[last:i]]) for p, v in zip(pending, values)], k
                    pending = [[] for _ in columns]
                elif k != held_key:
                    held, held_key = [v[:0] for v in values], k
                of.append(held)
                last = i + 1
            if last < b.num_rows:
                for p, v in zip(pending, values):
                    p.append(v[last:].copy())
            if len(at):
                yield b.take(pa.array(at)), of


_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in ((0, _P), (1, _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SYMBOL = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1234567))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64 over a random table of symbols."""
    up, _ = _powers(len(codes) + 1)
    h = np.zeros(len(codes) + 1, np.uint64)
    if codes.dtype == np.uint8:
        c = _SYMBOL[codes]
    else:
        c = mix(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1234567))
    np.cumsum(c * up[: len(codes)], out=h[1:])
    return h


def substring_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for arrays of positions; equal substrings have equal values anywhere."""
    _, down = _powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def word_shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words between ASCII spaces.

    A text of fewer words than ``size``, but not none, is one shingle.
    """
    low = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    if not len(low):
        return np.zeros(0, np.uint64)
    gap = np.diff(np.concatenate(([1], _IS_SPACE[low].astype(np.int8), [1])))
    start, end = np.flatnonzero(gap == -1), np.flatnonzero(gap == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    w = substring_hash(prefix_hash(low), start, end)
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Minimum labels over neighbours with pointer jumping; every round is written
    and the one before deleted, and no label ever reaches the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(e.union(e.select("v", "u")).distinct())
    new = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.col("u").alias("old"), F.least("u", "m").alias("c")))
    while not new.where("c <> old").isEmpty():
        lab = new.select("u", "c")
        near = both.join(lab.select(F.col("u").alias("v"), F.col("c").alias("nc")), "v").groupBy("u").agg(F.min("nc").alias("nc"))
        step = lab.join(near, "u", "left").select("u", "c", F.least("c", F.coalesce("nc", "c")).alias("n"))
        jump = lab.select(F.col("u").alias("n"), F.col("c").alias("j"))
        new = written(step.join(jump, "n", "left").select("u", F.col("c").alias("old"), F.least("n", F.coalesce("j", "n")).alias("c")), new)
    out = new.select(F.col("u").alias("node"), F.col("c").alias("component"))
    out._written_path = new._written_path
    release(both)
    return out


BITS = 26


def slots_of(ids: DataFrame, column: str) -> np.ndarray:
    """Bit field of fixed size (2**BITS bits) that holds the hash of every id of ``column``; a filter ahead of an exact join."""
    slot = F.pmod(F.col(column), F.lit(1 << BITS)) + 1
    got = ids.select(slot.alias("s")).groupBy(F.call_function("bitmap_bucket_number", "s").alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "s")).alias("m"))
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in got.toLocalIterator():
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        out[(r["b"] - 1) * len(m) : r["b"] * len(m)] = m
    return out


def in_slots(field: np.ndarray, ids: np.ndarray) -> np.ndarray:
    s = ids % (1 << BITS)
    return (field[s >> 3] >> (s & 7) & 1).astype(bool)


def blocks(key: np.ndarray, size: np.ndarray, place: np.ndarray, probe: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Index entries of one chunk as bytes, a row for each bucket of keys: entry (46 bits of the key, class of place up to 63, of size up to 1023, probe flag), id; and apart from them the further ids of equal entries of the chunk."""
    entry = (key << np.uint64(17) | place.astype(np.uint64) << np.uint64(11) | size.astype(np.uint64) << np.uint64(1) | probe.astype(np.uint64)) & ~np.uint64(1 << 63)
    at = np.argsort(entry)
    entry, ids = entry[at], ids[at]
    # By range of the key: within a bucket the first bytes of sorted entries are nearly all alike.
    bucket = ((entry >> np.uint64(43)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)
    edge = np.concatenate(([True], entry[1:] != entry[:-1]))[: len(entry)]
    head = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    twin = ~edge & (ids != ids[head])
    ends = [np.searchsorted(bucket[m], np.arange(1, buckets)) for m in (edge, twin)]
    cols = [[_planes(x) for x in np.split(c, e)] for c, e in ((entry[edge], ends[0]), (ids[edge], ends[0]), (entry[twin], ends[1]), (ids[twin], ends[1]))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "entry", "ids", "te", "tb"])


def _planes(x: np.ndarray) -> bytes:
    """Eight-byte numbers as bytes by their place: the first ones of sorted numbers hardly change, so they pack well."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


BLOCKS = "bucket long, entry binary, ids binary, te binary, tb binary"


def stars(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), written, from rows of ``blocks``: each member b of a key beside the key's smallest indexed member a, in runs of neighbouring classes of place and size.

    Two members of a key in neighbouring classes, of which one is indexed, have
    the same a, or one of them is it. Keys without a second member or an indexed one are gone.
    """
    def meet(held):
        entry, ids, te, tb = (np.concatenate([_from_planes(x, kind) for x in c]) for c, kind in zip(held, (np.uint64, np.int64, np.uint64, np.int64)))
        entry, ids = np.concatenate((entry, te)), np.concatenate((ids, tb))
        run = (entry >> np.uint64(17)).astype(np.int64)
        place, size, probe = (entry >> np.uint64(k) & np.uint64(m) for k, m in ((11, 63), (1, 1023), (0, 1)))
        place, size, probe = (x.astype(np.int64) for x in (place, size, probe))
        for k in (0, 1, 0):
            at = np.argsort(run << 10 | (place, size)[k])
            run, place, size, probe, ids = (x[at] for x in (run, place, size, probe, ids))
            c = (place, size)[k]
            run = np.cumsum(np.concatenate(([True], (run[1:] != run[:-1]) | (c[1:] - c[:-1] > 1)))) if len(run) else run
            alone = np.bincount(run)[run] == 1
            run, place, size, probe, ids = (x[~alone] for x in (run, place, size, probe, ids))
        if len(run):
            at = np.argsort(run)
            run, probe, ids = (x[at] for x in (run, probe, ids))
            edge = np.concatenate(([True], run[1:] != run[:-1]))
            none = np.iinfo(np.int64).max
            a = np.minimum.reduceat(np.where(probe == 0, ids, none), np.flatnonzero(edge))[np.cumsum(edge) - 1]
            keep = (a != none) & (ids != a)
            a, b = a[keep], ids[keep]
            at = np.lexsort((b, a))
            a, b = a[at], b[at]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def run(batches):
        last, held = None, [[], [], [], []]
        for b in batches:
            for bucket, *cols in zip(*(b.column(c).to_pylist() for c in ("bucket", "entry", "ids", "te", "tb"))):
                if bucket != last and held[0]:
                    yield from meet(held)
                    held = [[], [], [], []]
                last = bucket
                for h, c in zip(held, cols):
                    h.append(c)
        if held[0]:
            yield from meet(held)

    out = written(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct())
    release()  # the shuffle of the index, which outlasts the collection in ``written``
    return out


def buckets_of(spark: SparkSession) -> int:
    return 2 * width(spark)


MEET, SLOT = 9, 18


def traces(key: np.ndarray, probe: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """37 bits and the probe flag of the keys of one chunk as differences, a row for each bucket of ``blocks``; once, or twice where two ids have them."""
    h = (key & np.uint64((1 << 46) - 1)) >> np.uint64(MEET) << np.uint64(1) | probe.astype(np.uint64)
    at = np.argsort(h)
    h, ids = h[at], ids[at]
    edge = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    head = np.flatnonzero(edge)
    ends = np.append(head[1:], len(h))
    two = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head) if len(head) else ends > 0
    h = np.repeat(h[head], 1 + two)
    bucket = ((h >> np.uint64(46 - MEET + 1 - 20)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)
    cols = [_planes(np.diff(x, prepend=np.uint64(0))) for x in np.split(h, np.searchsorted(bucket, np.arange(1, buckets)))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(cols, pa.binary())], ["bucket", "h"])


def met(rows: DataFrame, buckets: int) -> np.ndarray:
    """Bit field over the first 28 of a key's 46 bits, from rows of ``traces``: those that an indexed member and another one may share. Keys outside it meet nobody, so they need not travel with their ids."""

    def field(bucket, held):
        h = np.sort(np.concatenate([np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in held]))
        k = h >> np.uint64(1)
        edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
        keep = (np.diff(np.append(edge, len(k))) > 1) & (h[edge] & np.uint64(1) == 0) if len(edge) else edge > 0
        lo, hi = (-(-(b << 20) // buckets) << 46 - SLOT - 20 for b in (bucket, bucket + 1))
        bits = np.zeros(hi - lo, bool)
        bits[(k[edge][keep] >> np.uint64(SLOT - MEET)).astype(np.int64) - lo] = True
        return pa.RecordBatch.from_arrays([pa.array([lo >> 3]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["lo", "bits"])

    def run(batches):
        last, held = None, []
        for b in batches:
            for bucket, h in zip(b.column("bucket").to_pylist(), b.column("h").to_pylist()):
                if bucket != last and held:
                    yield field(last, held)
                    held = []
                last = bucket
                held.append(h)
        if held:
            yield field(last, held)

    out = np.zeros(1 << 46 - SLOT - 3, np.uint8)
    fields = written(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "lo long, bits binary"))
    for r in fields.toLocalIterator():
        out[r["lo"] : r["lo"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    release(fields)
    return out


def may_meet(field: np.ndarray, key: np.ndarray) -> np.ndarray:
    s = (key & np.uint64((1 << 46) - 1)) >> np.uint64(SLOT)
    return (field[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def node_of(words: list[bytes]) -> int:
    """64-bit hash of a word sequence; equal sequences are one node of the joins on shingles."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


DIMS = 128


def set_counts(s: np.ndarray) -> bytes:
    """DIMS counts, up to 255, of the tokens of a set by their hash; the sum of their differences is at most the size of the symmetric difference of two sets."""
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=DIMS), 255).astype(np.uint8).tobytes()


def sets_apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most tokens in the symmetric difference of two sets of n and m that link; -1 where their sizes forbid it."""
    return np.where(100 * np.minimum(n, m) >= 80 * np.maximum(n, m), (n + m) // 9, -1)


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text, n, pc) of the nodes named in ids(node), from texts(text); n: size of the set, pc: ``set_counts``."""
    field = texts.sparkSession.sparkContext.broadcast(slots_of(ids, "node"))

    def run(batches):
        seen = set()
        for batch in batches:
            for b in parts(batch):
                text = [t for t in b.column("text").to_pylist() if t]
                got = np.array([node_of(lower_words(t.encode("utf-8", "surrogatepass"))) for t in text], np.int64)
                pick = [i for i in np.flatnonzero(in_slots(field.value, got)).tolist() if (j := int(got[i])) not in seen and not seen.add(j)]
                sets = [word_shingles(text[i]) for i in pick]
                yield pa.RecordBatch.from_arrays([pa.array(got[pick]), pa.array([text[i] for i in pick], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_counts(s) for s in sets], pa.binary())], ["node", "text", "n", "pc"])

    return texts.select("text").mapInArrow(run, "node long, text string, n long, pc binary").join(ids, "node", "left_semi").dropDuplicates(["node"])


def _apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of differences of the counts x[i] and y[j], a bounded number at a time."""
    out, step = np.empty(len(i), np.int64), max(1, (1 << 22) // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.abs(x[i[lo : lo + step]].astype(np.int16) - y[j[lo : lo + step]]).sum(axis=1)
    return out


def _counts(b: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.uint8).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), np.uint8)


def sifted(pairs: DataFrame, own: DataFrame, most) -> DataFrame:
    """The pairs (a, b) whose counts pc, of own(node, n, pc), differ by most(n, n) at most, written. Only counts travel."""

    def sift(batches):
        for b in batches:
            if b.num_rows:
                every = np.arange(b.num_rows)
                keep = _apart(_counts(b, "pa"), _counts(b, "pb"), every, every) <= most(b.column("na").to_numpy(), b.column("nb").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("pc").alias(f"p{x}"))
    return written(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "pa", "na", "pb", "nb").mapInArrow(sift, "a long, b long"))


BLOCK = 1024


def paired(live: DataFrame, own: DataFrame, most, nearest: bool = False) -> DataFrame:
    """The distinct pairs (a, b) of members of a group live(a, b, c, n), in different components c, whose counts pc, of own(node, n, pc), differ by most(n, n) at most, written.

    nearest: of these, for each member one least apart (and some more). Members travel once to their group; one
    of more than BLOCK goes to a task for each two of its slices. Pairs are looked at in place and only those
    found are rows of a table: the steps are the square of a group's size, a sum over counts each.
    """

    def pairs_of(rows, cs):
        a, lo, hi, t, c, n = (rows.column(x).to_numpy() for x in ("a", "lo", "hi", "t", "c", "n"))
        edge = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1, [len(a)]))
        held, size = [], 0
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if y - x > 1:
                i, j = _triangle(y - x) if y - x <= 64 else np.triu_indices(y - x, 1)
                held.append((i + x, j + x))
                size += len(i)
            if held and (size >= 1 << 18 or y == len(a)):
                i, j = map(np.concatenate, zip(*held))
                held, size = [], 0
                keep = (c[i] != c[j]) & ((lo[i] == hi[i]) | (t[i] != t[j]))
                i, j = i[keep], j[keep]
                limit = most(n[i], n[j])
                i, j, limit = i[limit >= 0], j[limit >= 0], limit[limit >= 0]
                far = _apart(cs, cs, i, j)
                keep = np.flatnonzero(far <= limit)
                keep = keep[np.argsort(far[keep], kind="stable")]
                yield i[keep], j[keep]

    def run(batches):
        left = None
        for batch, last in _with_last(batches):
            rows = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            left = None
            if not last:  # the last group may go on in the next batch
                key = [rows.column(x).to_numpy() for x in ("a", "lo", "hi")]
                other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
                cut = int(other[-1]) + 1 if len(other) else 0
                rows, left = rows.slice(0, cut), rows.slice(cut)
            if rows.num_rows:
                b = rows.column("b").to_numpy()
                for i, j in pairs_of(rows, _counts(rows, "pc")):
                    if nearest:
                        _, first = np.unique(np.stack((i, j), axis=1).ravel(), return_index=True)
                        i, j = (x[np.unique(first // 2)] for x in (i, j))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b[i], b[j])), pa.array(np.maximum(b[i], b[j]))], ["a", "b"])

    s = F.ceil(F.col("n") / BLOCK)
    cut = live.select("a", "b", "c", F.pmod(F.xxhash64("b"), s).cast("int").alias("t"), s.cast("int").alias("s"))
    cut = cut.select("a", "b", "c", "t", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("u"))
    cut = cut.select("a", "b", "c", "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"))
    rows = cut.join(own.select(F.col("node").alias("b"), F.col("n").cast("int").alias("n"), "pc"), "b")
    return written(rows.repartition("a", "lo", "hi").sortWithinPartitions("a", "lo", "hi").mapInArrow(run, "a long, b long").distinct())


def _with_last(batches):
    """Each batch with rows, and whether it is the last."""
    held = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield held, False
            held = b
    if held is not None:
        yield held, True


@cache
def _triangle(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


TOGETHER = 500


def _streamed(pairs: DataFrame, heads: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) dealt, written, and a stream (a, b, head, text): the row of a in heads(a, head) (b null), then the texts of its partners.

    The row of a is sent once for every TOGETHER partners: neither a popular
    node nor its partners meet in one task.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("s"))
    dealt = written(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("s")).alias("s")))
    null = lambda kind: F.lit(None).cast(kind)
    one = dealt.select("a", "s").distinct().join(heads, "a", "left").select("a", "s", null("long").alias("b"), F.lit(0).alias("m"), "head", null("string").alias("text"))
    rest = dealt.join(own.withColumnRenamed("node", "b"), "b").select("a", "s", "b", F.lit(1).alias("m"), null(heads.schema["head"].dataType).alias("head"), "text")
    return dealt, one.unionByName(rest).repartition("a", "s").sortWithinPartitions("a", "s", "m").select("a", "b", "head", "text")


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose shingle sets have 100 * intersection >= 80 * union, written; own: (node, text) of all of them."""

    def check(batches):
        first = None
        for batch in batches:
            for t in parts(batch):
                a, b = [], []
                for x, y, head, text in zip(*(t.column(c).to_pylist() for c in ("a", "b", "head", "text"))):
                    if y is None:
                        first = word_shingles(head)
                        continue
                    s = word_shingles(text)
                    both = len(np.intersect1d(first, s, assume_unique=True))
                    if 100 * both >= 80 * (len(first) + len(s) - both):
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt, stream = _streamed(pairs.distinct(), own.select(F.col("node").alias("a"), F.col("text").alias("head")), own)
    return written(stream.mapInArrow(check, "a long, b long"), dealt)


SOME = 31


def _centers(live: DataFrame, own: DataFrame) -> DataFrame:
    """(a, head): the tokens in more than half of some SOME members of each group, as bytes."""
    few = live.where(F.pmod(F.xxhash64("b"), F.col("n")) < SOME).join(own.withColumnRenamed("node", "b"), "b")

    def middle(x, held):
        t, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([t[2 * n > len(held)].tobytes()], pa.binary())], ["a", "head"])

    def run(batches):
        last, held = None, []
        for batch in batches:
            for t in parts(batch):
                for x, text in zip(t.column("a").to_pylist(), t.column("text").to_pylist()):
                    if x != last and held:
                        yield middle(last, held)
                        held = []
                    last = x
                    held.append(word_shingles(text))
        if held:
            yield middle(last, held)

    return few.select("a", "text").repartition("a").sortWithinPartitions("a").mapInArrow(run, "a long, head binary")


def differences(live: DataFrame, own: DataFrame, order=None) -> tuple[DataFrame, DataFrame]:
    """``stars`` of finer keys for the groups live(a, b, n) of n members b of a, and sure links (a, b) between members, both written.

    Any set p may stand in the center of a group; here it is what most of some
    members hold. If D(x) is the symmetric difference of x and p, that of x and
    y is the one of D(x) and D(y), so a link, which is 9 |x ^ y| <= |x| + |y|, asks
    for an overlap of D(x) and D(y) of -(r(x) + r(y)) / 18 with
    r(x) = |x| - 9 |D(x)|. Let m be the greatest r in the group, of member z. All
    y with r(y) >= -m link with z surely. In any other pair some y has less,
    and no more than m, so the overlap is more than (m - r(x)) / 18 or at least -(m + r(x)) / 18, and x needs only about half of D(x) as
    keys (prefix filter); such a y needs more of D(y) against an x near p.
    Tokens outside p come first, in the order of ``order``, so what the members
    have in common is seldom a key. Of tokens outside p, one more than a partner can miss is enough.
    """
    buckets = buckets_of(own.sparkSession)

    def apart(batches):
        center = np.zeros(0, np.uint64)
        for batch in batches:
            for t in parts(batch):
                out = []
                for x, y, head, text in zip(*(t.column(c).to_pylist() for c in ("a", "b", "head", "text"))):
                    if y is None:
                        center = np.frombuffer(head or b"", np.uint64)
                        continue
                    s = word_shingles(text)
                    added, gone = np.setdiff1d(s, center, assume_unique=True), len(s) - (80 * len(s) + 99) // 100
                    if order is not None:
                        added = added[np.argsort(order(added), kind="stable")]
                    lost = np.setdiff1d(center, s, assume_unique=True)
                    out.append((x, y, len(s), len(added) + len(lost), (added[: gone + 1] if len(added) > gone else np.concatenate((added, lost))).tobytes()))
                cols = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["a", "b", "size", "d", "t"])

    def keys(batches):
        held, size = [], 0
        for batch in batches:
            for t in parts(batch, "t"):
                for x, y, n, d, w, m in zip(*(t.column(c).to_pylist() for c in ("a", "b", "size", "d", "t", "m"))):
                    w, r = np.frombuffer(w, np.uint64), n - 9 * d
                    own_n = max(0, min(len(w), d + 1 - max(1, -((r + min(m, -m - 1)) // 18))))
                    all_n = own_n if r >= -m else max(own_n, min(len(w), d + 1 - max(1, -((r + m) // 18))))
                    if all_n:
                        salt = mix(np.array([x], np.int64).view(np.uint64))
                        held.append((mix(w[:all_n] * np.uint64(0x9E3779B97F4A7C15) + salt), np.full(all_n, size_class(n)), np.zeros(all_n, np.int64), np.arange(all_n) >= own_n, np.full(all_n, y)))
                        size += all_n
                    if size >= 1 << 20:
                        yield blocks(*map(np.concatenate, zip(*held)), buckets)
                        held, size = [], 0
        if size:
            yield blocks(*map(np.concatenate, zip(*held)), buckets)

    heads = written(_centers(live, own))
    dealt, stream = _streamed(live, heads, own)
    d = written(stream.mapInArrow(apart, "a long, b long, size long, d long, t binary"), dealt, heads)
    r = F.col("size") - 9 * F.col("d")
    best = written(d.groupBy("a").agg(F.max(F.struct(r.alias("m"), F.col("b").alias("z"))).alias("o")).select("a", "o.m", "o.z"))
    met = d.join(best, "a")
    sure = written(met.where((r >= -F.col("m")) & (F.col("b") != F.col("z"))).select(F.col("z").alias("a"), "b"))
    out = stars(met.mapInArrow(keys, BLOCKS))
    release(d, best)
    return out, sure


def size_class(n: int) -> int:
    """A ratio of 1.25 (and rounding) wide: sets that link lie in the same or neighbouring classes."""
    return min(1 + int(math.log(n) / math.log(1.2501)), 1023)


def through(near: DataFrame, use) -> DataFrame:
    """use(near), with ``near`` a written table that goes then."""
    out = use(near)
    release(near)
    return out


SMALL = 64


def linked(pairs: DataFrame, fetch, verify, last, deeper=None, rounds: int = 0) -> DataFrame:
    """(node, component) of the graph of verified links between members of a common key, written.

    pairs: ``stars``. fetch: ids (node) to a table of what the others read,
    written. verify: pairs (a, b) and that table to those that link (a, b),
    written. last: groups live(a, b, c, n) and that table to all links that
    join components within a group, written. deeper: large such groups and that
    table to pairs (a, b) of the finer groups that remain to be seen, written,
    and further links.
    Each member of a key meets its owner a. Groups of an owner whose members
    then lie in several components go on: large ones ``rounds`` times at most
    as finer groups, and all others at once to ``last``. No link between two
    components is lost.
    """
    own = fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = [verify(pairs, own)]
    for k in range(rounds + 1):
        comp = components(_all(links), "a", "b")
        named = pairs.join(comp.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("c"))
        of = named.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        live = written(named.join(of.select("a", "n"), "a"), pairs)
        n, large = live.agg(F.count("*"), F.count_if(F.col("n") > SMALL)).first()
        if not n:
            release(live, own, *links)
            return comp
        release(comp)
        if k == rounds or not large:
            break
        pairs, more = deeper(live.where(F.col("n") > SMALL), own)
        links += [last(live.where(F.col("n") <= SMALL), own), *more]
        release(live)
    links.append(last(live, own))
    out = components(_all(links), "a", "b")
    release(live, own, *links)
    return out


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def smallest_id(rows: DataFrame, comp: DataFrame, out: str) -> DataFrame:
    """rows(doc_id, node, ...) less node, plus _sv_c, the node's component (null for rows without node), and ``out``, the smallest doc_id of it, the own one for rows without."""
    named = rows.join(comp, "node", "left").withColumn("_sv_c", F.coalesce("component", "node")).drop("component", "node")
    least = named.where("_sv_c is not null").groupBy("_sv_c").agg(F.min("doc_id").alias(out), F.max("doc_id").alias("_sv_z")).where(F.col(out) != F.col("_sv_z")).select("_sv_c", out)
    return named.join(written(least), "_sv_c", "left").withColumn(out, F.coalesce(out, "doc_id"))


_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_words(raw: bytes) -> list[bytes]:
    """Words between ASCII spaces of UTF-8 bytes, A-Z lower-cased."""
    return raw.translate(_FOLD).split()
