"""Operator 7: removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a LENGTH-byte string over it also starts earlier (smaller
doc_id, or the same document and an earlier byte). Null texts are empty.

The suffixes to sort fall into buckets by content: each LENGTH-byte string
belongs to the smallest GRAM-byte hash inside it, so equal strings always share
a bucket, and a bucket that occurs once is done. Equal surroundings of a bucket
collapse inside a task before they cross the network, and again where they
meet. A bucket of more than MANY occurrences is parted by the bytes right after
or before its gram, half of those that a string must still have, until no
bucket is that large or its strings are whole; so no task holds a bucket of
unbounded size. Buckets are sorted block by block, of at most BLOCK bytes of
surroundings unless one bucket is larger: first by V bytes, ties by ranks
precomputed at the positions of a difference cover modulo V, then by the last V
bytes. Equal neighbours in that order are repeats.

Null doc_ids come first. Rows sharing a doc_id are told apart and ordered by
their text's hash; rows equal in both are one document, judged alike. Texts
equal to one of a smaller doc_id go whole, if they have LENGTH bytes. Input
columns named like a result, or beginning with ``_sv_``, are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import _from_planes, _planes, beside, buckets_of, documents_of, mix, parts, release, table, without, written

# V is four words; a string without its last V bytes is two times V and part of a word more.
LENGTH, GRAM, V, BLOCK, CHUNK, MANY = 100, 16, 32, 1 << 20, 1 << 19, 20_000


def difference_cover(v: int) -> list[int]:
    """Residues whose differences reach every residue modulo v, chosen greedily."""
    d, have = [0, 1], {0, 1, v - 1}
    while len(have) < v:
        best = max((x for x in range(v) if x not in d), key=lambda x: (len(have | {(x - y) % v for y in d} | {(y - x) % v for y in d}), -x))
        have |= {(best - y) % v for y in d} | {(y - best) % v for y in d}
        d.append(best)
    return sorted(d)


COVER = difference_cover(V)
SHIFT = np.array([[next(k for k in range(V) if (i + k) % V in COVER and (j + k) % V in COVER) for j in range(V)] for i in range(V)])


_IN_COVER = np.isin(np.arange(V), COVER)
_OWN = SHIFT[np.arange(V), np.arange(V)]


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of numbers, equal ones alike."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1]))) if len(key) else 0
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dense(a << np.uint64(32) | b)


def repeats(t: np.ndarray, starts: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``starts`` at depth LENGTH, and the class of equal strings of each start.

    Starts that tie in their first V bytes are ordered by the ranks of the cover
    sample. Those of one residue modulo V share the shift at which they meet the
    sample; residues are then merged by the shifts of each pair. Where equal
    strings are known to have equal residues (aligned), classes need no merge,
    and ties of different residues keep the order of those.
    """
    t = np.concatenate((t, np.zeros(LENGTH + 3 * V, np.uint8)))
    n = len(t) - LENGTH - V
    # Big-endian words compare as their bytes do; doubled twice they give the ranks of V bytes.
    word = _dense(np.lib.stride_tricks.as_strided(t, (len(t) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64))
    half = _pair(word[:-8], word[8:])
    whole = _pair(half[:-16], half[16:])
    sample = np.flatnonzero(_IN_COVER[np.arange(n) % V])
    rank = np.zeros(n, np.uint64)
    rank[sample] = _pair(_pair(whole[sample], whole[sample + V]), word[sample + LENGTH - V - 8])
    head, tail = whole[starts], whole[starts + LENGTH - V]
    res = starts % V
    if not len(starts):
        return starts, starts
    own = rank[starts + _OWN[res]]
    first = _pair(head, res.astype(np.uint64))
    key = _pair(_pair(first, own), tail)
    order = np.argsort(key, kind="stable")
    if aligned:
        return order, key.astype(np.int64)
    rank, tail = rank.astype(np.int64), tail.astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(head[order][1:] != head[order][:-1]) + 1, [len(order)]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = order[lo:hi]
        if hi - lo > 1 and (res[part] != res[part[0]]).any():
            order[lo:hi] = _merge([part[res[part] == r] for r in np.unique(res[part])], starts, rank, tail)
    a, b = order[:-1], order[1:]
    k = SHIFT[res[a], res[b]]
    same = (head[a] == head[b]) & (rank[starts[a] + k] == rank[starts[b] + k]) & (tail[a] == tail[b])
    cls = np.empty(len(starts), np.int64)
    cls[order] = np.cumsum(np.concatenate(([False], ~same)))
    return order, cls


def _merge(runs: list[np.ndarray], starts: np.ndarray, rank: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Sorted runs, one or more residues each, to one: each of the right run bisects the left by pairwise shifts."""
    while len(runs) > 1:
        out = []
        for i in range(0, len(runs) - 1, 2):
            left, right = runs[i], runs[i + 1]
            lo, hi = np.zeros(len(right), np.int64), np.full(len(right), len(left))
            while (lo < hi).any():
                mid = (lo + hi) // 2
                at = left[np.minimum(mid, len(left) - 1)]
                k = SHIFT[starts[at] % V, starts[right] % V]
                x, y = rank[starts[at] + k], rank[starts[right] + k]
                less = (x < y) | ((x == y) & (tail[at] <= tail[right]))
                go = lo < hi
                lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
            both = np.empty(len(left) + len(right), np.int64)
            to = lo + np.arange(len(right))
            rest = np.ones(len(both), bool)
            rest[to] = False
            both[to], both[rest] = right, left
            out.append(both)
        runs = out + runs[len(runs) - len(runs) % 2 :]
    return runs[0]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys, anchor positions, first and last LENGTH-byte string (start) of each anchor of bytes."""
    m, w = len(raw) - GRAM + 1, LENGTH - GRAM + 1
    if m < w:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    word = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel().astype(np.uint64)
    v = mix(mix(word[:m]) + word[8 : 8 + m])
    low = np.uint64(32)
    least, span = v >> low << low | np.arange(m, dtype=np.uint64), 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: m - w + 1], least[w - span : w - span + m - w + 1])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return v[at], at, first, np.concatenate((first[1:], [len(least)])) - 1


def _first(*cols: np.ndarray) -> np.ndarray:
    """Where sorted columns change: the first of each run of equal rows."""
    out = np.zeros(len(cols[0]), bool)
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def _anchored(docs: DataFrame) -> DataFrame:
    """(doc_id, _sv_h, k, at) of the anchors whose key occurs more than once, from docs(doc_id, _sv_h, raw); at packs the first string's start, the anchor's place in it and the further strings.

    Anchors cross the network as bytes, in blocks. Of equal texts (told by
    hash) only the smallest doc_id is compared.
    """
    buckets = buckets_of(docs.sparkSession)

    def block(held):
        k, i, h, at = map(np.concatenate, zip(*held))
        bucket = (k >> np.uint64(40)).astype(np.int64) % buckets
        o = np.lexsort((i, at, h, k, bucket))
        k, i, h, at, bucket = (x[o] for x in (k, i, h, at, bucket))
        k, i, h, at, bucket = (x[_first(k, h, at)] for x in (k, i, h, at, bucket))
        # Of a key that repeats in the chunk one occurrence is compared, the others are known to be picked.
        twin = np.concatenate(([False], k[1:] == k[:-1]))
        many = np.concatenate((twin[1:], [False])) | twin
        cols = []
        for m in (~twin, twin):
            ends = np.searchsorted(bucket[m], np.arange(1, buckets))
            cols += [[_planes(x) for x in np.split(c[m], ends)] for c in (k, i, h, at << 1 | many)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", *COLUMNS])

    def find(batches):
        held, size = [], 0
        for batch in batches:
            for b in parts(batch, "raw"):
                for i, h, r in zip(b.column("doc_id").to_pylist(), b.column("_sv_h").to_pylist(), b.column("raw")):
                    raw = np.frombuffer(r.as_buffer(), np.uint8)
                    if len(raw) >= LENGTH:
                        k, p, f, q = anchors(raw)
                        held.append((k, np.full(len(k), NULL if i is None else i, np.int64), np.full(len(k), h, np.int64), f << 16 | (p - f) << 8 | (q - f)))
                        size += len(k)
                        if size >= CHUNK:
                            yield block(held)
                            held, size = [], 0
        if held:
            yield block(held)

    def told(k, i, h, at):
        at = at >> 1
        return pa.RecordBatch.from_arrays([pa.array(i, mask=i == NULL), pa.array(h), pa.array(k.view(np.int64)), pa.array(at)], ["doc_id", "_sv_h", "k", "at"])

    def meet(held):
        k, i, h, at = (np.concatenate(c) for c in zip(*held))
        o = np.lexsort((i, at >> 1, h, k))
        edge = np.flatnonzero(_first(k[o], h[o], at[o] >> 1))
        many = np.bitwise_or.reduceat(at[o] & 1, edge) == 1 if len(o) else edge > 0
        o = o[edge]
        same = np.concatenate(([False], k[o][1:] == k[o][:-1]))
        keep = o[same | np.concatenate((same[1:], [False])) | many]
        return told(k[keep], i[keep], h[keep], at[keep])

    def gather(batches):
        last, held = None, []
        for b in batches:
            for bucket, *cols in zip(*(b.column(c).to_pylist() for c in ("bucket", *COLUMNS))):
                cols = [_from_planes(c, np.int64) for c in cols]
                cols[0], cols[4] = cols[0].view(np.uint64), cols[4].view(np.uint64)
                if bucket != last and held:
                    yield meet(held)
                    held = []
                last = bucket
                held.append(cols[:4])
                if len(cols[4]):
                    yield told(*cols[4:])
        if held:
            yield meet(held)

    rows = docs.mapInArrow(find, "bucket long, " + ", ".join(f"{c} binary" for c in COLUMNS))
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "doc_id long, _sv_h long, k long, at long")


NULL = -(1 << 63)
COLUMNS = ("k", "i", "h", "at", "tk", "ti", "th", "ta")
#: kind 0: a covered span (s, e). 1: a form: the surroundings ctx of a bucket k, first string at s; lo, hi: the bytes of ctx that all forms of k share.
SPANS = "kind int, doc_id long, _sv_h long, s long, e long, k long, ctx binary, lo int, hi int"


def _rows(rows):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)], [x.split()[0] for x in SPANS.split(", ")])


def _once(rows, seen):
    """Forms (doc_id, h, f, k, ctx, lo, hi) of one task: the first of each (k, ctx) goes on, of two the earlier; the other's bytes are covered."""
    out = []
    for i, h, f, k, ctx, lo, hi in rows:
        place = (NULL if i is None else i, h, f)
        was = seen.get((k, ctx))
        if was is None:
            seen[k, ctx] = place, i, lo, hi
        else:
            if place < was[0]:
                seen[k, ctx] = place, i, lo, hi
                i, h, f = was[1], *was[0][1:]
            out.append((0, i, h, f, f + len(ctx), None, None, None, None))
    return out


def _flushed(seen):
    for (k, ctx), (place, i, lo, hi) in seen.items():
        yield (1, i, *place[1:], None, k, ctx, lo, hi)


def _chunks(rows, size=4096):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _rows(held)
            held = []
    if held:
        yield _rows(held)


HELD = 200_000


def _forms(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Covered spans and forms: what surrounds each picked anchor, told once in a task."""

    def around(batches):
        seen = {}
        for b, of in documents_of(batches, ["doc_id", "_sv_h"], ["k", "at"], "raw"):
            out = []
            for i, h, r, (k, at) in zip(b.column("doc_id").to_pylist(), b.column("_sv_h").to_pylist(), b.column("raw").to_pylist(), of):
                f, lo, span = at >> 16, at >> 8 & 255, at & 255
                out += _once(((i, h, y, x, r[y : y + z + LENGTH], a, a + GRAM) for x, y, a, z in zip(*(v.tolist() for v in (k, f, lo, span)))), seen)
                if len(seen) > HELD:
                    yield from _chunks(_flushed(seen))
                    seen.clear()
            yield _rows(out)
        yield from _chunks(_flushed(seen))

    return beside(docs, picked, ["doc_id", "_sv_h"], ["at"]).mapInArrow(around, SPANS)


def _halved(forms: DataFrame) -> DataFrame:
    """Forms of large buckets parted: strings with half of the bytes they lack after the shared ones, and those with the other half before."""

    def part(batches):
        for batch in batches:
            for b in parts(batch, "ctx"):
                seen, out = {}, []
                for i, h, s, k, ctx, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "_sv_h", "s", "k", "ctx", "lo", "hi"))):
                    after = (LENGTH - (hi - lo) + 1) // 2
                    before = LENGTH - (hi - lo) - after + 1
                    cut = min(max(hi + after - LENGTH, 0), len(ctx) - LENGTH + 1)  # strings from here on reach after bytes beyond hi
                    if cut <= len(ctx) - LENGTH:
                        core = ctx[lo : hi + after]
                        out.append((i, h, s + cut, _named(k, 1, core), ctx[cut:], lo - cut, hi + after - cut))
                    if cut > 0:
                        first = max(0, lo - before)
                        core = ctx[first:hi]
                        out.append((i, h, s, _named(k, 2, core), ctx[: cut - 1 + LENGTH], first, hi))
                yield _rows([*_once(out, seen), *_flushed(seen)])

    return forms.mapInArrow(part, SPANS)


def _named(k: int, side: int, core: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(k.to_bytes(8, "little", signed=True) + bytes([side]) + core, digest_size=8).digest(), "little", signed=True)


def _sorted(forms: DataFrame) -> DataFrame:
    """Covered spans of forms that meet in their bucket."""

    def flush(rows):
        # The bytes that a bucket shares begin at a multiple of V: equal strings, which hold them at one place, have one residue.
        n, lo = np.array([len(r[1]) for r in rows]), np.array([r[5] for r in rows])
        full = (n + 2 * V - 1) // V * V
        at = np.cumsum(full) - full + (-lo) % V
        t = np.zeros(int(full.sum()) + V, np.uint8)
        t[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        win = n - LENGTH + 1
        own = np.repeat(np.arange(len(rows)), win)
        off = np.arange(len(own)) - np.repeat(np.cumsum(win) - win, win)
        _, cls = repeats(t, at[own] + off, aligned=True)
        doc, h, pos = (np.array([r[j] for r in rows])[own] for j in (2, 3, 4))
        pos = pos + off
        o = np.lexsort((pos, h, doc, cls))
        dup = np.concatenate(([False], cls[o][1:] == cls[o][:-1]))
        doc, h, pos = doc[o][dup], h[o][dup], pos[o][dup]
        # Neighbouring strings of a document are one span.
        o = np.lexsort((pos, h, doc))
        doc, h, pos = doc[o], h[o], pos[o]
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (pos[1:] - pos[:-1] > 1)))) if len(pos) else np.zeros(0, np.int64)
        last = np.concatenate((edge[1:], [len(pos)]))[: len(edge)] - 1
        return _rows([(0, None if i == NULL else i, x, s, e + LENGTH, None, None, None, None) for i, x, s, e in zip(doc[edge].tolist(), h[edge].tolist(), pos[edge].tolist(), pos[last].tolist())])

    def sort_blocks(batches):
        rows, held, bucket, seen, k0 = [], 0, [], {}, None
        for batch in batches:
            out = []
            for k, ctx, i, h, s, lo in zip(*(batch.column(c).to_pylist() for c in ("k", "ctx", "doc_id", "_sv_h", "s", "lo"))):
                if k != k0:
                    if len(seen) > 1:
                        rows += [(k0, c, *place, lo) for (_, c), (place, _, lo, _) in seen.items()]
                        held += sum(len(c) for _, c in seen)
                    k0, seen = k, {}
                    if held >= BLOCK:
                        yield flush(rows)
                        rows, held = [], 0
                out += _once([(i, h, s, k, ctx, lo, 0)], seen)
            yield _rows(out)
        if len(seen) > 1:
            rows += [(k0, c, *place, lo) for (_, c), (place, _, lo, _) in seen.items()]
        if rows:
            yield flush(rows)

    return forms.select("k", "ctx", "doc_id", "_sv_h", "s", "lo").repartition("k").sortWithinPartitions("k").mapInArrow(sort_blocks, SPANS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _sv_h, s, e): covered byte intervals of docs(doc_id, _sv_h, raw), written."""
    picked = written(_anchored(docs))
    got = written(_forms(docs, picked), picked)
    spans, forms, old = [got.where("kind = 0")], got.where("kind = 1"), [got]
    while True:
        big = forms.groupBy("k").agg(F.count("*").alias("m"), F.min(F.col("hi") - F.col("lo")).alias("w")).where((F.col("m") > MANY) & (F.col("w") < LENGTH)).select("k")
        big = written(big)
        if big.isEmpty():
            release(big)
            break
        rest = written(forms.join(big, "k", "left_anti"))
        got = written(_halved(forms.join(big, "k")), big)
        spans.append(got.where("kind = 0"))
        old += [got, rest]
        forms = rest.select(*got.columns).unionByName(got.where("kind = 1"))
    spans.append(_sorted(forms))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return written(out.select("doc_id", "_sv_h", "s", "e"), *old)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    docs = without(docs, "n_bytes", "n_removed", "n_spans", "kept").withColumn("_sv_h", F.xxhash64("text"))
    raw = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "_sv_h", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    # Equal texts but for the first are covered whole.
    size = F.octet_length("text")
    long = docs.where(size >= LENGTH).select(F.col("doc_id").cast("long").alias("doc_id"), "_sv_h", F.xxhash64(F.lit(1), "text").alias("g"), size.cast("long").alias("e"))
    first = written(long.groupBy("_sv_h", "g").agg(F.min(F.struct("doc_id")).alias("o"), F.max(F.struct("doc_id")).alias("z")).where("o <> z or (o.doc_id is null and z.doc_id is not null)"))
    copies = long.join(first, ["_sv_h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("o.doc_id"))).select("doc_id", "_sv_h", F.lit(0).cast("long").alias("s"), "e").distinct()
    spans = written(repeated_spans(raw).unionByName(copies), first)
    rest = [c for c in docs.columns if c != "_sv_h"]

    def cut(batches):
        for b, of in documents_of(batches, ["doc_id", "_sv_h"], ["s", "e"], "text"):
            rows = []
            for t, (s, e) in zip(b.column("text"), of):
                r = t.as_buffer() if t.is_valid else None
                r = np.frombuffer(r, np.uint8) if r is not None else np.zeros(0, np.uint8)
                edge = np.zeros(len(r) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, e, -1)
                gone = np.cumsum(edge)[:-1] > 0
                runs = int(np.count_nonzero(gone[1:] > gone[:-1])) + int(gone[:1].sum())
                rows.append((len(r), int(gone.sum()), runs, r[~gone].tobytes() if len(s) else r.tobytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(list(c), k) for c, k in zip(zip(*rows), (*[pa.int64()] * 3, pa.binary())))], [*rest, "n_bytes", "n_removed", "n_spans", "kept"])

    out = StructType([*(f for f in docs.schema.fields if f.name != "_sv_h"), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    return beside(docs, spans.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "_sv_h", "s", "e"), ["doc_id", "_sv_h"], ["s"]).mapInArrow(cut, out)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
