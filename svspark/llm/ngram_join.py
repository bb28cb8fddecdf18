"""Operator 4: n-gram Jaccard join with token-combination prefixes.

Texts become sets of five-word shingles (tokens). Null and empty texts have no
set and link with nothing. Rows with equal word sequences are one node of the
join; rows sharing a doc_id keep their own texts, links and component.

All tokens are counted. Frequent are those in more than LEAST sets, or in more
than the least threshold that leaves at most TABLE of them: the table that all
tasks hold has a fixed bound at any scale. Global token order: rare class
first, then the frequent ones by rising class of their count. Rare tokens are
indexed singly; frequent ones fall in subclasses, each indexed by its 2-token
combinations, and the prefix grows until the tokens that could be missing
cannot break every signature. Their number of subclasses grows with the size of
the set; sets that reach over a border of sizes emit for both sides. A set of
one token has no combination and is indexed by it.

Candidates and verification: ``linked`` in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCKS, blocks, buckets_of, differences, linked, lower_words, mix, node_of, paired, parts, release, sets_apart, sifted, size_class, smallest_id, stars, table, texts_of, through, verified, word_shingles, written

LEAST, TABLE, CHUNK, PER, ROUNDS = 16, 1 << 20, 1 << 20, 64, 2


def subclasses(n: int) -> int:
    """1 up to PER tokens, then four times as many for each border of four times the size."""
    g = 1
    while n > PER * g:
        g *= 4
    return g


def _combinations(s: np.ndarray, rank: np.ndarray, need: int, groups: int) -> list[np.ndarray]:
    """Keys of one set for a number of subclasses. s: tokens in hash order; rank: 0 for rare ones, else their class."""
    rare = s[rank == 0][:need]
    out = [mix(rare + np.uint64(2 * groups + 1))]
    warm = rank > 0
    freq = s[warm][np.argsort(rank[warm], kind="stable")]
    left, group = need - len(rare), (freq >> np.uint64(40)) % np.uint64(groups)
    seen: dict[int, list[int]] = {}
    for x, g in zip(freq.tolist(), group.tolist()):
        if left <= 0:
            break
        own = seen.setdefault(g, [])
        left -= bool(own)
        own.append(x)
    for own in seen.values():
        if len(own) > 1:
            v = np.array(own, np.uint64)
            i, j = np.triu_indices(len(v), 1)
            out.append(mix(mix(v[i] + np.uint64(2 * groups + 2)) + v[j]))
    return out


def signature_keys(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index keys of one set; 100 * intersection >= 80 * union implies a shared key."""
    n = len(s)
    if n < 2:
        return mix(s + np.uint64(1))
    need = n - (80 * n + 99) // 100 + 1
    out = [k for g in sorted({subclasses(n), subclasses(n * 5 // 4)}) for k in _combinations(s, rank, need, g)]
    return np.unique(np.concatenate(out))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) of the tokens in more than LEAST sets, counted over every distinct word sequence of a partition.

    Tokens travel in blocks by range of their hash, those seen once without a count.
    """
    buckets = buckets_of(docs.sparkSession)

    def counted(tokens):
        t, n = np.unique(np.concatenate(tokens), return_counts=True)
        at = np.searchsorted(t, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64))
        ones, many = [], []
        for x, y in zip(np.split(t, at), np.split(n, at)):
            ones.append(x[y == 1].tobytes())
            many.append(np.stack((x[y > 1], y[y > 1].astype(np.uint64))).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(ones, pa.binary()), pa.array(many, pa.binary())], ["bucket", "ones", "many"])

    def split(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            for b in parts(batch):
                for t in b.column("text").to_pylist():
                    w = lower_words((t or "").encode("utf-8", "surrogatepass"))
                    if w and (i := node_of(w)) not in seen:
                        seen.add(i)
                        held.append(word_shingles(t))
                        size += len(held[-1])
                        if size >= CHUNK:
                            yield counted(held)
                            held, size = [], 0
        if held:
            yield counted(held)

    def add(t, n):
        t, at = np.unique(np.concatenate(t), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
        keep = n > LEAST
        return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

    def count(batches):
        last, t, n = None, [], []
        for batch in batches:
            for b, ones, many in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ones", "many"))):
                if b != last and t:
                    yield add(t, n)
                    t, n = [], []
                x, y = np.frombuffer(ones, np.uint64), np.frombuffer(many, np.uint64).reshape(2, -1)
                t += [x, y[0]]
                n += [np.ones(len(x)), y[1].astype(np.float64)]
                last = b
        if t:
            yield add(t, n)

    rows = docs.select("text").mapInArrow(split, "bucket long, ones binary, many binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "token long, n long")


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most TABLE tokens in hash order, and the class (from 1 up) of each one's count."""
    got = written(token_counts(docs))
    by = sorted(map(tuple, got.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*")).collect()), reverse=True)
    least, total = None, 0
    for c, n in by:
        total += n
        if total > TABLE:
            break
        least = c
    if least is None:
        release(got)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    t = got.select("token", F.floor(F.log2("n") * 8).alias("c")).where(F.col("c") >= least).toArrow()
    token, c = t["token"].to_numpy().view(np.uint64), t["c"].to_numpy() - least + 1
    at = np.argsort(token)
    release(got)
    return token[at], np.minimum(c[at], 255).astype(np.uint8)


def ranks(s: np.ndarray, token: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(token):
        return np.zeros(len(s), np.uint8)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, rank[at], 0)


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, _sv_h (hash of the text), n_shingles, _sv_c and component_id (smallest doc_id reachable by links, itself included) of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    shared = spark.sparkContext.broadcast(frequent(texts))

    buckets = buckets_of(spark)

    def describe(batches):
        for batch in batches:
            for b in parts(batch):
                words = [lower_words((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
                n = [len(word_shingles(t)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_sv_h"), pa.array([node_of(w) if w else None for w in words], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "_sv_h", "node", "n_shingles"])

    def index(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            for b in parts(batch):
                for t in b.column("text").to_pylist():
                    w = lower_words((t or "").encode("utf-8", "surrogatepass"))
                    if w and (i := node_of(w)) not in seen:
                        seen.add(i)
                        s = word_shingles(t)
                        key = signature_keys(s, ranks(s, *shared.value))
                        held.append((key, np.full(len(key), size_class(len(s))), np.zeros(len(key), np.int64), np.zeros(len(key), bool), np.full(len(key), i)))
                        size += len(key)
                        if size >= CHUNK:
                            yield blocks(*map(np.concatenate, zip(*held)), buckets)
                            held, size = [], 0
        if size:
            yield blocks(*map(np.concatenate, zip(*held)), buckets)

    def verify(pairs, own):
        return through(sifted(pairs, own, sets_apart), lambda near: verified(near, own))

    def last(live, own):
        return through(paired(live, own, sets_apart), lambda near: verified(near, own))

    def deeper(live, own):
        pairs, sure = differences(live, own, lambda s: ranks(s, *shared.value))
        return pairs, [sure, verify(pairs, own)]

    comp = linked(stars(texts.mapInArrow(index, BLOCKS)), lambda ids: written(texts_of(texts, ids)), verify, last, deeper, ROUNDS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_sv_h"), "text").mapInArrow(describe, f"doc_id {kind}, _sv_h long, node long, n_shingles long")
    return smallest_id(written(rows), comp, "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each component with the smallest doc_id, then text hash; of rows equal in both, one."""
    c = written(ngram_components(docs))
    first = c.where("_sv_c is not null").groupBy("_sv_c").agg(F.min(F.struct("doc_id", "_sv_h")).alias("f")).select("f.*")
    stay = first.unionByName(c.where("_sv_c is null").select("doc_id", "_sv_h"))
    of = c.select("doc_id", "_sv_h").groupBy("doc_id", "_sv_h").agg(F.count("*").alias("_sv_n"))
    stay = written(stay.distinct().alias("s").join(of.alias("o"), F.expr("s.doc_id <=> o.doc_id and s._sv_h <=> o._sv_h")).select("s.*", "_sv_n"), c)
    keyed = docs.withColumn("_sv_h", F.xxhash64("text")).alias("d")
    same = F.expr("d.doc_id <=> s.doc_id and d._sv_h <=> s._sv_h")
    kept = keyed.join(stay.alias("s"), same, "left_semi")
    twice = stay.where("_sv_n > 1")
    if not twice.isEmpty():
        kept = keyed.join(stay.where("_sv_n = 1").alias("s"), same, "left_semi").unionByName(keyed.join(twice.alias("s"), same, "left_semi").dropDuplicates(["doc_id", "_sv_h"]))
    return kept.drop("_sv_h")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
