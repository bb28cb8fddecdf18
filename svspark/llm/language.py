"""Operator 9: language identification by rank-order profiles.

A profile ranks a language's TOP most frequent character n-grams (1 to 3
characters; letters folded, letters and marks kept, all else one blank). A
text's distance is the mean out-of-place distance of its own TOP n-grams, TOP
for one the profile lacks. Ties in frequency rank by code points.

Learned only from text and lang of rows whose crc32(doc_id as text) mod 5 is
not 0, null languages left out; at most SAMPLE documents per language, those of
smallest doc_id hash (a bounded, documented sample). Null texts and texts
without letters (Unicode category L) are ``und`` with score 0, as all texts are
if nothing was learned. Input columns named lang_pred or score, or beginning
with ``_sv_``, are replaced. Rows are judged one by one, so repeats agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import parts, table, without

TOP, SAMPLE, SPAN, LANGUAGES = 300, 400, 1 << 20, 10_000
LOW, ENOUGH = 0.01, 100
LETTER = regex.compile(r"\p{L}")
GAPS = regex.compile(r"[^\p{L}\p{M}]+")


def _sum(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, weights=n, minlength=len(code)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three code points and one, 21 bits each) and counts of all n-grams of the whole text; n-grams across chunks of a long text are kept."""
    t = " " + GAPS.sub(" ", text.lower()).strip() + " "
    code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(t), SPAN):
        lead = min(i, 2)
        c = np.frombuffer(t[i - lead : i + SPAN].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        found, v = [c[lead:]], c
        for k in (1, 2):
            v = v[:-1] << np.uint64(21) | c[k:]
            found.append(v[max(0, lead - k) :])
        one, m = np.unique(np.concatenate(found), return_counts=True)
        code, n = (one, m) if i == 0 else _sum(np.concatenate((code, one)), np.concatenate((n, m)))
    return code, n


def top_codes(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    if len(n) > TOP:
        keep = n >= np.partition(n, len(n) - TOP)[len(n) - TOP]
        code, n = code[keep], n[keep]
    return code[np.lexsort((code, -n))][:TOP]


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profile of each language: TOP codes in order. Counting is distributed; what comes back is TOP rows per language.

    The smallest hashes are picked among about 2 * SAMPLE documents below a
    bound that the language's count sets, so no language is ordered whole.
    """
    d = docs.where("lang is not null and text is not null").withColumn("_sv_o", F.xxhash64("doc_id"))
    many = d.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(many) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not many:
        return {}
    share = F.create_map(*(F.lit(x) for r in many for x in (r["lang"], min(1.0, 2.0 * SAMPLE / r["n"] + 20 / r["n"]))))
    some = d.where(F.col("_sv_o") / F.lit(2.0**64) + 0.5 <= share[F.col("lang")])
    own = some.select("lang", "doc_id", "_sv_o").withColumn("_sv_n", F.row_number().over(Window.partitionBy("lang").orderBy("_sv_o", "doc_id"))).where(F.col("_sv_n") <= SAMPLE)
    d = some.select("doc_id", "lang", "text").join(own.select("doc_id", "lang").distinct(), ["doc_id", "lang"], "left_semi")

    def count(batches):
        by: dict[str, tuple] = {}
        for batch in batches:
            for b in parts(batch):
                for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    got = gram_counts(t)
                    by[lang] = _sum(*map(np.concatenate, zip(by[lang], got))) if lang in by else got
        for lang, (code, n) in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "c"])

    got = d.select("lang", "text").mapInArrow(count, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
    # Profiles hold the sample's n-grams, a bounded table.
    ranked = got.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "code"))).where(F.col("r") <= TOP)
    out: dict[str, list] = {}
    for r in ranked.orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def classify(text: str | None, langs: list[str], profiles: list[tuple[np.ndarray, np.ndarray]]) -> tuple[str, float]:
    """profiles: per language its codes in order and the rank of each."""
    if not text or not langs or not LETTER.search(text):
        return "und", 0.0
    top = top_codes(*gram_counts(text))
    own, away = np.arange(len(top)), []
    for code, rank in profiles:
        at = np.minimum(np.searchsorted(code, top), len(code) - 1)
        away.append(np.where(code[at] == top, np.minimum(np.abs(rank[at] - own), TOP), TOP).mean())
    k = int(np.argmin(away))
    return langs[k], float(1 - away[k] / TOP)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """docs plus lang_pred and score."""
    docs = without(docs, "lang_pred", "score")
    langs = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast((langs, [(np.sort(profiles[k]), np.argsort(profiles[k])) for k in langs]))

    def run(batches):
        for batch in batches:
            for b in parts(batch):
                got = [classify(t, *shared.value) for t in b.column("text").to_pylist()]
                yield b.append_column("lang_pred", pa.array([g[0] for g in got], pa.string())).append_column("score", pa.array([g[1] for g in got], pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def _size():
    """Class of a text by its length: binary logarithm, at most 12; scores of short texts vary most."""
    return F.least(F.floor(F.log2(F.greatest(F.length("text"), F.lit(1)))), F.lit(12))


def score_floors(scored: DataFrame) -> dict[tuple[str, int], float]:
    """Least accepted score by language and size (-1: all sizes) from rightly identified rows of ``scored``: the LOW quantile less its distance to the median.

    Sizes of fewer than ENOUGH rows go without. Counting is distributed; what comes back is at most 1000 rows per language and size.
    """
    got = (scored.where("lang = lang_pred and lang_pred <> 'und'").groupBy("lang_pred", _size().alias("size"), F.floor(F.col("score") * 1000).alias("s")).agg(F.count("*").alias("n"))
           .orderBy("lang_pred", "size", "s").collect())
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in got:
        for key in ((r["lang_pred"], r["size"]), (r["lang_pred"], -1)):
            h = by.setdefault(key, {})
            h[r["s"]] = h.get(r["s"], 0) + r["n"]

    def quantile(h, q):
        left = q * (sum(h.values()) - 1)
        for s in sorted(h):
            left -= h[s]
            if left < 0:
                return s / 1000

    return {k: 2 * quantile(h, LOW) - quantile(h, 0.5) for k, h in by.items() if k[1] < 0 or sum(h.values()) >= ENOUGH}


def accepted(scored: DataFrame, floors: dict[tuple[str, int], float]) -> DataFrame:
    """Rows of a language whose score reaches the floor of its size, or of all sizes where that has none."""
    if not floors:
        return scored.where("lang_pred <> 'und'")
    of = F.create_map(*(F.lit(x) for (lang, size), v in sorted(floors.items()) for x in (f"{size} {lang}", v)))
    at = lambda size: of[F.concat_ws(" ", size.cast("string"), "lang_pred")]
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= F.coalesce(at(_size()), at(F.lit(-1)), F.lit(0.0))))


def held_out():
    """Null doc_ids are held out: nothing is learned from them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    profiles = learn(d.where(~held_out()).select("doc_id", "lang", "text"))
    return identify(d.select("doc_id", "text", held_out().alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")
