"""Queries and operators against brute force, and nulls, empties, long texts, repeats, empty tables and clashing columns for all of them."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from svspark.llm import decontaminate, language, line_dedup, minhash, ngram_join, pii, queries, sentencepiece_codec, sstable, suffix_dedup, url_filter
from svspark.llm.common import lower_words, word_shingles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


def got(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, DATA).collect()]


def groups(nodes, link):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if link(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def plain_shingles(t):
    w = [x.decode("utf-8") for x in lower_words((t or "").encode())]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingles_and_components(spark, docs):
    sets = {i: plain_shingles(t) for i, t in docs.items()}
    alike = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = groups(sorted(docs), alike)
    rows = got(spark, "op4_ngram_join")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), want[i]) for i in docs} and len(rows) == len(docs)
    near = got(spark, "op2_minhash")
    recall = sum(r["class_id"] == want[r["doc_id"]] for r in near) / len(near)
    assert recall >= 0.99
    order = sorted(docs)
    for r in near:
        t, n = docs[r["doc_id"]] or "", docs[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b = (minhash.signature(word_shingles(x)) for x in (t, e))
        assert r["fingerprint"] == a.tobytes().hex() and r["edited_fingerprint"] == b.tobytes().hex() and r["near_edited"] == float((a == b).mean())


def test_contamination(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - 9) or bool(w)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for r in got(spark, "op3_decontaminate"):
        w = words(docs[r["doc_id"]])
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_bytes_that_repeat(spark, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, c in zip(b, gone) if not c)).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got(spark, "op7_suffix_dedup")} == want


def test_large_buckets_are_parted(spark, docs, monkeypatch):
    some = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    whole = sorted(map(tuple, suffix_dedup.dedup_bytes(some).drop("text").collect()))
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    assert sorted(map(tuple, suffix_dedup.dedup_bytes(some).drop("text").collect())) == whole


def distance(a, b):
    row = np.arange(len(b) + 1)
    other = np.frombuffer(b.encode("utf-32-le"), "<u4")
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (other != ord(x)))
        row = np.minimum.accumulate(np.concatenate(([i], new)) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def test_lines(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 6, 9, 25, 60, 90) for _ in range(4)]

    def turned(x):
        for _ in range(r.randint(0, line_dedup.allowed(len(x)) + 2)):
            k = r.randrange(len(x) + 1)
            x = x[:k] + r.choice(("", "z", "zz")) + x[k + r.randint(0, 1) :]
        return x

    docs = [(i, "\n".join(turned(r.choice(base)) if r.random() < 0.9 else "" for _ in range(r.randint(0, 6)))) for i in range(60)]
    lines = sorted({x for _, t in docs for x in t.split("\n") if x.strip()})
    link = lambda a, b: min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= (k := line_dedup.allowed(min(len(a), len(b)))) and distance(a, b) <= k
    cls, seen, want = groups(lines, link), set(), {}
    for i, t in docs:
        out = []
        for x in t.split("\n"):
            if not x.strip() or cls[x] not in seen:
                out.append(x)
            if x.strip():
                seen.add(cls[x])
        want[i] = "\n".join(out)
    assert {x.doc_id: x.kept for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_shards(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    rows = {r["doc_id"]: r for r in got(spark, "op6_sstable")}
    for i in sorted(docs):
        ids = [*tok.encode(docs[i] or "", add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_parts_encode_as_wholes():
    import public_tokenizers

    e, r = sstable.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    parts = list("aB'sS t\n\r\x0b\x0c\x1c\x85\xa0\u0301\u00e9\u00df\u0130\u03a312\u00bd<|>.\u6f22\u200d\u3000") + ["<|endoftext|>", "'ll ", " \u0301"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(5000)]
    assert e.apart and e.encode(texts) == e._whole(texts)


def test_pieces_have_the_best_score():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    c, sp = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    score = {p.replace("\u2581", " "): sp.get_score(i) for i, p in enumerate(c.piece) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    for t in ("the house", "a \u00fcber  \u6f22x", "nnnnnn ll", "\U0001f600"):
        s = " " + t
        best = [0.0] + [-1e300] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max([best[b] + score[s[b:e]] for b in range(max(0, e - 40), e) if s[b:e] in score] + [best[e - 1] + c.byte_score * len(s[e - 1].encode())])
        own = {i: c.byte_score for i in c.bytes.values()}
        assert abs(sum(own.get(i, sp.get_score(i)) for i in c.encode(t)) - best[-1]) < 1e-6


def test_languages(spark):
    rows = got(spark, "op9_language")
    true = dict(duckdb.sql(f"select doc_id, lang from '{DATA}/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"] and true[r["doc_id"]]]
    assert held and sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


LINE = "the quick brown fox jumps over the lazy dog and far away"
CASES = [(1, None), (2, ""), (None, "no id here"), (3, "   "), (4, f"{LINE}\n{LINE}"), (4, "another text under the same id, told apart by it"), (5, LINE), (5, LINE), (6, LINE * 3000), (7, "a" * 5000), (8, LINE), (9, "\u00e9\U0001f600 " * 40)]
TOKENS = "piece_bpe_32k.model"


def apply(name, spark, d):
    import public_tokenizers

    bench = spark.createDataFrame([(1, LINE), (2, None), (3, "")], "item_id long, text string")
    return {
        "lines": lambda: line_dedup.dedup_lines(d), "prints": lambda: minhash.fingerprints(d), "windows": lambda: decontaminate.contamination(d, bench), "ngrams": lambda: ngram_join.ngram_components(d),
        "pieces": lambda: sentencepiece_codec.encode_decode(d, public_tokenizers.path(TOKENS)), "shards": lambda: sstable.read_shards(sstable.write_shards(d, public_tokenizers.path("word_bpe_49k.json"))),
        "bytes": lambda: suffix_dedup.dedup_bytes(d), "urls": lambda: url_filter.judge(d.withColumnRenamed("text", "url")), "language": lambda: language.identify(d, language.learn(d.withColumn("lang", F.lit("en")))), "pii": lambda: pii.find_pii(d)}[name]()


@pytest.mark.parametrize("name", ["lines", "prints", "windows", "ngrams", "pieces", "shards", "bytes", "urls", "language", "pii"])
def test_edge_rows(spark, name):
    clash = {"kept": "k", "n_lines": "k", "score": "k", "host": "k", "email": "k", "other": "k", "_hit": "k", "ids": "k", "decoded": "k", "n_bytes": "k", "component_id": "k", "sig": "k", "node": "k", "_sv_h": "k"}
    d = spark.createDataFrame(CASES, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in clash.items()})
    out = apply(name, spark, d).collect()
    assert len(out) == len(CASES)
    assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(i) for i, _ in CASES)
    assert apply(name, spark, d.limit(0)).count() == 0


def test_repeats_are_told_apart(spark):
    d = spark.createDataFrame(CASES, "doc_id long, text string")
    lines = {(r.doc_id, r.text): r.kept for r in line_dedup.dedup_lines(d).collect()}
    assert lines[4, CASES[5][1]] == CASES[5][1] and lines[4, CASES[4][1]] == LINE and lines[8, LINE] == "" and lines[1, None] is None
    kept = {(r.doc_id, r.text): bytes(r.kept) for r in suffix_dedup.dedup_bytes(d).collect()}
    assert kept[4, CASES[5][1]] == CASES[5][1].encode()
    one = ngram_join.one_of_each(d).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one) == [(False, i) for i in (1, 2, 3, 4, 4, 5, 6, 7, 9)] + [(True, 0)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lang = stages["language_id"](spark, docs, DATA).cache()
    assert 0.97 * docs.count() <= lang.count() <= docs.count() and lang.columns == list(corpus_pipeline.COLUMNS)
    near = stages["ngram_join"](spark, docs, DATA)
    sets = {i: plain_shingles(t) for i, t in docs.select("doc_id", "text").collect()}
    cls = groups(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(set(cls.values()))
    clean = {r["doc_id"] for r in got(spark, "op3_decontaminate") if not r["contaminated"]}
    assert {r.doc_id for r in stages["decontaminate"](spark, docs, DATA).select("doc_id").collect()} == clean
    out = corpus_pipeline.run(spark, DATA)
    ids = [r.doc_id for r in out.collect()]
    assert ids and len(ids) == len(set(ids)) and set(ids) <= set(sets)


def _near_copies(rng, n, changed, tails):
    """Copies of one text of 150 words, some of them changed, with tails also cut or followed by others, so that many lie just off the link."""
    base = [f"b{i}" for i in range(150)]
    for k in range(n):
        w = list(base)
        for i in rng.sample(range(150), rng.choice(changed)):
            w[i] = f"x{k}y{i}"
        yield " ".join(w[: 150 - tails * rng.choice((0, 0, 9, 20))] + [f"z{rng.randrange(3)}v{i}" for i in range(tails * rng.choice((0, 0, 4, 12)))])


def _links(texts):
    sets = [set(word_shingles(t).tolist()) for t in texts]
    least = list(range(len(sets)))
    for _ in range(len(sets)):
        new = [min(least[j] for j in range(len(sets)) if 100 * len(s & sets[j]) >= 80 * len(s | sets[j])) if s else i for i, s in enumerate(sets)]
        if new == least:
            return least
        least = new
    return least


@pytest.mark.parametrize("changed, tails", [((0, 1, 2, 3, 4, 5), 1), ((0, 1, 2, 3, 4, 5), 0)])
def test_near_copies_off_the_link(spark, monkeypatch, changed, tails):
    rng = random.Random(len(changed))
    texts = list(_near_copies(rng, 250, changed, tails)) + [" ".join(f"q{rng.randrange(9)}" for _ in range(60)) for _ in range(40)]
    tried, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, own: tried.append(pairs.distinct().count()) or real(pairs, own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(ngram_join.ngram_components(docs).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == _links(texts)
    assert tails or sum(tried) < 25 * len(texts)


def test_lines_of_one_key_apart(spark, monkeypatch):
    """Lines of one long group, most of them apart but of the same code points, some alike: links as by brute force, and no table of all their pairs."""
    rng = random.Random(3)
    lines, tail = [], list("abcdefghijklmnopqrstuvwxyz0123456789")
    for _ in range(220):
        rng.shuffle(tail)
        x = "a head that all have " + "".join(tail)
        lines += [x] + [x.replace(rng.choice(tail), "") for _ in range(rng.choice((0, 0, 1)))]
    tried, real = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: tried.append(pairs.distinct().count()) or real(pairs, *a))
    monkeypatch.setattr("svspark.llm.common.BLOCK", 50, raising=False)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = dict(line_dedup.line_classes(docs).collect())
    ids = [line_dedup.line_id(x) for x in lines]
    cls = groups(range(len(lines)), lambda i, j: line_dedup.within(lines[i], lines[j], 2))
    assert len(set(cls.values())) < len(lines) and {frozenset(i for i in got if got[i] == c) for c in got.values()} - {frozenset([i]) for i in got} == {
        frozenset(ids[i] for i in cls if cls[i] == c) for c in cls.values()} - {frozenset([i]) for i in ids}
    assert sum(tried) < 25 * len(lines)
