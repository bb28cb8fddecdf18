import random
import re
import tempfile
import time
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from svspark.llm import decontaminate, language, line_dedup, minhash, ngram_join, pii, sstable, suffix_dedup, url_filter
from svspark.llm.common import BLOCKS, blocks, buckets_of, mix, set_counts, sets_apart

BASE = " ".join(f"wort{i}" for i in range(200))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, k):
    assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


@given(st.text("abc", min_size=6, max_size=20), st.lists(st.tuples(st.integers(0, 19), st.sampled_from("abcx"), st.integers(0, 2)), max_size=2))
@settings(max_examples=300, deadline=None)
def test_segments_meet(a, edits):
    b = a
    for at, c, kind in edits:
        at = min(at, len(b))
        b = b[:at] + (c if kind else "") + b[at + (kind != 1):]
    if len(b) < 3:
        return
    row, key, own = line_dedup.keys_of([a, b])
    of = lambda r, o: set(key[(row == r) & (own == o)].tolist())
    assert of(0, True) & (of(1, True) | of(1, False)) or of(1, True) & of(0, False)


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the dog"
    got = line_dedup.dedup_lines(frame(spark, [(1, f"{line}\nown line of the first document"), (2, f"{line[:-1]}k\nshort"), (3, None), (4, ""), (5, f"{line}\n{line}")])).collect()
    assert {r.doc_id: r.kept for r in got} == {1: f"{line}\nown line of the first document", 2: "short", 3: None, 4: "", 5: ""}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_grows_with_length(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    a = " ".join(words[:37])
    b = a.replace(words[20], "zyxwvu")
    far = " ".join(words[:20] + words[40:57])
    got = line_dedup.dedup_lines(frame(spark, [(1, f"{a}\nshort one\n\n"), (2, f"{b}\nshort one\n\n"), (3, far)])).collect()
    assert {r.doc_id: r.kept for r in got} == {1: f"{a}\nshort one\n\n", 2: "\n", 3: far}


@given(st.integers(96, 700), st.data())
@settings(max_examples=200, deadline=None)
def test_long_keys_meet(n, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 99)))
    a, k = "".join(rng.choice(list("abc "), n)), line_dedup.allowed(n)
    b = a
    for i in range(k):
        at = min((2 * i + 1) * n // (2 * k + 1) + data.draw(st.integers(-5, 5)), len(b))
        b = b[:at] + data.draw(st.sampled_from(("x", "xy"))) + b[at + 1:]
    r, key, p = line_dedup.long_keys([a, b])
    places = [{(int(c), int(q)) for c, q in zip(key[r == j], p[r == j])} for j in (0, 1)]
    assert any(c == d and abs(x - y) <= 1 for c, x in places[0] for d, y in places[1])
    la, lb = line_dedup.length_class(np.array([len(a), len(b)]))
    assert abs(la - lb) <= 1


@given(st.text("ab", max_size=400))
@settings(max_examples=60, deadline=None)
def test_suffix_classes(s):
    raw = s.encode()
    if len(raw) < suffix_dedup.LENGTH:
        return
    starts = np.arange(len(raw) - suffix_dedup.LENGTH + 1)
    order, cls = suffix_dedup.repeats(np.frombuffer(raw, np.uint8), starts)
    win = [raw[i : i + suffix_dedup.LENGTH] for i in starts]
    assert [win[i] for i in order] == sorted(win)
    assert all((win[i] == win[j]) == (cls[i] == cls[j]) for i in starts[:20] for j in starts)


def test_difference_cover():
    c = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.V for a in c for b in c} == set(range(suffix_dedup.V))


def test_suffix_dedup_brute(spark):
    docs = [(1, BASE), (2, "x" + BASE[50:900]), (3, BASE), (4, None), (5, "a" * 350), (6, "é" * 90)]
    seen, want = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cov[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = (sum(cov), len(re.findall(b"\1+", bytes(cov))), bytes(x for x, c in zip(b, cov) if not c))
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(frame(spark, docs)).collect()}
    assert got == want


def test_wu_manber():
    w = decontaminate.words
    m = decontaminate.WuManber([(1, w("a b c d e f g h i j k")), (2, w("Only two")), (3, []), (4, w("solo"))])
    hit, items = m.search(w("x b c d e f g h i j k y ONLY two, solo"))
    assert items == {1, 2, 4} and list(hit) == [0] + [1] * 10 + [0, 1, 1, 1]


def test_contamination_in_blocks(spark):
    docs = frame(spark, [(1, "one two three"), (2, None), (3, "four five")])
    bench = spark.createDataFrame([(1, "one two"), (2, "five"), (3, None)], "item_id long, text string")
    got = {r.doc_id: (list(r._hit), r._items) for r in decontaminate.contamination(docs, bench, max_words=1).collect()}
    assert got == {1: ([1, 1, 0], [1]), 2: ([], []), 3: ([0, 1], [2])}


def test_ngram_components(spark):
    words = BASE.split()
    near = " ".join(words[:100] + ["anders"] + words[101:])
    got = ngram_join.ngram_components(frame(spark, [(5, BASE), (2, near), (9, near.upper()), (3, "etwas ganz"), (4, None), (6, ""), (7, "Etwas  ganz")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 2, 2: 2, 9: 2, 3: 3, 7: 3, 4: 4, 6: 6}
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_signature_keys_lose_nothing(n, drop, seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    other = np.unique(np.concatenate((base[rng.permutation(len(base))[min(drop, len(base) - 1):]], rng.integers(0, 2**63, drop // 3, dtype=np.uint64))))
    warm = {int(x): int(rng.integers(0, 4)) if rng.random() < seed / 10 else 0 for x in np.concatenate((base, other))}
    rank = lambda x: np.array([warm[int(y)] for y in x], np.uint8)
    both = len(np.intersect1d(base, other))
    if 100 * both >= 80 * (len(base) + len(other) - both):
        assert np.intersect1d(ngram_join.signature_keys(base, rank(base)), ngram_join.signature_keys(other, rank(other))).size
        assert abs(ngram_join.size_class(len(base)) - ngram_join.size_class(len(other))) <= 1


@given(st.dictionaries(st.integers(-(2**62), 2**62), st.lists(st.integers(0, 65535), max_size=5), max_size=30))
@settings(max_examples=40, deadline=None)
def test_shard_round_trip(tmp_path_factory, docs):
    path = tmp_path_factory.mktemp("s") / "x.sst"
    w = sstable.Writer(open(path, "wb"), 2)
    for i in sorted(docs):
        w.add(i, docs[i])
    w.close()
    r = sstable.Reader(f"file://{path}")
    assert [(i, list(x)) for i, x in r] == sorted(docs.items())
    assert all(list(r.get(i)) == docs[i] for i in docs) and r.get(2**62 + 1) is None


def test_url_rules(spark):
    urls = ["https://a.example.com/en/7x?q", "http://X.COM/en/", "no scheme", None, "https://example.net/de/8", "https://foocom/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert got == {0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("x.com", "/en/", "com/en/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
                   4: ("example.net", "/de/8", "example.net/de/8", "block"), 5: ("foocom", "/en/", None, got[5][3])}


def test_url_models_count_every_url(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abc"), 3))
    urls = sorted({f"https://{'casino' if i % 3 == 0 else 'shop'}{word()}.{('com/en/', 'net/de/', 'io/')[0 if i % 3 == 0 else 1]}{i % 90}" for i in range(150)} | {f"https://{k}{word()}.io/{i}" for i in range(20) for k in ("casino", "shop")})
    got = {r.url: r for r in url_filter.judge(spark.createDataFrame([(x,) for x in urls + urls[:9]], "url string")).collect()}
    held = {r.url for r in spark.createDataFrame([(x,) for x in urls], "url string").where("pmod(xxhash64(substring(url, 9)), 5) = 0").collect()}

    def loglik(t, train):
        s, out = "\x02" * 4 + t + "\x03", 0.0
        texts = ["\x02" * 4 + x + "\x03" for x in train]
        for i in range(4, len(s)):
            p = 1 / 256
            for k in range(5):
                ctx = [x[j] for x in texts for j in range(4, len(x)) if x[j - k : j] == s[i - k : i]]
                if ctx:
                    p = (ctx.count(s[i]) + len(set(ctx)) * p) / (len(ctx) + len(set(ctx)))
            out += np.log(p)
        return out / (len(t) + 1)

    good, bad = ([x[8:] for x in urls if x not in held and got[x].rule and got[x].verdict == v] for v in ("allow", "block"))
    for x in urls[:3] + urls[-3:]:
        assert abs(got[x].ratio - loglik(x[8:], good) + loglik(x[8:], bad)) < 1e-6
    told = {x: got[x].verdict == "block" for x in held if got[x].rule}
    edges = sorted({got[x].ratio for x in told})
    err = lambda c: sum(got[x].ratio >= c for x, b in told.items() if b) / max(1, sum(told.values())) + sum(got[x].ratio < c for x, b in told.items() if not b) / max(1, len(told) - sum(told.values()))
    best = min(((a + b) / 2 for a, b in zip(edges, edges[1:])), key=err)
    free = [r for r in got.values() if not r.rule]
    assert all((r.verdict == "allow") == (r.ratio >= best) for r in free)
    assert sum((r.verdict == "block") == ("casino" in r.url) for r in free) >= 0.95 * len(free)


def test_language_edges(spark):
    rows = spark.createDataFrame([(i, f"{w} {w} {i}", lang) for i in range(40) for w, lang in (("the house", "en"), ("das haus", "de"))], "doc_id long, text string, lang string")
    p = language.learn(rows)
    assert language.LETTER.search("\u00bd \u00b2") is None
    got = [r.lang_pred for r in language.identify(frame(spark, [(1, "das haus"), (2, "the house"), (3, "12 !"), (4, None)]), p).orderBy("doc_id").collect()]
    assert got == ["de", "en", "und", "und"]
    assert language.learn(rows.limit(0)) == {} and zlib.crc32(b"1") >= 0


def test_language_stage_rejects_by_score(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = {"en": "the house of and with that was for they have from this had not are but what all were when".split(), "de": "das haus und der die nicht ist ein mit sich auf dem auch werden aus hat dass sie nach wird".split()}
    docs = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate(["en", "de"] * 150)]
    odd = [(1000, "litwo ojczyzno moja jak zdrowie trzeba tylko dowie piękność twą całej ozdobie widzę opisuję " * 3, "en"), (1001, "xq zvk wqpj kkzx vvbq jjx qqk zzw " * 6, "de"), (1002, "12 !", "en")]
    rows = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in docs + odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, rows, None).collect()}
    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert held <= kept and len(kept) >= 295 and not kept & {1000, 1001, 1002}


def test_pii_base(spark):
    t = "mail a.b@c.de or 10.0.0.255, 999.1.1.1 card 4111 1111 1111 1111 tel +49 (30) 1234567."
    r = pii.find_pii(frame(spark, [(1, t), (2, None), (3, "")])).orderBy("doc_id").collect()
    assert [[t[x.s : x.e] for x in r[0][k]] for k in pii.KINDS] == [["a.b@c.de"], ["10.0.0.255"], ["4111 1111 1111 1111"], ["+49 (30) 1234567"]]
    assert all(not r[j][k] for j in (1, 2) for k in (*pii.KINDS, "other"))


def test_pii_added_spans(spark):
    docs = [(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'), (2, "call 030 551 2345 or write jo [at] b.de now"), (3, "password: hunter2hunter"), (4, "ssn 123-45-6789."),
            (5, "order 123456789012 of 2024-02-11, see you (at) home"), (6, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff fixes it"), (7, "a sum of 1 234 567 in 1998 - 2004"), (8, "a@b.de +49 30 5512345 10.0.0.1")]
    got = {r.doc_id: [dict(docs)[r.doc_id][x.s : x.e] for x in r.other] for r in pii.find_pii(frame(spark, docs)).collect()}
    assert any("24be64439e3e" in x for x in got[1]) and "030 551 2345" in got[2] and any(x.startswith("jo [at] b.de") for x in got[2]) and got[3] and got[4]
    assert not any(got[i] for i in (5, 6, 7, 8))


def test_pii_recall_on_planted_documents(spark):
    """Templates of another seed than those learned from: precision and recall of the added spans."""
    import random

    made, keep = [], random.Random
    try:
        random.Random = lambda _: keep(77)
        made = pii.samples(800)
    finally:
        random.Random = keep
    got = {r.doc_id: sum(len(r[k]) for k in (*pii.KINDS, "other")) > 0 for r in pii.find_pii(frame(spark, [(i, t) for i, (t, _) in enumerate(made)])).collect()}
    hit = sum(got[i] for i, (_, y) in enumerate(made) if y)
    assert hit >= 0.9 * sum(y for _, y in made) and hit >= 0.9 * sum(got.values())


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_brute(t):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {}
    for k, p in plain.items():
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}[k]
        out[k] = [(m.start(), m.end()) for m in re.finditer(p, t) if ok(m)]
    return out


def test_pii_patterns_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    parts = ["a", "@", ".", "b-c", "_", "é", "\U0001f600", " ", "-", "+", "1", "42", "255", "256", "4111 1111 1111 1111", "4111111111111111", "(", ")", "a@b.c", "10.0.0.1", "+49 30 1234567", "%"]
    docs = [(i, "".join(rng.choice(parts, rng.integers(0, 14)))) for i in range(3000)]
    for r in pii.find_pii(frame(spark, docs)).collect():
        assert {k: [(x.s, x.e) for x in r[k]] for k in pii.KINDS} == base_brute(dict(docs)[r.doc_id]), docs[r.doc_id]


def test_pii_long_texts(spark):
    docs = [(1, "1" * 100_000), (2, "a@" + "b." * 100_000 + "c"), (3, "12345678 " * 100_000), (4, "x1@y.com " * 20_000)]
    got = {r.doc_id: len(r.email) for r in pii.find_pii(frame(spark, docs)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 20_000}


def test_pieces_round_trip():
    import public_tokenizers

    from svspark.llm.sentencepiece_codec import Codec

    c = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ("", " ", "Hello  world\n", "ñ 漢字 ▁x", " a" * 100, "\U0001f600 \x00"):
        assert c.decode(c.encode(t)) == t
    assert c.encode(None) == []


def test_window_is_the_least_common_run():
    rate, gram = line_dedup.RATE, line_dedup.GRAM
    run = lambda m: -(-(m - m // rate) // (m // rate + 1))
    for n in range(line_dedup.LONG, 1500):
        partners = [m for m in range(line_dedup.LONG, n + 1) if n - m <= line_dedup.allowed(m)]
        w = int(line_dedup.window(np.array([n]))[0])
        assert w + gram - 1 <= min(map(run, partners)) and w + gram - 1 >= 24
    text = "".join(np.random.default_rng(5).choice(list("abcdefgh "), 600))
    assert len(line_dedup.long_keys([text] * 50)[0]) < 0.125 * 50 * 600  # some 0.14 keys a code point with windows of 13 at any length


@given(st.text("abcd ", min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from("abx"), st.integers(0, 2)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pair_counts_lose_no_pair(a, edits):
    b = a
    for at, c, kind in edits:
        at = min(at, len(b))
        b = b[:at] + (c if kind else "") + b[at + (kind != 1):]
    x, y = line_dedup.pair_counts([a, b]).astype(int)
    assert abs(x - y).sum() <= 4 * distance(a, b)
    assert line_dedup._reached(a, b, len(edits)) and (distance(a, b) == 0 or not line_dedup._reached(a, b, distance(a, b) - 1))


def test_index_shuffle_goes_with_the_index(spark):
    stored = lambda: {p.name.split("_")[1] for p in Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*")}
    before = stored()
    pairs = line_dedup.stars(line_dedup._keys(frame(spark, [(i, f"line {i % 7} of a text that is long enough to have keys") for i in range(50)]), 2))
    time.sleep(2)
    assert not stored() - before and pairs.count()


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=100, deadline=None)
def test_set_counts_lose_no_link(s, gone, new):
    """What the counts tell apart is never more than the symmetric difference, and no pair that links is beyond the bound."""
    a = np.array(sorted(s), np.uint64)
    b = np.concatenate((a[gone:], mix(np.arange(new + (gone >= len(a)), dtype=np.uint64) + np.uint64(7))))
    x, y = (np.frombuffer(set_counts(z), np.uint8).astype(int) for z in (a, b))
    both = len(set(a.tolist()) & set(b.tolist()))
    n, m = len(set(a.tolist())), len(set(b.tolist()))
    assert abs(x - y).sum() <= n + m - 2 * both + (len(b) - m)
    if 100 * both >= 80 * (n + m - both) and len(b) == m:
        assert abs(x - y).sum() <= sets_apart(np.array([n]), np.array([m]))[0]


def test_only_keys_of_two_lines_travel(spark):
    """Lines without a partner leave a few bytes, not their keys; whoever meets with all keys does so with those that travel."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in range(24, 424)]
    alone = line_dedup._keys(frame(spark, list(enumerate(lines))), 2)
    sent = sum(len(r.entry) // 8 for r in alone.collect())
    assert sent < 400  # some 13000 keys
    text = [*lines, *(x[:9] + "#" + x[10:] for x in lines[::3]), *lines[::7]]
    docs = frame(spark, list(enumerate(text))).repartition(3)
    got = {tuple(r) for r in line_dedup.stars(line_dedup._keys(docs, 2)).collect()}
    buckets = buckets_of(spark)
    ids, held = np.array([line_dedup.line_id(x) for x in text]), []
    for x in range(len(text)):
        n = len(text[x])
        if n < line_dedup.LONG + 2:
            r, key, own = line_dedup.keys_of([text[x]], 2)
            held.append((key.view(np.uint64), r * 0, r * 0, ~own, ids[r + x]))
        if n >= line_dedup.LONG:
            r, key, place = line_dedup.long_keys([text[x]])
            held.append((key, line_dedup.length_class(np.full(len(r), n)), place, np.zeros(len(r), bool), ids[r + x]))
    every = spark.createDataFrame(blocks(*map(np.concatenate, zip(*held)), buckets).to_pandas(), BLOCKS)
    assert got == {tuple(r) for r in line_dedup.stars(every).collect()} and len(got) > 100
