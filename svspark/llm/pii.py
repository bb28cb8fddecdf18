"""Operator 10: personal data by candidate gradient boosting, DataFrame functions only.

Base spans follow fixed patterns. High-recall generators propose further,
overlapping spans: numbers with separators, obfuscated addresses, account
numbers, long tokens and values behind a label. Each gets format and context
features; boosted trees of two levels score it as a Column expression; those
over the calibrated threshold that touch no base span are added as kind
``other``. The trees are fitted on SAMPLES texts made here from templates, half
of them held back to calibrate: that bound is a parameter. They go through the
same feature columns, and learning sees the counts of feature patterns only.
So a row's result depends on its text alone.

Patterns are possessive or begin at the edge of a run: none recurses or tries a
run anew from each of its places. Positions come from the lengths of matches
and gaps, summed in two levels; no text is searched for its own matches.

Null texts are empty. Positions are code points. Rows are judged one by one, so
repeats agree. Input columns named like a result (KINDS, other), or beginning
with ``_sv_``, are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

# The base patterns, each equal to its plain form (email, ip, card of 16 to 19 digits, phone).
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")
# Generators.
NUMBER = r"(?<![A-Za-z0-9.])\(?[0-9][0-9().\x20/-]{5,40}(?<=[0-9])(?![A-Za-z0-9])"
HIDDEN = rf"(?<!{LOCAL}){LOCAL}++\x20?(?:\[at\]|\(at\)|\[@\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]++)*+"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
VALUE = r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9!#$%&*+/=?@^_~.-]{6,64}"
GENERATORS = ((NUMBER, None), (HIDDEN, "at"), (ACCOUNT, None), (TOKEN, None), (VALUE, None))
SECRET, CONTACT = r"(secret|token|passw(or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)", r"(phone|tel|call|mobile|cell|fax|ssn|social security|iban|account|passport|contact|write|mail|reach|born)"
OTHER = r"(order|invoice|commit|sha[0-9]*|md5|checksum|hash|version|isbn|issn|page|doi|part|serial|build|revision|rev|item|article|chapter|total|sum|population|in|of|from|no|number|nr|and)"
FEATURES = ("gen", "digits", "groups", "size", "label", "hex", "kinds", "date", "lead", "quoted")
SAMPLES, ROUNDS, RATE, PRECISION, CHUNK = 4000, 30, 0.3, 0.95, 128


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _chunks(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest((F.size(x) - 1) / CHUNK, F.lit(0)).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, CHUNK))


def _spans(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<s, e, m, before, after>> of leftmost non-overlapping matches; before and after: characters beside the match, up to its neighbours."""

    def build(found: Column) -> Column:
        gap = F.split(text, pattern, -1)
        pairs = _let(gap, lambda g: F.transform(found, lambda m, i: F.struct(F.length(g[i]).alias("a"), F.length(m).alias("b"), m.alias("m"), F.right(g[i], F.lit(24)).alias("before"), F.left(g[i + 1], F.lit(2)).alias("after"))))

        def local(chunk):
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>").alias("out"))

            def step(acc, y):
                s = acc["at"] + y["a"]
                e = s + y["b"]
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), y["m"].alias("m"), y["before"].alias("before"), y["after"].alias("after")))).alias("out"))

            return F.aggregate(chunk, zero, step)

        def join(parts):
            zero = F.array(F.lit(0))
            starts = F.aggregate(parts, zero, lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
            moved = lambda p, o: F.transform(p["out"], lambda z: F.struct((z["s"] + o).alias("s"), (z["e"] + o).alias("e"), z["m"].alias("m"), z["before"].alias("before"), z["after"].alias("after")))
            return _let(starts, lambda st: F.flatten(F.transform(parts, lambda p, i: moved(p, st[i]))))

        return _let(pairs, lambda p: _let(F.transform(_chunks(p), local), join))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    got = _let(found, lambda f: F.when(F.size(f) > 0, build(f)).otherwise(none))
    return F.when(F.contains(text, F.lit(needs)), got).otherwise(none) if needs else got


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    one = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda m: F.length(_digits(m))
    return {
        "email": _spans(text, EMAIL, "@"),
        "ip": F.filter(_spans(text, IP, "."), lambda x: x["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter(_spans(text, CARD), lambda x: _luhn(x["m"])),
        "phone": F.filter(_spans(text, PHONE, "+"), lambda x: n(x["m"]).between(8, 15)),
    }


DATE = r"^(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{2,4}|[12][0-9]{3}[\x20]?-[\x20]?[12][0-9]{3})"


def _features(x: Column, gen: int) -> Column:
    m, before = x["m"], F.lower(x["before"])
    digits, bare = F.length(_digits(m)), F.regexp_replace(m, r"^.*[=:][\x20\"']*", "")
    ends = lambda words: rf"(?<![a-z]){words}[^a-z0-9]{{0,6}}$"
    label = F.when(before.rlike(ends(SECRET)), 3).when(before.rlike(ends(CONTACT)), 2).when(before.rlike(ends(OTHER)), 0).otherwise(1)
    kinds = sum(m.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(gen).alias("gen"), F.least(digits, F.lit(20)).alias("digits"), F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(8)).alias("groups"),
        F.least(F.length(bare), F.lit(48)).alias("size"), label.alias("label"), bare.rlike("^[0-9a-fA-F]+$").cast("int").alias("hex"), kinds.alias("kinds"),
        m.rlike(DATE).cast("int").alias("date"), (F.when(m.rlike(r"^[0(]"), 1).when(m.rlike(r"^(?:AKIA|ghp_|gho_|sk[-_]|xox|AIza|eyJ)"), 2).when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 3).when(m.rlike(r"\.[A-Za-z]{2,}$|dot[\])]"), 4).otherwise(0)).alias("lead"),
        F.concat(before, x["after"]).rlike(r"[\"'][a-z0-9]?$").cast("int").alias("quoted"))


def candidates(text: Column) -> Column:
    return F.concat(*(F.transform(_spans(text, p, needs), lambda x, g=g: _features(x, g)) for g, (p, needs) in enumerate(GENERATORS)))


def samples(n: int = SAMPLES) -> list[tuple[str, int]]:
    """Texts made from templates and whether the item in them is personal data or a secret."""
    r = random.Random(20)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mix = lambda k: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k))
    pick = lambda *x: r.choice(x)
    good = (
        lambda: f'{pick("token", "api_key", "secret", "password", "access_key", "auth")}{pick(" = ", "=", ": ")}{pick(chr(34), chr(39), "")}{pick(hexa(32), hexa(40), mix(24), mix(40), hexa(64))}',
        lambda: f'{pick("password", "passwd", "pwd", "secret")}{pick(" = ", "=", ": ")}{mix(r.randint(8, 14))}',
        lambda: f'{pick("AKIA" + mix(16).upper(), "ghp_" + mix(36), "sk-" + mix(32))}',
        lambda: f'{pick("call", "phone", "tel.", "mobile", "fax:")} {pick(f"0{dig(2)} {dig(3)} {dig(4)}", f"({dig(3)}) {dig(3)}-{dig(4)}", f"0{dig(3)}/{dig(7)}", f"{dig(3)}-{dig(3)}-{dig(4)}")}',
        lambda: f'{pick("ssn", "social security", word())} {dig(3)}-{dig(2)}-{dig(4)}',
        lambda: f'{word()}.{word()}{pick(" [at] ", "[at]", " (at) ")}{word()}{pick(".com", ".org", " [dot] net", ".example.com")}',
        lambda: f'{pick("iban", "account", word())} {pick("DE", "FR", "GB", "ES")}{dig(2)} {dig(4)} {dig(4)} {dig(4)} {dig(4)} {dig(2)}',
    )
    bad = (
        lambda: f'{pick("order", "invoice", "item", "serial", "number", "no", word())} {dig(r.randint(7, 19))}',
        lambda: f"{r.randint(1990, 2029)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2029)}",
        lambda: f"{r.randint(1800, 1999)} - {r.randint(2000, 2029)}",
        lambda: f'{pick("commit", "sha256", "md5", "checksum", "revision")}{pick(" ", ": ")}{pick(hexa(40), hexa(32), hexa(64))}',
        lambda: f'{pick("total", "population", "sum of", word())} {dig(1)} {dig(3)} {dig(3)}',
        lambda: f'isbn {pick("978-3", "979-1")}-{dig(4)}-{dig(4)}-{dig(1)}',
        lambda: f'{pick("version", "build")} {dig(1)}.{dig(2)}.{dig(4)}',
        lambda: f"{word()}{dig(4)}-{word()}-{word()}-{word()}",
        lambda: f'see you {pick("(at)", "[at]")} {word()}',
        lambda: " ".join(dig(r.randint(1, 3)) for _ in range(r.randint(3, 9))),
        lambda: f"{word()} {dig(4)} {dig(4)} {dig(4)} {dig(4)}",
        lambda: " ".join([dig(r.randint(6, 16))] * r.randint(2, 9)),
        lambda: dig(r.randint(16, 60)),
    )
    out = []
    for i in range(n):
        y = i % 2
        out.append((f"{' '.join(word() for _ in range(r.randint(0, 6)))} {r.choice(good if y else bad)()}{pick(chr(34), '', '.', ',')} {' '.join(word() for _ in range(r.randint(0, 6)))}", y))
    return out


def _split(rows, grad, at):
    """Best (gain, feature, cut) of the rows ``at`` by first and second derivatives."""
    G, H = (sum(grad[i][j] for i in at) for j in (0, 1))
    best = (1e-9, None, None)
    for k in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for i in at:
            s = by.setdefault(rows[i][0][k], [0.0, 0.0])
            s[0] += grad[i][0]
            s[1] += grad[i][1]
        g = h = 0.0
        for c in sorted(by)[:-1]:
            g, h = g + by[c][0], h + by[c][1]
            gain = g * g / (h + 1) + (G - g) ** 2 / (H - h + 1) - G * G / (H + 1)
            if gain > best[0]:
                best = gain, k, c
    return best


def boost(rows: list[tuple[tuple[int, ...], int, int]]) -> tuple[list, float]:
    """Trees (feature, cut, left, right; a leaf is its value) and bias from (pattern, positives, count)."""
    pos, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
    bias = math.log((pos + 1) / (n - pos + 1))
    score, trees = [bias] * len(rows), []

    def grow(at, grad, depth):
        _, k, c = _split(rows, grad, at) if depth else (0, None, None)
        if k is None:
            return RATE * sum(grad[i][0] for i in at) / (sum(grad[i][1] for i in at) + 1)
        return k, c, grow([i for i in at if rows[i][0][k] <= c], grad, depth - 1), grow([i for i in at if rows[i][0][k] > c], grad, depth - 1)

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-f)) for f in score]
        tree = grow(range(len(rows)), [(r[1] - r[2] * q, r[2] * q * (1 - q)) for r, q in zip(rows, p)], 2)
        trees.append(tree)
        score = [f + value(tree, r[0]) for f, r in zip(score, rows)]
    return trees, bias


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def learn(spark: SparkSession) -> tuple[list, float, float]:
    """Trees, bias and threshold: the least score at which PRECISION of the held-back candidates is right."""
    made = spark.createDataFrame([(t, y, i % 4 > 1) for i, (t, y) in enumerate(samples())], "text string, y int, back boolean")
    got = made.select("y", "back", F.explode(candidates(F.col("text"))).alias("x")).groupBy("back", *(F.col(f"x.{f}").alias(f) for f in FEATURES)).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    rows = {b: sorted((tuple(r[f] for f in FEATURES), r["p"], r["n"]) for r in got if r["back"] == b) for b in (False, True)}
    trees, bias = boost(rows[False])
    hit = total = 0
    threshold = math.inf
    for f, p, n in sorted(((bias + sum(value(t, r[0]) for t in trees), r[1], r[2]) for r in rows[True]), reverse=True):
        hit, total = hit + p, total + n
        if hit >= PRECISION * total:
            threshold = f
    return trees, bias, max(threshold, 0.0) - 1e-9


def _score(x: Column, trees: list, bias: float) -> Column:
    def of(tree):
        return F.when(x[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(tree)

    return sum((of(t) for t in trees), F.lit(bias))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs plus email, ip, card, phone, other: arrays of struct<s, e>, end exclusive."""
    trees, bias, threshold = learn(docs.sparkSession)
    d = without(docs, *KINDS, "other").withColumn("_sv_t", F.coalesce("text", F.lit("")))
    text = F.col("_sv_t")
    plain = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    d = d.withColumns({k: plain(v) for k, v in base_spans(text).items()})
    # Base spans in blocks with their bounds: a candidate looks only into blocks that it reaches.
    bounds = lambda c: F.struct(F.array_min(F.transform(c, lambda z: z["s"])).alias("lo"), F.array_max(F.transform(c, lambda z: z["e"])).alias("hi"), c.alias("c"))
    held = lambda every: F.transform(_chunks(every), bounds)
    on_base = lambda x, h: F.exists(h, lambda b: (b["lo"] < x["e"]) & (x["s"] < b["hi"]) & F.exists(b["c"], lambda z: (z["s"] < x["e"]) & (x["s"] < z["e"])))
    told = F.filter(candidates(text), lambda x: _score(x, trees, bias) >= threshold) if math.isfinite(threshold) else F.array().cast("array<struct<s:int,e:int>>")
    other = _let(F.array_sort(F.array_distinct(plain(told))), lambda o: F.when(F.size(o) == 0, o).otherwise(_let(held(F.array_sort(F.concat(*KINDS))), lambda h: F.filter(o, lambda x: ~on_base(x, h)))))
    return d.withColumn("other", other).drop("_sv_t")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.concat(*map(told, KINDS))
    found = sum((F.size(k) for k in (*KINDS, "other")), F.lit(0)) > 0
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
                    F.concat_ws(",", F.concat(base, told("other"))).alias("spans"), F.size("other").cast("long").alias("n_other"), found.alias("found"))
