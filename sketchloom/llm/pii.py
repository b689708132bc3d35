"""PII (4): candidate gradient boosting. DataFrame functions only.

Four exact patterns give the base spans. High-recall generators then propose further,
overlapping spans (one stretch may be proposed as several kinds); boosted trees over
format and context features score them and a threshold for each kind, calibrated on a
held-out fold, selects those to add. Trees are compiled into column expressions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .common import once, read, rowed, running, unrowed, upper_bound

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Each starts where a run of its first characters starts or where the last
#: match ended, and takes runs whole: the matches are those of the plain pattern, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators of the candidates: written-out addresses, and any run of digits with separators,
#: whole and in each sub-run of its groups with the digits of a card or a phone.
MAIL_LIKE = r"(?:\G|(?<![\w.%+-]))[\w.%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\w-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]++)++"
DIGITS_LIKE = r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9])++"
FEATURES = ("kind", "digits", "chars", "dots", "blanks", "hyphens", "parens", "plus", "luhn", "parts", "before", "after", "ctx_card", "ctx_phone", "ctx_net", "groups", "alphas", "slashes", "left", "right")
_CONTEXT = {"ctx_card": "card|visa|credit|cc:", "ctx_phone": "tel|phone|call|fax|mobile|whatsapp", "ctx_net": "\\bip\\b|addr|host|mail"}
#: Snippets that the trees are fitted on; the last fifth sets the thresholds.
SNIPPETS, PRECISION, SEED = 4_000, 0.995, 4
#: A group with the separators after it (a parenthesis before digits goes with them), and the most digits of a candidate.
GROUP, LONGEST = r"[+(]?[0-9]++[\x20().:/-]{0,2}?(?=\(?[0-9]|$)", 19
#: Code points of a chunk: a substring is found from its string's start, so contexts are cut from short chunks.
CHUNK = 128


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array of (s, e, m): code points from, to (exclusive), the match; in linear time."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("rest"))
    size = lambda x: F.char_length(x)

    def placed(x: Column) -> Column:
        gaps = F.transform(x["m"], lambda m, i: size(F.get(x["rest"], i)) + size(m))
        spot = lambda before: F.transform(x["m"], lambda m, i: once(F.get(before, i) + size(F.get(x["rest"], i)), lambda a: F.struct(a.cast("long").alias("s"), (a + size(m)).cast("long").alias("e"), m.alias("m"))))
        return F.when(F.size(x["m"]) > 0, once(running(gaps), spot))

    return once(both, placed)


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, many: Column | int) -> Column:
    """`many` code points, CHUNK at most, from `start` (from 0) on."""
    at = F.floor(start / CHUNK).cast("int")
    near = F.concat(F.get(chunks, at), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substring(F.coalesce(near, F.lit("")), (start % CHUNK + 1).cast("int"), many if isinstance(many, Column) else F.lit(many))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    d = digits_of(m)
    n = F.char_length(d)

    def one(a: Column, i: Column) -> Column:
        x = F.ascii(F.substring(d, i, F.lit(1))) - 48
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return a + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), one) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(digits_of(m))
    return {"email": F.lit(True), "ip": m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "card": n.between(12, 19) & luhn(m), "phone": n.between(9, 15)}[kind]


def _valid_match(kind: str):
    return lambda x: _valid(kind, x["m"])


_NONE = "array<struct<s:bigint,e:bigint,m:string>>"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row (docs as a struct), _text (null as empty) and for each kind its base spans in _<kind>, each (s, e, m)."""
    out = rowed(docs, _text=F.coalesce(F.col(text), F.lit("")))
    t = F.col("_text")
    gate = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.contains("+")}
    for k in KINDS:
        out = out.withColumn(f"_{k}", F.when(gate[k], found(t, BASE[k])))
    for k in KINDS:
        out = out.withColumn(f"_{k}", F.coalesce(F.filter(F.col(f"_{k}"), _valid_match(k)), F.array().cast(_NONE)))
    return out


def sub_runs(runs: Column) -> Column:
    """(s, e, m) of every sub-run of consecutive groups with 4 to LONGEST digits of each run.

    A sub-run starts at its first group's plus or parenthesis and ends at its last digit.
    """

    def of_run(x: Column) -> Column:
        placed = lambda g: once(running(F.transform(g, lambda y: F.char_length(y))), lambda p: F.zip_with(g, p, lambda m, s: F.struct(m.alias("m"), s.alias("s"))))
        at = once(F.regexp_extract_all(x["m"], F.lit(GROUP), F.lit(0)), placed)

        def sub(groups: Column) -> Column:
            def upto(some: Column) -> Column:
                m = F.regexp_replace(F.array_join(F.transform(some, lambda g: g["m"]), ""), r"[^0-9]+$", "")
                s = x["s"] + F.get(some, 0)["s"]
                return once(m, lambda m: F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m")))

            def from_group(_: Column, i: Column) -> Column:
                near = lambda some: F.transform(F.sequence(F.lit(1), F.size(some)), lambda j: upto(F.slice(some, F.lit(1), j)))
                return once(F.slice(groups, i + 1, F.lit(LONGEST)), near)

            return F.filter(F.flatten(F.transform(groups, from_group)), lambda y: F.char_length(digits_of(y["m"])).between(4, LONGEST))

        return once(at, sub)

    return F.flatten(F.transform(runs, of_run))


def with_candidates(docs: DataFrame) -> DataFrame:
    """with_base() rows and _candidates: (s, e, kind, x), x being the features."""
    t = F.col("_text")
    at = t.contains("@") | t.rlike(r"(?i)[\[(]at[\])]")
    out = docs.withColumn("_mails", F.when(at, found(t, "(?i)" + MAIL_LIKE))).withColumn("_digits", F.when(t.rlike("[0-9]"), found(t, DIGITS_LIKE)))
    for c in ("_mails", "_digits"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(_NONE)))
    out = out.withColumn("_digits", sub_runs(F.col("_digits")))
    as_kind = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(KINDS.index(k)).alias("kind"))
    n = lambda x: F.char_length(digits_of(x["m"]))
    proposed = F.concat(
        F.transform("_mails", as_kind("email")),
        F.transform(F.filter("_digits", lambda x: x["m"].rlike(r"^[0-9]+(\.[0-9]+){3}$")), as_kind("ip")),
        F.transform(F.filter("_digits", lambda x: n(x).between(12, 19)), as_kind("card")),
        F.transform(F.filter("_digits", lambda x: n(x).between(7, 15)), as_kind("phone")),
    )
    count = lambda m, c: (F.char_length(m) - F.char_length(F.translate(m, c, ""))).cast("double")
    chunks = F.col("_chunks")

    def features(x: Column) -> Column:
        m, s = x["m"], x["s"].cast("int")
        around = lambda c: F.when(c == "", 0.0).when(c.rlike(r"[\s]"), 0.0).when(c.rlike(r"[\p{L}]"), 2.0).when(c.rlike("[0-9]"), 3.0).otherwise(1.0)
        before = F.when(s > 0, cut(chunks, s - 1, 1)).otherwise("")
        window = F.lower(cut(chunks, F.greatest(s - 24, F.lit(0)), F.least(F.lit(24), s)))
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        # digits that stand next: 2 after a separator other than a blank, 1 after a blank
        joined = lambda c, blank, other: F.when(c.rlike(blank), 1.0).when(c.rlike(other), 2.0).otherwise(0.0)
        left, right = cut(chunks, F.greatest(s - 2, F.lit(0)), F.least(F.lit(2), s)), cut(chunks, x["e"].cast("int"), 3)
        values = {
            "kind": x["kind"].cast("double"), "digits": F.char_length(digits_of(m)).cast("double"), "chars": F.char_length(m).cast("double"), "dots": count(m, "."), "blanks": count(m, " "), "hyphens": count(m, "-"),
            "parens": count(m, "()"), "plus": flag(m.startswith("+")), "luhn": flag(F.when(x["kind"] == 2, luhn(m)).otherwise(False)), "parts": flag(m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
            "before": around(before), "after": around(cut(chunks, x["e"].cast("int"), 1)), **{k: flag(window.rlike(p)) for k, p in _CONTEXT.items()},
            "groups": F.size(F.split(m, "[^0-9]+")).cast("double"), "alphas": F.char_length(F.regexp_replace(m, r"[^\p{L}]", "")).cast("double"), "slashes": count(m, "/:"),
            "left": joined(left, r"[0-9]\x20$", r"[0-9][().:/-]$|\)\x20$"), "right": joined(right, r"^\x20\(?[0-9]", r"^[().:/-]\x20?[0-9]"),
        }
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.array(*[values[f] for f in FEATURES]).alias("x"))

    out = out.withColumn("_candidates", proposed)
    out = out.withColumn("_chunks", F.when(F.size("_candidates") > 0, chunked(t)))
    return out.withColumn("_candidates", F.transform("_candidates", features))


def snippets(n: int = SNIPPETS, seed: int = SEED) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(number, text, (start, end, kind) of each) of made-up lines: personal data in usual formats and numbers that are none, alone or side by side."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(valid: bool) -> str:
        d = digits(15)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(d))
        last = (-total) % 10
        d += str(last if valid else (last + r.randint(1, 9)) % 10)
        sep = r.choice(["", "", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"{a}/{b}-{c}"])

    def ip(top: int) -> str:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        if top > 255:
            parts[r.randint(0, 3)] = str(r.randint(256, top))
        return ".".join(parts)

    mail = lambda: word() + r.choice(["", ".", "_", "."]) + r.choice(["", digits(2)]) + r.choice(["@", "@", " (at) ", "[at]", " @ "]) + word() + r.choice([".", ".", " (dot) ", "[dot]"]) + r.choice(["com", "org", "net", "de"])
    none = [lambda: card(False), lambda: digits(r.randint(8, 19)), lambda: ip(999), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)} {digits(2)}:{digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}.{digits(4)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(3)}.{digits(5)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)} {digits(4)}"]
    lead = {"email": ["mail", "write to", "contact"], "ip": ["host", "ip", "from"], "card": ["card", "visa", "paid by"], "phone": ["tel", "call", "phone"]}
    out = []
    for i in range(n):
        k = r.randint(-len(KINDS), len(KINDS) - 1)
        body = [mail, lambda: ip(255), lambda: card(True), phone][k]() if k >= 0 else r.choice(none)()
        context = r.choice(lead[KINDS[k]]) if k >= 0 and r.random() < 0.4 else word()
        text = " ".join([*(word() for _ in range(r.randint(0, 6))), context, ""])
        own = []
        for at in range(r.choice([1, 1, 1, 2, 3])):  # the others stand beside it
            if at:
                k = r.randint(-len(KINDS), len(KINDS) - 1)
                body, text = [mail, lambda: ip(255), lambda: card(True), phone][k]() if k >= 0 else r.choice(none)(), text + " "
            if k >= 0:
                own.append((len(text), len(text) + len(body), k))
            text += body
        out.append((i, text + r.choice(["", ".", ",", "!!"]) + " " + word(), own))
    return out


def train(spark: SparkSession, n: int = SNIPPETS) -> tuple[boost.Trees, list[float]]:
    """Trees and a threshold for each kind: the least score with PRECISION on the held-out fifth."""
    made = snippets(n)
    rows = with_candidates(with_base(spark.createDataFrame(made, "i int, text string, own array<struct<a:bigint,b:bigint,k:int>>")))
    own = F.col("_row.own")
    is_one = F.exists(own, lambda o: (F.col("c.s") == o["a"]) & (F.col("c.e") == o["b"]) & (F.col("c.kind") == o["k"]))
    # an outer explode: for a plain one the planner would infer a filter and compute the candidates twice
    got = rows.select("_row", F.explode_outer("_candidates").alias("c")).where("c is not null").select("_row.i", F.when(is_one, 1).otherwise(0), "c.x", "c.kind", F.col("c.s"), F.col("c.e")).collect()
    got = sorted((r[0], r[3], r[4], r[5], r[1], list(r[2])) for r in got)
    x, y, i, kind = np.array([r[5] for r in got]), np.array([r[4] for r in got], float), np.array([r[0] for r in got]), np.array([r[1] for r in got])
    late = i >= 0.8 * n
    model = boost.fit(x[~late], y[~late], trees=30, depth=4, rate=0.3, bins=32)
    score, cuts = model.raw(x[late]), []
    for k in range(len(KINDS)):
        own = kind[late] == k
        order = np.argsort(-score[own])
        good = np.cumsum(y[late][own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(good >= PRECISION)
        cuts.append(max(0.0, float(score[own][order][ok[-1]])) if len(ok) else np.inf)
    return model, cuts


def compiled(model: boost.Trees, x: Column) -> Column:
    """The log-odds of a feature array as a column."""
    inner = 2**model.depth - 1

    def node(f, c, v, i: int) -> Column:
        if i >= inner:
            return F.lit(float(v[i - inner]))
        if not np.isfinite(c[i]):
            return node(f, c, v, 2 * i + 1)
        return F.when(F.get(x, F.lit(int(f[i]))) <= F.lit(float(c[i])), node(f, c, v, 2 * i + 1)).otherwise(node(f, c, v, 2 * i + 2))

    total = F.lit(float(model.base))
    for f, c, v in zip(model.feature, model.cut, model.value):
        total = total + node(f, c, v, 0)
    return total


def spans(docs: DataFrame, model: tuple[boost.Trees, list[float]] | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base and spans.

    base and spans are arrays of (start, end, kind) in code points, by start, then kind as
    listed; spans holds the base and what the trees add away from it. A null or empty text
    has none. Repeated rows are searched each. Columns of docs with a name of the result's
    are replaced.
    """
    model, cuts = model or train(docs.sparkSession)
    rows = with_candidates(with_base(docs))
    numbered = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))
    base = F.concat(*[F.transform(f"_{k}", numbered(i)) for i, k in enumerate(KINDS)])
    rows = rows.withColumn("_base", F.array_sort(base)).withColumn("_scored", F.transform("_candidates", lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("k"), c["e"].alias("e"), compiled(model, c["x"]).alias("z"))))
    bar = lambda k: F.get(F.array(*[F.lit(float(c)) for c in cuts]), k)
    # spans of one kind lie one after another: only the last that starts before a candidate's end can meet it
    meets = lambda own, c: once(upper_bound(own, lambda b: b["s"] < c["e"]), lambda n: (n > 0) & (F.get(own, n - 1)["e"] > c["s"]))
    free = lambda c: ~(meets(F.col("_email"), c) | meets(F.col("_ip"), c) | meets(F.col("_card"), c) | meets(F.col("_phone"), c))
    added = F.filter("_scored", lambda c: (c["z"] >= bar(c["k"])) & free(c))
    rows = rows.withColumn("_added", F.transform(added, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    named = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]).alias("kind")))
    every = F.when(F.size("_added") == 0, F.col("_base")).otherwise(F.array_sort(F.concat("_base", "_added")))
    new = ["n_" + k for k in KINDS] + ["base", "spans"]
    return rows.select(*unrowed([c for c in docs.columns if c not in new]), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], named(F.col("_base")).alias("base"), named(every).alias("spans"))


def digest(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_candidate_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
