"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their
spans always stay.  Narrower and further patterns (card and phone numbers that
a base match has swallowed or that the base rule refuses, access keys and
passwords) give candidates.  Labelers vote on base spans and candidates alike:
a strict form, a checksum, gazetteers, the words before, and what touches the
span.  Counts of vote patterns (a table of bounded size) go to the driver,
where expectation-maximisation estimates each labeler's reliability and a
logistic classifier is trained on the posteriors; it then decides on the
candidates.  All work on texts is in DataFrame functions.

Patterns use possessive groups, which match the same spans here without
recursion or backtracking over long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .fitting import minimise, sigmoid

KINDS = ("email", "ip", "card", "phone", "secret")
# \G: right after a match; else a run of the class has to begin here
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "card": r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "secret": r"A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[oprsu]_[0-9A-Za-z]{36}|(?i:password|passwd|passwort|kennwort|contrase\u00f1a|mot_de_passe|secret|token|api_key|apikey|access_key)\x20?=\x20?\x22?[A-Za-z0-9_/+-]{8,64}\x22?",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*\.[A-Za-z]{2,}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{13,16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$",
    "secret": r"^A[KS]IA|^gh[oprsu]_|[A-Za-z_]=|=\x20?\x22",
}
GAZETTEER = {
    "email": r"\.(?:com|net|org|edu|gov|mil|int|info|biz|name|app|dev|cloud|online|[a-z]{2})$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))",
    "phone": r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1-6]|9[0-8])",
    "secret": r"(?i)^(?:a[ks]ia|gh[oprsu]_|pass|kennwort|contrase|mot_de_passe|secret|token|api_?key|access_key)",
}
PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# words before a span that speak for it or against it, in English, German, French and Spanish
FOR = (
    r"(?i)(?:phone|call|tel|fax|mobile|mail|contact|card|visa|mastercard|credit|server|host|address|login|key|user|account"
    r"|telefon|handy|rufnummer|durchwahl|anruf|kontakt|karte|kredit|konto|rechner|adresse|schl\u00fcssel|benutzer|nutzer"
    r"|t\u00e9l\u00e9phone|t\u00e9l|portable|appel|courriel|m\u00e9l|carte|cr\u00e9dit|compte|serveur|h\u00f4te|cl\u00e9|utilisateur"
    r"|tel\u00e9fono|m\u00f3vil|celular|llamar|correo|contacto|tarjeta|cr\u00e9dito|cuenta|servidor|direcci\u00f3n|clave|usuario)[^\p{L}0-9]*$"
)
AGAINST = (
    r"(?i)(?:version|section|chapter|page|isbn|order|part|figure|table|number|nr|no|v"
    r"|abschnitt|kapitel|seite|bestellung|teil|abbildung|tabelle|nummer"
    r"|chapitre|commande|partie|tableau|num\u00e9ro|n\u00b0|secci\u00f3n|cap\u00edtulo|p\u00e1gina|pedido|parte|figura|tabla|n\u00famero)[^\p{L}0-9]*$"
)
BEFORE = 24
LABELERS = 5
ROUNDS = 50


def _sums(a: Column) -> Column:
    """Exclusive running sums of an array of longs, in pieces of about the root of its length, so that long arrays cost n sqrt(n) at most."""
    step = F.greatest(F.lit(1), F.sqrt(F.size(a)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step).cast("int")), lambda i: F.slice(a, i * step + 1, step))
    empty = F.array().cast("array<bigint>")

    def run(arr: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), empty.alias("a"))
        return F.aggregate(arr, start, lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")))

    local = F.transform(pieces, run)
    bases = run(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc + x))).a
    return F.flatten(F.zip_with(local, bases, lambda p, base: F.transform(p.a, lambda v: v + base)))


def _find(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Adds array ``name`` of the pattern's matches in ``text``: start, end (code points), value, text before and after."""
    none = F.array().cast("array<string>")
    df = df.withColumns({"_m": F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)})
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_n", F.transform("_m", lambda m, i: (F.length(m) + F.length(F.get("_s", i))).cast("long")))
    df = df.withColumn("_p", F.when(F.size("_n") > 0, _sums(F.col("_n"))).otherwise(F.array().cast("array<bigint>")))

    def one(m: Column, i: Column) -> Column:
        start = F.get("_p", i) + F.length(F.get("_s", i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.right(F.get("_s", i), F.lit(BEFORE)).alias("before"), F.left(F.get("_s", i + 1), F.lit(1)).alias("after"))

    return df.withColumn(name, F.transform("_m", one)).drop("_m", "_s", "_n", "_p")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    at = F.sequence(F.lit(1), F.least(F.length(d), F.lit(19)))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.when(F.length(d).between(12, 19), F.aggregate(at, F.lit(0), add) % 10 == 0).otherwise(False)


def _sound(kind: str, v: Column) -> Column:
    """What the base rule asks of a match; for secrets: letters and digits both."""
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(PART))
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.lit(True)


def _votes(kind: str, x: Column) -> list[Column]:
    """1 for, -1 against, 0 abstains: strict form, checksum, gazetteer, words before, what touches the span."""
    yes = lambda c: F.when(c, 1).otherwise(-1)
    touched = F.right(x.before, F.lit(1)).rlike("[A-Za-z0-9]") | x.after.rlike("[A-Za-z0-9]")
    return [
        yes(x.value.rlike(STRICT[kind])),
        yes(_sound(kind, x.value)) if kind != "email" else F.lit(0),
        yes(x.value.rlike(GAZETTEER[kind])),
        F.when(x.before.rlike(FOR), 1).when(x.before.rlike(AGAINST), -1).otherwise(0),
        F.when(touched, -1).otherwise(0),
    ]


def _voted(kind: str, spans: Column) -> Column:
    def one(x: Column) -> Column:
        size = F.length(x.value)
        bucket = F.when(size < 10, 0).when(size < 16, 1).when(size < 24, 2).otherwise(3)
        return F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), x.end.alias("end"), F.array(*_votes(kind, x)).alias("votes"), bucket.alias("bucket"))

    return F.transform(spans, one)


def spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with arrays ``base`` and ``candidates`` of ``(start, ord, end, votes, bucket)`` in the whole text."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    has = lambda s: F.contains("text", F.lit(s))
    digits = F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    gates = {"email": has("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": digits, "phone": has("+")}
    more = {"card": digits, "phone": has("+"), "secret": has("=") | has("AKIA") | has("ASIA") | F.col("text").rlike("gh[oprsu]_")}
    for kind in BASE:
        df = _find(df, f"base_{kind}", BASE[kind], gates[kind])
    for kind in MORE:
        df = _find(df, f"more_{kind}", MORE[kind], more[kind])
    kept = lambda kind: F.filter(f"base_{kind}", lambda x: _sound(kind, x.value))
    base = [_voted(k, kept(k)) for k in BASE]
    found = [_voted(k, F.col(f"more_{k}")) for k in MORE]
    df = df.select("row", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*found)).alias("found"))
    apart = lambda x: ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end))
    return df.select("row", "base", F.when(F.size("found") > 0, F.filter("found", apart)).otherwise(F.col("found")).alias("candidates"))


@dataclass
class Classifier:
    """Weights of the final span classifier: by kind, by labeler and vote (-1, 0, 1), by length bucket."""

    kind: np.ndarray
    vote: np.ndarray
    bucket: np.ndarray
    reliability: np.ndarray

    def column(self, x: Column) -> Column:
        """Log-odds of a span struct."""
        pick = lambda values, at: F.get(F.array(*[F.lit(float(v)) for v in values]), at)
        out = pick(self.kind, x.ord) + pick(self.bucket, x.bucket)
        for i in range(LABELERS):
            out = out + pick(self.vote[i], F.get(x.votes, i) + 1)
        return out


def train(patterns: list[tuple[int, tuple[int, ...], int, int]]) -> Classifier:
    """Fits on counted patterns ``(kind, votes, bucket, count)``: reliabilities by expectation-maximisation, then the classifier."""
    if not patterns:
        return Classifier(np.zeros(len(KINDS)), np.tile([-1.0, 0.0, 1.0], (LABELERS, 1)), np.zeros(4), np.full((LABELERS, 2, 3), 1 / 3))
    kind = np.array([p[0] for p in patterns])
    votes = np.array([p[1] for p in patterns]) + 1
    bucket = np.array([p[2] for p in patterns])
    n = np.array([p[3] for p in patterns], float)
    post = sigmoid((votes - 1).sum(1).astype(float))
    prior = np.full(len(KINDS), 0.5)
    rely = np.zeros((LABELERS, 2, 3))  # labeler, truth, vote
    for _ in range(ROUNDS):
        for j in range(LABELERS):
            for truth, share in ((1, post), (0, 1 - post)):
                c = np.bincount(votes[:, j], n * share, 3) + np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])[truth]
                rely[j, truth] = c / c.sum()
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = ((n * post)[own].sum() + 1) / (n[own].sum() + 2)
        z = np.log(prior / (1 - prior))[kind]
        for j in range(LABELERS):
            z = z + np.log(rely[j, 1] / rely[j, 0])[votes[:, j]]
        post = sigmoid(z)
    x = np.zeros((len(n), len(KINDS) + 3 * LABELERS + 4))
    at = np.arange(len(n))
    x[at, kind] = 1
    for j in range(LABELERS):
        x[at, len(KINDS) + 3 * j + votes[:, j]] = 1
    x[at, len(KINDS) + 3 * LABELERS + bucket] = 1

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        return (n * (np.logaddexp(0, z) - post * z)).sum() + 0.5 * w @ w, x.T @ (n * (sigmoid(z) - post)) + w

    w = minimise(loss, np.zeros(x.shape[1]))
    a, b = len(KINDS), len(KINDS) + 3 * LABELERS
    return Classifier(w[:a], w[a:b].reshape(LABELERS, 3), w[b:], rely)


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans``: arrays of ``(start, ord, end)`` sorted by start, then kind; ends exclusive.

    ``base`` has the spans of the base rules, ``spans`` those and the
    candidates that the classifier accepts; neither accepted candidates of one
    kind overlap (the leftmost stays) nor any of them a base span.  Null and
    empty texts have none; long ones are searched whole.  Rows are judged one by
    one, so repeated rows agree; an empty table gives an empty result.  Columns
    ``keep`` may have any names but base and spans.
    """
    found = cut(spans(docs, keep, text_col))
    both = found.select(F.explode(F.concat("base", "candidates")).alias("x"))
    counted = both.groupBy("x.ord", "x.votes", "x.bucket").count().collect()  # at most kinds x 3^labelers x buckets rows
    model = train(sorted((r.ord, tuple(r.votes), r.bucket, r["count"]) for r in counted))
    slim = lambda x: F.struct(x.start.alias("start"), x.ord.alias("ord"), x.end.alias("end"))
    good = F.filter("candidates", lambda x: model.column(x) >= 0)
    df = found.select("row", F.transform("base", slim).alias("base"), F.transform(good, slim).alias("good"))
    of = lambda k: F.filter("good", lambda x: x.ord == k)
    parts = [of(k) for k in range(len(KINDS))]

    def leftmost(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (x.start >= F.coalesce(F.get(a, i - 1).end, F.lit(0))))

    some = F.concat("base", *[leftmost(p) for p in parts])
    df = df.withColumn("spans", F.array_sort(F.when(F.size("good") > 0, some).otherwise(F.col("base"))))
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "base", "spans")


def as_text(a: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.get(kind, x.ord), x.start.cast("string"), x.end.cast("string"))))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.ord == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
