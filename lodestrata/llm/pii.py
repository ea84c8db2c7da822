"""Operator 7: personal data by patterns, checksums and context words, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh

#: Base kinds in the order of the contract. Possessive forms and look-behinds match what the plain patterns match, leftmost
#: and longest, without their repeated scans of long runs: within a run every start has the same end.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds: account numbers that pass mod 97; national phone numbers and nine-digit identity numbers, which
#: need a context word; keys of published forms, told by their prefixes; and other secrets, which need a context word
#: and a mixture of letters and digits.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "access_key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[opsru]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-]))|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+",
}
KINDS = [*BASE, *ADDED]
#: Kinds of credentials.
SECRETS = ("access_key", "secret")
#: What a text must hold for a pattern to match at all, or to be reported.
NEEDS = {"email": "@", "ip": r"\.", "phone": r"\+", "access_key": "AKIA|ASIA|gh[opsru]_|xox|AIza|PRIVATE KEY", "secret": "(?i)pass|pwd|secret|token|key|credential|bearer|auth"}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|credit|pay|karte|tarjeta|carte",
    "phone": "tel|phone|call|mobile|fax|anruf|llam|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "tel|phone|call|mobile|fax|anruf|llam|appel",
    "ssn": "ssn|social|identity|insurance",
    "access_key": "key|token|secret|access",
    "secret": r"pass(?:word|wd|phrase|code)?\W|pwd\W|secret|token|api.?key|(?:\w{1,16}_)?key\W|credential|bearer|auth",
}
#: Score of a confirmed span, and what a context word within 40 characters before it adds; spans of 0.5 or more are reported.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3, "ssn": 0.4, "access_key": 0.9, "secret": 0.3}
GAIN, LEAST, NEAR = 0.2, 0.5, 40
_BYTE_MAX = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(text, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(rf"^{_BYTE_MAX}(?:\.{_BYTE_MAX}){{3}}$"),
        "card": lambda: n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False),
        "phone": lambda: n.between(9, 15),
        "iban": lambda: mod97(m),
        "local_phone": lambda: F.lit(True),
        "ssn": lambda: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "access_key": lambda: F.lit(True),
        "secret": lambda: m.rlike("[A-Za-z]") & (F.regexp_count(m, F.lit("[0-9]")) >= 2) & (F.size(F.array_distinct(F.split(m, ""))) >= 6),
    }[kind]()


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _place(a: Column, x: Column) -> Column:
    """The next match, after the text before it and what was matched so far."""
    start = a["at"] + F.length(x["g"])
    span = F.struct(start.alias("start"), x["m"].alias("m"), F.right(x["g"], F.lit(NEAR)).alias("g"))
    return F.struct((start + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))


#: Matches that are placed in one go: arrays that grow are never longer, so that work is in proportion to the matches.
_RUN = 256


def _placed(pairs: Column) -> Column:
    """(start, m, g) of each match from the texts between them: run by run, each after the lengths of the runs before."""
    long = lambda n: F.lit(n).cast("long")
    count = lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("long")
    total = lambda run: F.aggregate(run, long(0), lambda n, x: n + count(x))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _RUN).cast("int")), lambda k: F.slice(p, k * _RUN + 1, F.lit(_RUN)))
    grow = lambda a, run: F.struct((a["at"] + total(run)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    starts = lambda runs: F.aggregate(runs, F.struct(long(0).alias("at"), F.array().cast("array<bigint>").alias("out")), grow)["out"]
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<start:bigint,m:string,g:string>>").alias("out"))
    return _let(_let(pairs, cut), lambda runs: F.flatten(F.zip_with(runs, starts(runs), lambda run, at: F.aggregate(run, zero(at), _place)["out"])))


def _check(kind: str):
    return lambda x: _confirmed(kind, x["m"])


def _scored(kind: str, rank: int):
    near = rf"(?:^|[^a-z])(?:{CONTEXT[kind]})"

    def of(x: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(F.lower(x["g"]).rlike(near), GAIN).otherwise(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return of


def pii_spans(docs: DataFrame) -> DataFrame:
    """docs + spans: array of (kind, start, end, score), by start and then kind as listed; positions in code points.

    Candidates of a kind are leftmost and non-overlapping; a candidate that fails its check is dropped, with no retry.
    Where the matches are comes from the texts between them, so that no position is searched twice.
    Null text: like an empty one. All columns of docs stay but one named spans; rows are not moved, so there is no shuffle.
    """
    names = fresh(docs, "__t", *(f"__m_{k}" for k in KINDS), *(f"__s_{k}" for k in KINDS))
    t, match, found = names[0], dict(zip(KINDS, names[1:])), dict(zip(KINDS, names[1 + len(KINDS) :]))
    patterns = BASE | ADDED
    out = docs.withColumn(t, F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    out = out.withColumns({match[k]: F.when(F.col(t).rlike(NEEDS[k]) if k in NEEDS else F.lit(True), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    spans = {}
    for rank, (k, p) in enumerate(patterns.items()):
        m = F.col(match[k])
        pairs = F.filter(F.arrays_zip(F.split(t, F.lit(p), -1).alias("g"), m.alias("m")), lambda x: x["m"].isNotNull())
        kept = F.filter(_placed(pairs), _check(k))
        scored = F.transform(kept, _scored(k, rank))
        empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
        spans[found[k]] = F.when(F.size(m) > 0, scored).otherwise(empty)
    out = out.withColumns(spans)
    return out.withColumn("spans", F.filter(F.array_sort(F.concat(*spans)), lambda s: s["score"] >= LEAST)).drop(*names)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents; see pii_spans. A null text is an empty one, equal rows fare alike; no rows: none."""
    docs = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    secrets = F.size(F.filter("spans", lambda s: s["kind"].isin(*SECRETS))).cast("long")
    return docs.select("doc_id", *map(count, BASE), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), secrets.alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))
