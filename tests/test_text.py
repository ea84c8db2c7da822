"""Scalar functions against tables of cases; the queries' own SQL covers many more."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vectors as V
from lodestrata.functions.analyze import query_lexemes
from lodestrata.functions.stem import stem


def column(spark, expr, *values, schema="a string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(expr).collect()]


def test_split_identifier(spark):
    got = column(spark, T.split_identifier(F.col("a")), "getUserByEmail", "HTTPSProxy", "aB", "f", "", "send-http-request")
    assert got == ["getUserByEmail get User By Email", "HTTPSProxy HTTPS Proxy", "aB", "f", "", "send-http-request send http request"]


def test_language_and_skip(spark):
    got = column(spark, T.language(F.col("a")), "types.pyi", "prod.dockerfile", "LICENSE", "a/Makefile", ".gitignore", "x.CPP")
    assert got == ["Python", "Dockerfile", None, "Makefile", None, "C++"]
    got = column(spark, T.skipped(F.col("a"), F.lit(5)), "src/main.py", "node_modules/a.js", ".git/HEAD", "package-lock.json", "logo.png", "x/uv.lock")
    assert got == [False, True, True, True, True, True]
    assert column(spark, T.skipped(F.lit("a.txt"), F.col("a")), 1048576, 1048577, None, schema="a long") == [False, True, True]


@pytest.mark.parametrize("url, want", [("https://github.com/a/b.git", ("a", "b")), (" https://github.com/a/b/ ", ("a", "b")), ("http://github.com/a/b", None), ("https://github.com/a", None), ("", None)])
def test_url(spark, url, want):
    (got,) = column(spark, T.repo_url(F.col("a")), url)
    assert (tuple(got) if got else None) == want


def test_closing_refs(spark):
    got = column(spark, T.closing_refs(F.col("a"), F.lit("fixes #1")), "closes #3 and #4", "closed-by #99", None, "fix: #" + "9" * 30)
    assert got == [[1, 3], [1], [1], [1]]


def test_texts(spark):
    assert column(spark, T.strip_ws(F.col("a")), "  x\t\n", " ") == ["x", ""]
    assert column(spark, T.unix_newlines(F.col("a")), "a\r\nb\rc") == ["a\nb\nc"]
    assert column(spark, T.commit_title(F.col("a")), "x" * 130 + "\ny") == ["x" * 120]
    assert column(spark, T.iso_time_or_null(F.col("a")), "2024-01-02T03:04:05Z", "soon", None)[1:] == [None, None]
    fts = T.chunk_search_text(F.col("name"), F.col("parent"), F.col("content"), F.lit("Python"))
    row = spark.createDataFrame([("getUser", None, 'def getUser():\n  """Fetch."""')], "name string, parent string, content string").select(*[c.alias(k) for k, c in fts.items()]).first()
    assert row[:2] == ("getUser get User", "Fetch.")


# Words and stems of the algorithm's published sample vocabulary.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri
knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knead knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


def test_stems():
    assert [stem(w) for w in SAMPLE[::2]] == SAMPLE[1::2]
    assert [stem(w) for w in ("generate", "communication", "arsenal", "skies", "news", "inning", "gas", "kiwis", "ties", "cries", "luxuriated", "hopped", "hoping", "boy", "by", "cry", "controll", "é", "x2s")] == ["generat", "communic", "arsenal", "sky", "news", "inning", "gas", "kiwi", "tie", "cri", "luxuri", "hop", "hope", "boy", "by", "cri", "control", "é", "x2s"]
    assert query_lexemes("The hashing of Hashes and hash") == ["hash"]
    assert query_lexemes("do not should now because themselves") == []


def test_stems_as_sql():
    """The stemmer in SQL, a mechanism of its own, on words of every ending and random beginnings."""
    import random

    import duckdb
    import pandas as pd
    from lodestrata.functions import stem as S
    from lodestrata.plans.stem_sql import stem_sql

    rng, ends = random.Random(1), [*S.STEP2, *S.STEP3, *S.STEP4, "ed", "ing", "s", "es", "ies", "ied", "eed", "eedly", "edly", "ingly", "e", "ll", "y", "sses", "us"]
    words = {"".join(rng.choice("aeioubcdglmnprstyxwy") for _ in range(rng.randrange(6))) + "".join(rng.choice(ends) for _ in range(rng.randrange(1, 4))) for _ in range(20_000)}
    table = pd.DataFrame({"word": sorted({*words, *S.SPECIAL, *S.STAY, *SAMPLE})})
    con = duckdb.connect()
    con.register("words", table)
    got = dict(con.sql(f"SELECT * FROM {stem_sql('words')}").fetchall())
    assert got == {w: stem(w) for w in table.word}


def test_hash_embed(spark):
    a, b, c, d = column(spark, V.hash_embed(F.col("a"), 64), "the cat sat", "the cat ran", "", None)
    assert c == d == [1.0] + [0.0] * 63
    assert sum(x * x for x in a) == pytest.approx(1.0)
    assert sum(x * y for x, y in zip(a, b)) > 0.5
    assert column(spark, V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), "x") == [None]
