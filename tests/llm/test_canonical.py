from chainloom.llm.canonical import match_values, number_in, tokens_of

CATALOG = [(1, "sql_injection", ["sqli", "sql command tampering"]), (2, "xss", ["cross site scripting"]), (3, "command_injection", ["shell injection"]), (4, "weak_hash", None), (5, "log_forging", [None, ""]), (6, "dot_dot_slash", [])]


def match(spark, *values):
    reference = spark.createDataFrame([(*c, "x") for c in CATALOG], "entry_id int, label string, aliases array<string>, value string")
    df = spark.createDataFrame([(v,) for v in values], "label string")
    return {r.value: r.entry for r in match_values(df, "label", reference, "entry_id", "label", "aliases").collect()}


def test_spellings(spark):
    same = ["SQL-Injection", "sql  injecton", "sq\u00adl injection", "ｓｑｌ＿ｉｎｊｅｃｔｉｏｎ", "possible sql_injection", "injection / sql (stored)", "sqlinjection!!", "sql inj.", "sql c0mmand tampering", "sqlcommtamp", "[HIGH] SQLi", "sql injеction"]
    assert match(spark, *same, *same) == dict.fromkeys(same, 1)
    assert match(spark, "Cross Site Scriptng", "weeak hah", "dott dot slash") == {"Cross Site Scriptng": 2, "weeak hah": 4, "dott dot slash": 6}


def test_unmatched(spark):
    assert match(spark, "injection", "slow page", "n/a", "???", "", None, "see ticket 123", "weak", "123") == {}
    assert match(spark) == {}


def test_numbers(spark):
    df = spark.createDataFrame([("CWE-079",), ("#89",), ("n/a",), ("CWE–22: see list",), (None,), ("9" * 40,)], "c string")
    assert [r[0] for r in df.select(number_in(df.c)).collect()] == [79, 89, None, 22, None, None]


def test_tokens():
    assert tokens_of("Likely Zíp_slip [HIGH] in DA0 layer") == ["likely", "zip", "slip", "in", "dao", "layer"]
    assert tokens_of("Zip (slip)", remarks=True) == ["zip", "slip"]


def test_long_names_and_free_words(spark):
    """A name of 40 letters in one word is met with three edits; words around a name cost little when many have them."""
    name = "supercalifragilisticexpialidociousnessxx"
    reference = spark.createDataFrame([(1, name), (2, "sql injection"), (3, "xss")], "entry_id int, label string")
    wrong = [name[:12] + "q" + name[13:], name[:5] + name[6:20] + "zz" + name[20:], "x" + name[1:30] + name[31:39]]
    around = [f"{w} {n} in any place" for w in ("surely", "maybe", "odd") for n in ("xss", "sql injecton", "other thing", "more", "text")]
    df = spark.createDataFrame([(v,) for v in [*wrong, *around]], "label string")
    got = {r.value: r.entry for r in match_values(df, "label", reference, "entry_id", "label").collect()}
    assert got == dict.fromkeys(wrong, 1) | {v: 3 if "xss" in v else 2 for v in around if "xss" in v or "sql" in v}
