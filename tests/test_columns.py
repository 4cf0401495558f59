import random
import unicodedata
import re

import pytest
from pyspark.sql import functions as F

from reportmill.functions.checks import balance_check, income_check
from reportmill.functions import numbers
from reportmill.functions.clients import is_private_ip, normalise_ip
from reportmill.functions.numbers import parse_number, parse_value, unit_of
from reportmill.functions.text import company_key, fold, halved_if_doubled, safe_folder, slug, stem_slug, strip
from reportmill.functions.vocab import metric_of
from reportmill.operators.facts import fact_confidence


def one(spark, values, column, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "1245": 1245.0, "1 245": 1245.0, "1 245,50": 1245.5, "1245.50": 1245.5, "1.245,50": 1245.5, "1.245.678": 1245678.0,
        "(125)": -125.0, "(1 245,50)": -1245.5, "-250": -250.0, "- 250": -250.0, "0": 0.0, "": None, "-": None, "—": None, "N/A": None,
        "néant": None, "1 245 (note)": 1245.0, "1 245**": 1245.0, "12,5 %": 12.5, "5 MDH": 5.0, "1,245.50": 1.2455, "1,245,678": 1245678.0,
        "1 245": None, "()": None, "1d": None, "NaN": None, "1e3": 1000.0, "--5": -5.0, "(-5)": -5.0, "3 milliards": 3.0,
    }
    assert one(spark, list(cases), parse_number(F.col("x"))) == list(cases.values())
    assert one(spark, ["1 245,5"], parse_number(F.col("x"), nbsp_as_space=True)) == [1245.5]


def test_printed_numbers_need_no_care(spark, monkeypatch):
    """Units, closing notes and brackets are read at once, to what the rules for any text make of them."""
    rnd = random.Random(2)
    parts = ["", "", "(", "-", " ", "- "], ["1", "12 345", "0", "7,", "3,25", "1.5", ",5", ""], ["", " ", "  "], ["", "MDH", " %", "Dh", "mille"], ["", ")", " )", "*"], ["", " (x)", "(y z) ", " (1)", "(-)", "\n"]
    texts = ["".join(rnd.choice(p) for p in parts) for _ in range(3000)]
    got = one(spark, texts, parse_number(F.col("x")).cast("string"))
    assert got == one(spark, texts, numbers._parse_any(strip(F.col("x"))).cast("string"))
    monkeypatch.setattr(numbers, "_parse_any", lambda x: F.lit(-99.0))
    printed = {"1 245,5": 1245.5, "-12": -12.0, "(1 245,50)": -1245.5, "( -5 kdh ) (note)": -5.0, "12,5 MDH (estimé)": 12.5, "12 %": 12.0, "néant": None, "": None, "1.245": -99.0}
    assert one(spark, list(printed), parse_number(F.col("x"))) == list(printed.values())


def test_units(spark):
    cases = {
        "Montants en MAD": ("MAD", 1.0), "en milliers de dirhams": ("KMAD", 1e3), "En Millions de MAD": ("MMAD", 1e6),
        "milliards": ("BMMAD", 1e9), "total": (None, 1.0), "kdh": ("KMAD", 1e3),
    }
    got = one(spark, list(cases), unit_of(F.col("x")))
    assert [(g["unit"], g["factor"]) for g in got] == list(cases.values())
    assert one(spark, ["mardi 12"], unit_of(F.col("x"))["unit"]) == [None]
    assert one(spark, ["cmda", "amdx"], unit_of(F.col("x"), word_boundary=True)["unit"]) == [None, None]


def test_values(spark):
    got = one(spark, ["1 245", "12,5%", "(500 000)", "", "7 kdh"], parse_value(F.col("x"), F.lit("MMAD")))
    assert [(g["value"], g["unit"], g["factor"], g["is_negative"]) for g in got] == [
        (1245.0, "MMAD", 1e6, False), (12.5, "%", 1.0, False), (-500000.0, "MMAD", 1e6, True), (None, "MMAD", 1e6, False), (7.0, "KMAD", 1e3, False),
    ]
    assert one(spark, ["12"], parse_value(F.col("x"))["confidence"]) == [0.7]


def test_fold_equals_python(spark):
    texts = ["Éléphant  À\tla\ncarte", "ŒUVRE ø ß", "Ａ wide", "ǅ Ḁ ấ", "  x  ", "été"]

    def expected(t):
        ascii_ = unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode()
        return re.sub(r"\s+", " ", ascii_.lower()).strip()

    assert one(spark, texts, fold(F.col("x"))) == [expected(t) for t in texts]


def test_names(spark):
    assert one(spark, ["Banque Centrale Populaire S.A.", "MAROC-TELECOM", "Société Été"], company_key(F.col("x"))) == [
        "centrale populaire s a", "telecom", "societe ete",
    ]
    assert one(spark, ["Wafa / Assurance (2)"], safe_folder(F.col("x"))) == ["WAFA_ASSURANCE_2"]
    assert one(spark, ["  Été & Cie. "], slug(F.col("x"))) == ["ete_cie"]
    assert one(spark, ["a/Rapport 2020.v1.pdf", ".pdf", "___"], stem_slug(F.col("x"))) == ["rapport_2020_v1", "pdf", "rapport"]
    assert one(spark, ["abcdefghijklmnopqrstabcdefghijklmnopqrst", "abab"], halved_if_doubled(F.col("x"))) == ["abcdefghijklmnopqrst", "abab"]


def test_labels(spark):
    cases = {
        "Chiffre d'affaires": "revenue", "Résultat net part du groupe": "net_income_group_share", "Provisions": "income_tax",
        "Total Actif": "total_assets", "quelque chose": None, "Le produit net bancaire consolidé": "net_banking_income",
    }
    assert one(spark, list(cases), metric_of(F.col("x"))) == list(cases.values())
    assert one(spark, ["Provisions"], metric_of(F.col("x"), word_boundary=True)) == [None]


@pytest.mark.parametrize(
    "assets, liabilities, equity, passed, pct",
    [(100.0, 60.0, 40.0, True, 0.0), (100.0, 60.0, 37.0, True, 3.0), (100.0, 60.0, 30.0, False, 10.0), (None, 1.0, 1.0, False, None),
     (0.0, 1.0, 1.0, False, None), (100.0, None, 1.0, False, None), (100.0, None, None, False, None)],
)
def test_balance(spark, assets, liabilities, equity, passed, pct):
    df = spark.createDataFrame([(assets, liabilities, equity)], "a double, l double, e double")
    r = df.select(balance_check(F.col("a"), F.col("l"), F.col("e")).alias("c")).first()["c"]
    assert r["passed"] is passed and r["discrepancy_pct"] == (None if pct is None else pytest.approx(pct))
    assert bool(r["warnings"]) is not passed


def test_income(spark):
    rows = [(100.0, 10.0, 40.0), (100.0, 300.0, None), (100.0, 10.0, 110.0), (None, None, None), (100.0, -20.0, -60.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r double, n double, g double")
    got = df.select("i", income_check(F.col("r"), F.col("n"), F.col("g")).alias("c")).orderBy("i").collect()
    assert [g["c"]["passed"] for g in got] == [True, False, False, True, False]
    assert got[2]["c"]["warnings"] == ["gross_margin=110.0% > 100% — check unit consistency"]


def test_fact_confidence(spark):
    df = spark.createDataFrame([("revenue", 2020, 1.0, "MAD"), ("re", 1900, None, None)], "m string, y int, v double, u string")
    got = [r[0] for r in df.select(fact_confidence(F.col("m"), F.col("y"), F.col("v"), F.col("u"), F.lit(True))).collect()]
    assert got == [1.0, 0.25]


def test_addresses(spark):
    import ipaddress

    texts = ["1.2.3.4", "::ffff:1.2.3.4", "2001:0DB8:0:0:0:0:0:1", "::1", "::", "fe80::1", "10.1.2.3", "172.32.0.1", "300.1.1.1", "abc",
             "1:0:0:2:0:0:0:3", "1:0:3:4:5:6:7:8", "::1:2:3:4:5:6:7", "1::2::3", "64:ff9b::1.2.3.4", "192.0.0.9", "2002::1", ""]

    def norm(t):
        try:
            a = ipaddress.ip_address(t.strip())
        except ValueError:
            return t.strip()
        return str(a.ipv4_mapped) if a.version == 6 and a.ipv4_mapped else str(a)

    def private(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_unspecified

    assert one(spark, texts, normalise_ip(F.col("x"))) == [norm(t) for t in texts]
    assert one(spark, texts, is_private_ip(F.col("x"))) == [private(t) for t in texts]
