"""Quality rules, URL verdicts, template decontamination, quotation and personal data."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from reportmill.llm import decontaminate, pii, quality_rules, quotes, url_filter

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("ab é😀#|\n\t\x0b.") for _ in range(rnd.randrange(200))) for _ in range(150)]
    texts = [None, "", " \n ", "a b c a b c a b", "x x x x", "one\ntwo\none\n\none", "word " * 3000, *odd]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in quality_rules.clean_lines(frame).collect():
        n, *rest = counts(texts[r["id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_quality_lines(spark):
    rnd = random.Random(2)
    prose = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(80)) + "."
    menu = " | ".join(f"Link{i}" for i in range(30))
    shout = " ".join(f"LOUD{i}!!" for i in range(120))
    rows = [(1, f"{prose}\nAll rights reserved.\n{menu}"), (2, f"{prose}\n{shout}"), (3, menu), (4, prose), (4, prose)]
    got = {r["id"]: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == prose and got[1]["kept_lines"] == 1
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[2]["cleaned"] == prose
    assert not got[3]["kept"] and got[4]["kept"]
    extra = spark.createDataFrame([(1, prose, "x", 3)], "doc_id long, text string, parts string, n_words int")
    assert quality_rules.clean_lines(extra).count() == 1 and quality_rules.clean_lines(extra.limit(0)).count() == 0


def test_url_verdicts(spark):
    urls = [
        None, "no scheme.com/en/", "http://EXAMPLE.com/en/1?x=/en/#y", "https://www.example.com/en/2", "http://m.example.com/en/3", "http://a.net/es/1",
        "http://net/fr/", "http://notnet/es/", "http://x.org/Bad/page.html?utm=1", "https://www.x.org/Bad/page/", "http://x.org/good", "http://example.com", "ftp://example.com#/en/", "http://é.org/",
    ]
    listed = spark.createDataFrame([("http://x.org/Bad/page",), ("http://x.org/Bad/page",), (None,), ("nothing",)], "url string")
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", url_filter.F.lit("own"))
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(frame, listed).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[3] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("net/es/", "block") and got[6][2:] == ("net/fr/", "block")
    assert got[7] == ("notnet", "/es/", None, "allow")
    assert got[8][2:] == got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    assert got[11] == ("example.com", "", None, "allow") and got[12] == ("example.com", "", None, "allow")
    assert url_filter.judge(frame.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(frame.filter("page_id in (8, 10)"), listed.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    bits = url_filter.build_filter(keys, "key")
    hashes = keys.selectExpr("xxhash64(key) as h").toPandas()["h"].to_numpy()
    others = spark.range(3000, 23000).selectExpr("xxhash64(concat('k', id)) as h").toPandas()["h"].to_numpy()
    assert url_filter.may_hold(bits, hashes).all()
    assert url_filter.may_hold(bits, others).mean() < 0.05


def windows(text, n=8):
    words = [re.sub(r"[\"'“”‘’«»()\[\]{}.,;:!?…]", "", w.lower()) for w in WORD.findall(text or "")]
    words = [w for w in words if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_plain_leaks_match_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(9, 40))).capitalize() + ".") for k in range(20)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            at = rnd.randrange(len(text) + 1)
            text[at:at] = items[rnd.randrange(20)][1].split()
        rows.append((i, " ".join(text)))
    got = {(r["id"], r["item"]) for r in decontaminate.matches(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, t in rows for k, q in items if 2 * len(windows(q) & windows(t)) >= len(windows(q))}
    assert got == want and want


def test_templates_and_slots(spark):
    items = [
        (1, "A shop sells 12 apples and 12 pears to Anna for 30 dollars on one day, how many fruits are sold in the shop?"),
        (2, "Where is Rome?"), (3, None), (4, ""), (5, "12 13 14 15 16 17 18 19 20"), (1, "A shop sells 12 apples and 12 pears to Anna for 30 dollars on one day, how many fruits are sold in the shop?"),
    ]
    rows = [
        (1, "Look: a shop sells 7 apples and 7 pears to Bert for 45 dollars on one day, how many fruits are sold in the shop? Right."),
        (2, "Look: a shop sells 7 apples and 8 pears to Bert for 45 dollars on one day, how many fruits are sold in the shop? Right."),
        (3, "We ask where is Rome, and go."), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9"), (None, items[0][1]), (7, items[0][1]), (7, items[0][1]),
        (8, "a shop sells apples and pears to people on every day of a long week"),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item", decontaminate.F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): r["changed"] for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (7, 1), (3, 2)} and got[7, 1] == 0 and got[1, 1] > 0
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 4, 5, 6, 8]
    assert decontaminate.matches(docs, bench.limit(0)).count() == decontaminate.matches(docs.limit(0), bench).count() == 0


def test_threads(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you?\nSecond line."), (1, 1, "assistant", "On Monday X wrote:\n> Hello there, how are you?\nFine.\n"),
        (1, 2, "user", "> > Hello there, how are you?\n> Fine.\nGood to hear"), (1, 3, "user", "unrelated"), (1, 4, "a", "> Second line.\n> nothing known\nans"),
        (1, 5, "a", ">> Fine.\nok"), (2, 0, "user", None), (None, 0, "user", "> x"), (2, None, None, "x"), (1, 3, "user", "unrelated"), (3, 1, "u", "> self\nself"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("root", quotes.F.lit("own"))
    got = {(r["conv"], r["turn"]): r for r in quotes.thread(frame).collect()}
    told = {k: (r["parent"], r["root"], r["position"], r["text"], r["quote_depth"]) for k, r in got.items()}
    assert told[1, 0] == (None, 0, 1, "Hello there, how are you?\nSecond line.", 0)
    assert told[1, 1] == (0, 0, 2, "Fine.", 1) and told[1, 2] == (1, 0, 3, "Good to hear", 2)
    assert told[1, 4] == (0, 0, 4, "ans", 1) and told[1, 5] == (1, 0, 5, "ok", 2) and told[1, 3][:3] == (None, 3, 6) or told[1, 3][2] == 7
    assert told[2, 0] == (None, 0, 1, "", 0) and told[None, 0][:3] == told[2, None][:3] == (None, None, None)
    assert told[3, 1][:2] == (None, 1)
    assert quotes.thread(frame).count() == len(rows) and quotes.thread(frame.limit(0)).count() == 0


def test_long_chain_of_answers(spark):
    rows = [(1, i, "u", (f"> line number {i - 1}\n" if i else "") + f"line number {i}") for i in range(70)]
    got = quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["root"] for r in got} == {0} and sorted(r["position"] for r in got) == list(range(1, 71))


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            holds = {
                "email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if holds:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def pii_texts():
    rnd = random.Random(6)
    parts = ["a@b.c", "%x@d.e", "@", ".", "1.2.3.4", "4041894974608795", "4041 8949-7460 8795", "+1 (988) 555-2485", "+", " ", "-", "(", "12", "0000", "é", "😀", "256", "x", "\n", "a.b@c-d.e.f"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))) for _ in range(250)] + [
        None, "", "a@b.c%x@d.e", "1" * 30000, "a" * 30000 + "@b.c", "1.2.3.4 " * 2000, "0001.2.3.255 256.1.1.1 1.2.3.4.5.6.7.8",
    ]


def test_personal_data_matches_brute_force(spark):
    texts = pii_texts()
    for r in pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base(texts[r["doc_id"]])
        assert all(not (b["start"] < t["end"] and t["start"] < b["end"]) for t in r["terms"] for b in r["base"])


def test_digest_and_replacement(spark):
    text = "😀 write to a.b@mail.com or call +1 (988) 555-2485, from 1.2.3.4"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "plain")], DOCS)
    got = {r["doc_id"]: r for r in pii.find(frame).select("doc_id", pii.listed(pii.F.col("base")).alias("b")).collect()}
    assert got[1]["b"] == "email:11:23,phone:32:49,ip:56:63"
    assert hashlib.sha256(got[3]["b"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert clean == {1: "😀 write to [EMAIL] or call [PHONE], from [IP]", 2: None, 3: "plain"}
    clash = frame.withColumn("base", pii.F.lit(1)).withColumn("_key", pii.F.lit(2)).withColumn("n_chars", pii.F.lit(9))
    rows = pii.sanitise(clash, length_col="n_chars")
    assert rows.columns == clash.columns and {r["doc_id"]: r["n_chars"] for r in rows.collect()} == {1: len(clean[1]), 2: 9, 3: 9}
    assert pii.sanitise(frame.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_terms_that_disclose(spark, copies):
    rows = [(i, f"common words stand here number{i} all over the place again") for i in range(60)]
    for i in range(3):
        same = 0 if copies else i
        rows.append((100 + i, f"the common filler{same} words zanzibar jo@x.org stand here other{same}"))
    got = [(r["doc_id"], t["value"]) for r in pii.find(spark.createDataFrame(rows, DOCS)).collect() for t in r["terms"]]
    assert sorted(got) == ([] if copies else [(100 + i, "zanzibar") for i in range(3)])


PUNCTUATION = str.maketrans("", "", "\"'“”‘’«»()[]{}.,;:!?…")


def term_of(word):
    return word.lower().translate(PUNCTUATION)


def people_of(text):
    return {(k, re.sub(r"[+ ().-]", "", text[a:b]) if k >= 2 else text[a:b].lower()) for a, k, b in base(text)}


def telling(docs):
    """{(term, entity): disclosure} from plain counts over (id, text)."""
    docs = [(k, t or "") for k, t in docs]
    size, said = len(docs), Counter(t for _, text in docs for t in {term_of(w) for w in WORD.findall(text)} if t)
    entities, both = {}, {}
    for _, text in docs:
        rest, at = "", 0
        for a, b in sorted((a, b) for a, _, b in base(text)):
            rest += text[at : max(a, at)] + " "
            at = max(at, b)
        own = {term_of(w) for w in WORD.findall(rest + text[at:])} - {""}
        for e in people_of(text):
            entities.setdefault(e, []).append(text)
            for t in own:
                both.setdefault((t, e), []).append(text)
    out = {}
    for (t, e), texts in both.items():
        n = len(entities[e])
        if len(set(texts)) > 1 and size > n:
            share = math.log(len(texts) * size / (said[t] * n)) / math.log(size / n)
            if share >= pii.GENERALISE_AT - 1e-9:
                out[t, e] = share
    return out


def telling_spans(text, pairs):
    spans, here = base(text or ""), people_of(text or "")
    told = {t for (t, e), x in pairs.items() if e in here or x >= pii.REMOVE_AT}
    words = [(m.start(), m.end(), term_of(m[0])) for m in WORD.finditer(text or "")]
    return [(a, b, t) for a, b, t in words if t in told and not any(x < b and a < y for x, _, y in spans)]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_terms_against_plain_counts(spark, monkeypatch, sent):
    """All occurrences of a term count and go, however far from the entity; the clearest go from all texts."""
    monkeypatch.setattr(pii, "MAX_SENT", sent)
    rnd = random.Random(9)
    common = [f"w{chr(97 + i % 26)}{i}" for i in range(40)]
    prose = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    people = {"ann@x.org": "Harbour", "+44 20 7946 0958": "Violin,", "10.1.2.3": "Çedille!", "bob@y.org": "harbour"}
    rows = [(i, prose(rnd.randrange(5, 60))) for i in range(80)]
    for i in range(24):
        who = rnd.choice(list(people))
        rows.append((100 + i, f"{who} {prose(40)}\n{people[who]} {prose(5)}" + (f" {rnd.choice(list(people))}" if i % 5 == 0 else "")))
    rows += [(198, "çedille w w"), (199, "çedille x"), (200, "the harbour of violin makers"), (201, None), (202, ""), rows[-1], rows[-1], (203, rows[-2][1]), (None, rows[-3][1])]
    frame = spark.createDataFrame(rows, DOCS).withColumn("_told", pii.F.lit(1)).withColumn("entities", pii.F.lit("x"))
    told = telling(rows)
    assert {"harbour", "violin", "çedille"} <= {t for t, _ in told}
    got = pii.telling_terms(frame)[0].collect()
    assert sorted((r["term"], round(r["disclosure"], 9)) for r in got) == sorted((t, round(x, 9)) for (t, _), x in told.items())
    found = pii.find(frame).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        assert [(t["start"], t["end"], t["value"]) for t in r["terms"]] == telling_spans(texts[r["doc_id"]], told)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    strong = {t for (t, _), x in told.items() if x >= pii.REMOVE_AT}
    assert strong and all((t in clean[200]) == (t not in strong) for t in ("harbour", "violin")) and clean[201] is None
    assert pii.telling_terms(frame.limit(0))[0].count() == 0


def test_questions_with_other_names_and_numbers(spark):
    """Names that start sentences, names of two words, lower case, and items that are mostly numbers."""
    apples = "Anna has 12 apples in her basket. Ben gives Anna 7 more apples from his garden. How many apples does Anna have in all now?"
    train = "A train leaves the station of Boston at noon and travels 90 miles towards Denver before it turns back to Boston for the night in the depot."
    counted = "Compute 3 4 5 6 7 8 9 10 11 12 13 14 then sum."
    items = [(1, apples), (2, train), (3, counted)]
    texts = [
        apples.replace("Anna", "Maria").replace("Ben", "Tom").replace("12", "31").replace("7", "9"),
        train.replace("Boston", "New York").replace("Denver", "Los Angeles").replace("90", "75"),
        train.replace("90", "75").lower(),
        f"Some words before. {counted} Some words after it.",
        "Compute 4 5 6 7 8 9 10 11 12 13 14 15 then sum.",
        "Anna has no time today. Ben gives a talk about apples from his garden and how many of them there are now.",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(list(enumerate(texts)), DOCS), bench).collect()
    got = {(r["id"], r["item"]): r["changed"] > 0 for r in found}
    assert {k for k in got if k[0] != 4} == {(0, 1), (1, 2), (2, 2), (3, 3)} and got[0, 1] and got[1, 2] and got[2, 2] and not got[3, 3]
