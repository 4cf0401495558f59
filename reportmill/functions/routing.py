"""Question routing and query understanding as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, YEAR_PATTERN, ascii_lower, const_array, const_rows, fold, let, years_in

# Words that count towards each route (already without accents).
SQL_WORDS = (
    "resultat net", "benefice net",
    "chiffre d'affaires", "chiffre d affaires", "ca",
    "total actif", "total bilan", "total passif",
    "capitaux propres", "fonds propres",
    "ebitda", "ebe", "pnb", "produit net bancaire",
    "resultat d exploitation",
    "dettes financieres",
    "tresorerie",
    "actif total", "passif total",
    "resultat financier",
    "marge brute", "resultat brut",
    "free cash flow", "flux de tresorerie",
    "compare", "comparer", "comparaison", "evolution",
    "variation", "croissance", "progression", "hausse", "baisse",
    "entre 20", "de 20", "en 20",
    "quel est", "quelle est", "combien", "montant", "valeur",
    "chiffre", "donnees", "statistique",
    "roe", "roa", "roce", "marge", "ratio", "coefficient",
    "actionnaire", "participation", "capital", "structure",
)
VECTOR_WORDS = (
    "risque", "risques", "risk",
    "strategie", "strategy",
    "perspective", "perspectives", "outlook",
    "gouvernance", "governance",
    "responsabilite", "rse",
    "developpement durable",
    "esg", "environnement", "environnemental",
    "management", "direction", "dirigeant",
    "marche", "market",
    "concurrence", "concurrent", "competition",
    "technologie", "innovation", "digital",
    "ressources humaines", "effectif", "emploi",
    "reglementaire", "regulatory",
    "opinion", "note de l'auditeur", "commissaire",
    "message du directeur",
    "explique", "expliquer", "decrire",
    "que dit", "que dit le rapport",
    "quels evenements",
)
HYBRID_WORDS = (
    "pourquoi", "comment expliquer", "raison",
    "facteur", "driver", "moteur",
    "augmente", "diminue",
    "ameliore",
    "degrade",
    "impact", "effet", "consequence",
)
# Phrase -> metric, tested in this order.
METRIC_PHRASES = (
    ("resultat net", "net_income"),
    ("benefice net", "net_income"),
    ("chiffre d affaires", "revenue"),
    ("chiffre d'affaires", "revenue"),
    ("ebitda", "ebitda"),
    ("total actif", "total_assets"),
    ("total bilan", "total_assets"),
    ("capitaux propres", "equity"),
    ("fonds propres", "equity"),
    ("dettes financieres", "debt"),
    ("tresorerie", "cash"),
    ("pnb", "net_banking_income"),
    ("produit net bancaire", "net_banking_income"),
)
# Words ignored in questions, and in company names.
QUESTION_STOP = (
    "est", "les", "des", "une", "dans", "pour", "avec", "entre", "quel", "quelle",
    "quels", "quelles", "comment", "donner", "donne", "fait", "sont", "avoir",
    "leur", "vers", "depuis", "plus", "maroc", "lorsque", "compte", "rapport",
)
NAME_STOP = (
    "du", "de", "la", "le", "les", "des", "au", "aux", "sa", "spa", "sca",
    "and", "of", "ex", "et", "al", "groupe", "group", "bank", "maroc",
)
# Topic words -> text searched in addition to the question.
TOPICS = (
    (("total", "bilan"), "total actif passif resultat bilan notes chiffres consolide"),
    (("action",), "resultat de base par action benefice titre nombre de titres"),
    (
        ("decarbon", "décarbon", "engagements", "climat", "environnement", "esg"),
        "décarbonation engagements environnement entrepreneuriat derivés",
    ),
)
MAX_KEYWORDS = 5


# The reason given for each route; {} stands for a count.
REASONS = {
    "hybrid": "hybrid triggers ({}) with sql ({}) or vector ({}) hits",
    "sql": "sql keywords matched: {}",
    "vector": "vector keywords matched: {}",
    "single": "single sql keyword match",
    "none": "no strong signal — defaulting to vector",
}


def reason(name: str, *counts: Column) -> Column:
    return F.format_string(REASONS[name].replace("{}", "%d"), *counts) if counts else F.lit(REASONS[name])


def route(question: Column, word_boundary: bool = False) -> Column:
    """struct(query_type, confidence, reasoning, year, metric) of a question.

    Word tests are plain substring tests unless `word_boundary` asks for whole words.
    """

    def decide(folded):
        text = F.concat(F.lit(" "), F.regexp_replace(folded, "[^a-z0-9' ]", " "), F.lit(" ")) if word_boundary else folded

        def hits(words):
            pad = (lambda w: F.concat(F.lit(" "), w, F.lit(" "))) if word_boundary else (lambda w: w)
            return F.size(F.filter(const_array(words), lambda w: F.contains(text, pad(w))))

        metric = F.get(
            F.filter(const_rows(("phrase", "metric"), METRIC_PHRASES), lambda p: F.contains(folded, p["phrase"])), F.lit(0)
        )["metric"]
        counts = F.struct(
            hits(SQL_WORDS).alias("s"), hits(VECTOR_WORDS).alias("v"), hits(HYBRID_WORDS).alias("h"), metric.alias("metric")
        )
        return let(counts, ladder)

    def ladder(n):
        s, v, h = n["s"], n["v"], n["h"]
        year = F.nullif(F.regexp_extract(question, YEAR_PATTERN, 1), F.lit("")).cast("int")

        def result(kind, confidence, why):
            return F.struct(
                F.lit(kind).alias("query_type"), confidence.cast("double").alias("confidence"), why.alias("reasoning"),
                year.alias("year"), n["metric"].alias("metric"),
            )

        grows = lambda x: F.least(F.lit(0.95), F.lit(0.5) + x * 0.1)
        return (
            F.when((h >= 1) & ((s >= 1) | (v >= 1)), result("hybrid", F.lit(0.8), reason("hybrid", h, s, v)))
            .when((s >= 2) & (s >= v), result("sql", grows(s), reason("sql", s)))
            .when((v >= 2) & (v > s), result("vector", grows(v), reason("vector", v)))
            .when((s == 1) & (v == 0), result("sql", F.lit(0.6), reason("single")))
            .otherwise(result("vector", F.lit(0.5), reason("none")))
        )

    return let(fold(question), decide)


def effective_years(question: Column, given: Column | None = None) -> Column:
    """The given year, else the distinct years of the question in order (null when none)."""
    found = F.when(F.size(years_in(question)) > 0, years_in(question))
    if given is None:
        return found
    return F.when(F.coalesce(given, F.lit("")) != "", F.array(given)).otherwise(found)


def expansions(question: Column) -> Column:
    """Additional texts to search for: topic phrases, and the question with its years repeated."""
    low = F.lower(question)

    def topic(words, text):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        return F.when(hit, F.lit(text))

    every_year = F.regexp_extract_all(question, F.lit(YEAR_PATTERN), F.lit(1))
    dated = F.when(F.size(every_year) > 0, F.concat_ws(" ", question, F.array_join(every_year, " ")))
    return F.array_compact(F.array(*[topic(w, t) for w, t in TOPICS], dated))


def keywords(question: Column) -> Column:
    """array<struct(word, weight)>: folded words of four letters or more, sorted, at most five."""
    tokens = F.filter(F.split(question, f"{WS}+"), lambda t: F.length(t) >= 4)
    stop = const_array(QUESTION_STOP)
    kept = F.filter(F.transform(tokens, ascii_lower), lambda t: ~F.array_contains(stop, t))
    chosen = F.slice(F.array_sort(F.array_distinct(kept)), 1, MAX_KEYWORDS)
    return F.transform(
        chosen, lambda t: F.struct(t.alias("word"), F.greatest(F.lit(1.0), F.length(t) / F.lit(3.0)).alias("weight"))
    )


def keyword_score(words: Column, folded_text: Column) -> Column:
    """Sum of the weights of the words contained in an `ascii_lower` text."""
    return F.aggregate(
        F.filter(words, lambda k: F.contains(folded_text, k["word"])), F.lit(0.0), lambda acc, k: acc + k["weight"]
    )
