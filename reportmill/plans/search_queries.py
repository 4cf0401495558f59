"""Registered queries: hybrid retrieval (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as QR
from ..functions.text import ascii_lower, halved_if_doubled
from ..operators import search as R
from ..operators.buckets import fit
from ..operators.corpus import chunk_words
from ..session import materialise, stored_small
from . import inputs as I
from .catalog import cte, query
from .financial_queries import WORDS, fold_sql

K = 4
WS_SQL = WORDS.strip().strip("'")


def corpus(spark, d):
    """Chunks of all documents; the first chunk of a document has the vector of that number."""
    docs = I.spread_table(spark, d, "documents", "doc_id").select("doc_id", "lang", "source", F.posexplode(chunk_words(F.col("text"))).alias("pos", "text"))
    vectors = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("pos"), "embedding")
    return docs.join(vectors, ["doc_id", "pos"], "left").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("::"), F.col("pos").cast("string")).alias("chunk_id"),
        (F.col("doc_id") * 100000 + F.col("pos")).alias("ord"), "text", "embedding",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("report"), (F.col("pos") + 1).alias("page"),
        F.col("source").alias("company_normalized"), F.upper("source").alias("company"),
        (F.col("doc_id") % 4 + 2018).cast("string").alias("year"), F.col("lang").alias("sector"),
        F.concat(F.lit("https://files.example.com/"), F.col("doc_id").cast("string")).alias("url"),
    )


cte(
    "sc",
    f"""SELECT 'd' || doc_id || '::' || pos AS chunk_id, doc_id * 100000 + pos AS ord, array_to_string(w[pos * 250 + 1:pos * 250 + 300], ' ') AS text,
        CASE WHEN pos = 0 THEN CAST(embedding AS DOUBLE[]) END AS embedding, 'd' || doc_id AS report, pos + 1 AS page, source AS company_normalized, upper(source) AS company, CAST(doc_id % 4 + 2018 AS VARCHAR) AS year, lang AS sector
       FROM (SELECT doc_id, lang, source, w, embedding, unnest(range(CAST((greatest(len(w) - 51, 0) // 250) + 1 AS BIGINT))) AS pos
         FROM (SELECT *, list_filter(string_split_regex(text, '{WS_SQL}'), lambda w: w <> '') AS w FROM documents) LEFT JOIN embeddings ON vec_id = doc_id WHERE len(w) > 0)""",
)


def asked(spark, d):
    """Benchmark texts as questions: half of them for one language, a third for one or two years."""
    q = F.col("item_id")
    years = F.when(q % 3 == 0, F.array(F.lit("2019"))).when(q % 3 == 1, F.array(F.lit("2018"), F.lit("2021")))
    return I.table(spark, d, "benchmark").select(
        q.alias("qid"), F.col("text").alias("question"), F.when(q % 2 == 0, "en").alias("sector"), years.alias("years")
    )


_STOP = ", ".join(f"'{w}'" for w in QR.QUESTION_STOP)
_ASCII = "lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g'))"
KEYWORD_SQL = f"list_sort(list_distinct(list_filter(list_transform(list_filter(string_split_regex({{0}}, '{WS_SQL}'), lambda t: length(t) >= 4), lambda t: {_ASCII.format('t')}), lambda t: t NOT IN ({_STOP}))))[1:5]"
cte(
    "asked",
    f"""SELECT item_id AS qid, text AS question, {KEYWORD_SQL.format('text')} AS kw, CASE WHEN item_id % 2 = 0 THEN 'en' END AS sector,
        CASE item_id % 3 WHEN 0 THEN ['2019'] WHEN 1 THEN ['2018', '2021'] END AS years FROM benchmark""",
)
_SEEN = "(q.sector IS NULL OR c.sector = q.sector) AND (q.years IS NULL OR list_contains(q.years, c.year))"
cte(
    "scored",
    f"""SELECT qid, chunk_id, ord, text, score FROM (SELECT qid, chunk_id, ord, text, coalesce(list_sum(list_transform(list_filter(kw, lambda k: contains(folded, k)), lambda k: greatest(1.0::DOUBLE, length(k) / 3.0::DOUBLE))), 0) AS score
        FROM asked q JOIN (SELECT *, {_ASCII.format('text')} AS folded FROM sc) c ON {_SEEN})""",
    uses=("asked", "sc"),
)
cte(
    "near",
    f"""SELECT qid, chunk_id, ord, distance FROM (SELECT qid, chunk_id, ord, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, ord) AS rn FROM (
        SELECT qid, chunk_id, ord, list_sum(list_transform(list_zip(c.embedding, CAST(e.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
        FROM asked q JOIN embeddings e ON e.vec_id = q.qid JOIN sc c ON c.embedding IS NOT NULL AND {_SEEN})) WHERE rn <= {K}""",
    uses=("asked", "sc"),
)
cte(
    "ranked",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, distance NULLS LAST, ord) AS rank FROM (
        SELECT s.qid, s.chunk_id, s.ord, s.text, s.score, n.distance FROM scored s LEFT JOIN near n ON n.qid = s.qid AND n.chunk_id = s.chunk_id WHERE s.score > 0 OR n.distance IS NOT NULL)) WHERE rank <= {K}""",
    uses=("scored", "near"),
)


def _vectors(spark, d, prepared):
    e = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return prepared.join(e, "qid").withColumn("variant", F.lit(0))


def _near(spark, d, prepared, chunks):
    return R.best_distance(R.vector_top_k(_vectors(spark, d, prepared), chunks, K))


def stored_corpus(spark, d):
    """The chunks, cut once, for queries that read them several times."""
    return materialise(corpus(spark, d), "corpus")


def _ranked(spark, d):
    prepared, chunks = R.prepare_questions(asked(spark, d)), stored_corpus(spark, d)
    return R.hybrid_rank(prepared, chunks, _near(spark, d, prepared, chunks), K), chunks


def _hits(spark, d):
    ranked, chunks = _ranked(spark, d)
    return stored_small(ranked, "ranked").join(chunks.drop("ord", "embedding"), "chunk_id")


# ---- questions over companies ---------------------------------------------------------


def company_questions(spark, d):
    """A question per report: six wordings, half of them with the company given."""
    r = I.reports(spark, d).join(I.companies(spark, d), "company_id")
    y, n = F.col("year").cast("string"), F.col("name")
    text = F.get(
        F.array(
            F.concat(F.lit("Quel est le résultat net de "), n, F.lit(" en "), y, F.lit(" ?")),
            F.concat(F.lit("Pourquoi le chiffre d'affaires de "), n, F.lit(" a-t-il augmenté ?")),
            F.concat(F.lit("Quelle est la stratégie et quels sont les risques de "), n, F.lit(" ?")),
            F.concat(F.lit("Évolution des capitaux propres, "), n),
            F.concat(F.lit("Bonjour "), n, F.lit(" "), y),
            F.concat(F.lit("Bilan total, action et climat en "), y, F.lit(" et "), y, F.lit(" puis 2001 : valeur et montant")),
        ),
        ((F.col("company_id") + F.col("year")) % 6).cast("int"),
    )
    return r.select(
        F.col("report_id").alias("qid"), text.alias("question"),
        F.when(F.col("company_id") % 2 == 0, F.col("normalized_name")).alias("company"), "company_id",
    )


cte(
    "cq",
    """SELECT report_id AS qid, company_id, CASE WHEN company_id % 2 = 0 THEN normalized_name END AS company, normalized_name,
        list_extract(['Quel est le résultat net de ' || name || ' en ' || year || ' ?', 'Pourquoi le chiffre d''affaires de ' || name || ' a-t-il augmenté ?',
          'Quelle est la stratégie et quels sont les risques de ' || name || ' ?', 'Évolution des capitaux propres, ' || name, 'Bonjour ' || name || ' ' || year,
          'Bilan total, action et climat en ' || year || ' et ' || year || ' puis 2001 : valeur et montant'], CAST((company_id + year) % 6 AS INTEGER) + 1) AS question
       FROM reports JOIN companies USING (company_id)""",
    uses=("reports", "companies"),
)


def _words_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _route_sql(source: str) -> str:
    hits = lambda words: f"len(list_filter({_words_sql(words)}, lambda k: contains(f, k)))"
    metric = " ".join("WHEN contains(f, '{}') THEN '{}'".format(p.replace("'", "''"), m) for p, m in QR.METRIC_PHRASES)
    return f"""SELECT qid, query_type, CASE WHEN reasoning LIKE 'hybrid%' THEN 0.8 WHEN reasoning LIKE 'sql%' THEN least(0.95::DOUBLE, 0.5::DOUBLE + s * 0.1::DOUBLE) WHEN reasoning LIKE 'vector%' THEN least(0.95::DOUBLE, 0.5::DOUBLE + v * 0.1::DOUBLE) WHEN reasoning LIKE 'single%' THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence,
      reasoning, year, metric FROM (SELECT *, CASE WHEN h >= 1 AND (s >= 1 OR v >= 1) THEN 'hybrid' WHEN s >= 2 AND s >= v THEN 'sql' WHEN v >= 2 AND v > s THEN 'vector' WHEN s = 1 AND v = 0 THEN 'sql' ELSE 'vector' END AS query_type,
       CASE WHEN h >= 1 AND (s >= 1 OR v >= 1) THEN 'hybrid triggers (' || h || ') with sql (' || s || ') or vector (' || v || ') hits' WHEN s >= 2 AND s >= v THEN 'sql keywords matched: ' || s WHEN v >= 2 AND v > s THEN 'vector keywords matched: ' || v
        WHEN s = 1 AND v = 0 THEN 'single sql keyword match' ELSE 'no strong signal — defaulting to vector' END AS reasoning
       FROM (SELECT qid, {hits(QR.SQL_WORDS)} AS s, {hits(QR.VECTOR_WORDS)} AS v, {hits(QR.HYBRID_WORDS)} AS h, CASE {metric} END AS metric, CAST(nullif(regexp_extract(question, '\\b(20\\d{{2}}|19\\d{{2}})\\b', 1), '') AS INTEGER) AS year
        FROM (SELECT qid, question, {fold_sql('question')} AS f FROM {source})))"""


@query(
    "r01_route_questions",
    f"WITH all_q AS (SELECT qid, question FROM cq UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations) {_route_sql('all_q')}",
    uses=("cq",),
)
def _(spark, d):
    talk = I.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    df = company_questions(spark, d).select("qid", "question").unionByName(talk)
    return df.select("qid", QR.route(F.col("question")).alias("r")).select("qid", "r.*")


@query("r02_question_hints", f"SELECT qid, year, metric FROM ({_route_sql('cq')})", uses=("cq",))
def _(spark, d):
    return company_questions(spark, d).select("qid", QR.route(F.col("question")).alias("r")).select("qid", "r.year", "r.metric")


@query(
    "r03_effective_years",
    """SELECT qid, CASE WHEN company_id % 5 = 0 THEN '1990' WHEN len(y) > 0 THEN array_to_string(list_transform(list_filter(list_zip(y, range(len(y))), lambda p: list_position(y, p[1]) = p[2] + 1), lambda p: p[1]), ',') END AS years
       FROM (SELECT *, regexp_extract_all(question, '\\b(20\\d{2}|19\\d{2})\\b', 1) AS y FROM cq)""",
    uses=("cq",),
)
def _(spark, d):
    given = F.when(F.col("company_id") % 5 == 0, "1990")
    return company_questions(spark, d).select("qid", F.array_join(QR.effective_years(F.col("question"), given), ",").alias("years"))


def _alias_dim(spark, d):
    return I.companies(spark, d).select(
        F.col("normalized_name").alias("company_normalized"),
        F.concat("name", F.lit(" Société ("), F.regexp_replace("sector", "[^A-Z]", ""), F.lit(")-groupe")).alias("company"),
        F.col("company_id").alias("order"),
    )


ALIAS_SQL = """SELECT alias, arg_min(normalized_name, company_id) AS company_normalized FROM (
   SELECT unnest(list_filter(string_split(normalized_name, '_'), lambda p: length(p) >= 3)) AS alias, normalized_name, company_id FROM companies
   UNION ALL SELECT 'nation', normalized_name, company_id FROM companies UNION ALL SELECT lower(name), normalized_name, company_id FROM companies UNION ALL SELECT 'societe', normalized_name, company_id FROM companies) GROUP BY 1"""


@query("r04_company_aliases", ALIAS_SQL, uses=("companies",))
def _(spark, d):
    return R.company_aliases(_alias_dim(spark, d))


@query(
    "r05_resolve_company",
    f"""WITH al AS ({ALIAS_SQL}), tok AS (SELECT qid, t, i FROM (SELECT qid, unnest(t) AS t, unnest(range(len(t))) AS i FROM (SELECT qid, regexp_extract_all({_ASCII.format('question')}, '\\w+') AS t FROM cq WHERE company IS NULL)))
        SELECT q.qid, coalesce(q.company, f.c) AS company FROM cq q LEFT JOIN (SELECT qid, arg_min(company_normalized, i) AS c FROM tok JOIN al ON alias = t GROUP BY 1) f ON f.qid = q.qid""",
    uses=("companies", "cq"),
)
def _(spark, d):
    return R.resolve_company(company_questions(spark, d), R.company_aliases(_alias_dim(spark, d))).select("qid", "company")


_TOPIC_SQL = ", ".join(
    "CASE WHEN {} THEN '{}' END".format(" OR ".join(f"contains(lower(question), '{w}')" for w in words), text) for words, text in QR.TOPICS
)


@query(
    "r06_expand_questions",
    f"""SELECT qid, unnest(list_filter([{_TOPIC_SQL}, CASE WHEN len(y) > 0 THEN question || ' ' || array_to_string(y, ' ') END], lambda x: x IS NOT NULL)) AS expansion
        FROM (SELECT *, regexp_extract_all(question, '\\b(20\\d{{2}}|19\\d{{2}})\\b', 1) AS y FROM cq)""",
    uses=("cq",),
)
def _(spark, d):
    return company_questions(spark, d).select("qid", F.explode(QR.expansions(F.col("question"))).alias("expansion"))


@query("r07_keywords", f"SELECT conv_id * 1000 + turn AS qid, array_to_string({KEYWORD_SQL.format('text')}, '|') AS words, round(list_sum(list_transform({KEYWORD_SQL.format('text')}, lambda k: greatest(1.0::DOUBLE, length(k) / 3.0::DOUBLE))), 6) AS weight FROM conversations")
def _(spark, d):
    kw = QR.keywords(F.col("text"))
    df = I.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), kw.alias("kw"))
    total = F.when(F.size("kw") > 0, F.aggregate("kw", F.lit(0.0), lambda a, k: a + k["weight"]))
    return df.select("qid", F.array_join(F.transform("kw", lambda k: k["word"]), "|").alias("words"), F.round(total, 6).alias("weight"))


@query(
    "r08_keyword_top_k",
    f"SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM scored WHERE score > 0) WHERE rank <= {K}",
    uses=("scored",),
)
def _(spark, d):
    df = R.keyword_top_k(R.prepare_questions(asked(spark, d)), stored_corpus(spark, d), K)
    return df.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("r09_metadata_filter", "SELECT chunk_id FROM sc WHERE company_normalized = 'src7' AND sector = 'en' AND year IN ('2019', '2021')", uses=("sc",))
def _(spark, d):
    return corpus(spark, d).filter(R.matches(company="src7", sector="en", years=[2019, 2021])).select("chunk_id")


@query("r10_vector_top_k", "SELECT qid, chunk_id, round(distance, 6) AS distance FROM near", uses=("near",))
def _(spark, d):
    prepared, chunks = R.prepare_questions(asked(spark, d)), corpus(spark, d)
    return _near(spark, d, prepared, chunks).select("qid", "chunk_id", F.round("distance", 6).alias("distance"))


@query(
    "r10_all_vectors_cosine",
    """SELECT qid, chunk_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), ord) AS rank FROM (SELECT q.vec_id AS qid, 'v' || c.vec_id AS chunk_id, c.vec_id AS ord,
        1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id AND q.label = c.label)) WHERE rank <= 3""",
)
def _(spark, d):
    """Every vector asks for its nearest neighbours of the same label."""
    # One more than wanted, since the vector itself is among its neighbours.
    near = R.vector_top_k(*labelled_vectors(spark, d), 4, "cosine").filter(F.col("chunk_id") != F.concat(F.lit("v"), F.col("qid").cast("string")))
    own = F.row_number().over(R.Window.partitionBy("qid").orderBy("rank"))
    return near.withColumn("rank", own).filter("rank <= 3").select("qid", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


RECALL = 0.9


@query(
    "r10_probed_recall",
    "SELECT CAST(label AS VARCHAR) AS sector, count(*) AS questions, sum(n) AS wanted, TRUE AS reached FROM (SELECT label, least(4, count(*) OVER (PARTITION BY label)) AS n FROM embeddings) GROUP BY 1",
)
def _(spark, d):
    """The approximate search over the same vectors: does it find its share of the exact neighbours, label by label?"""
    vectors, chunks = labelled_vectors(spark, d)
    index = fit(chunks, 4, "cosine")
    wanted = R.vector_top_k(vectors, chunks, 4, "cosine").select("qid", "chunk_id")
    got = R.near_vectors(vectors, chunks, index, 4, "cosine").select("qid", "chunk_id", F.lit(1).alias("hit"))
    rows = wanted.join(got, ["qid", "chunk_id"], "left").join(vectors.select("qid", F.col("f_sector").alias("sector")), "qid")
    rows = rows.groupBy("sector", "qid").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    found = rows.groupBy("sector").agg(F.count("*").alias("questions"), F.sum("wanted").alias("wanted"), F.sum("found").alias("found"))
    return found.select("sector", "questions", "wanted", (F.col("found") >= RECALL * F.col("wanted")).alias("reached"))


def labelled_vectors(spark, d):
    """(question vectors, chunks): all vectors, whose label is their sector."""
    e = I.table(spark, d, "embeddings")
    none = F.lit(None).cast("string")
    label = F.col("label").cast("string")
    chunks = e.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("ord"), "embedding",
        none.alias("report"), none.alias("company_normalized"), none.alias("year"), label.alias("sector"),
    )
    vectors = e.select(
        F.col("vec_id").alias("qid"), F.lit(0).alias("variant"), "embedding", none.alias("f_report"), none.alias("f_company"),
        F.lit(None).cast("array<string>").alias("f_years"), label.alias("f_sector"),
    )
    return vectors, chunks


@query("r11_hybrid_rank", "SELECT qid, chunk_id, round(score, 6) AS score, round(distance, 6) AS distance, rank FROM ranked", uses=("ranked",))
def _(spark, d):
    df, _chunks = _ranked(spark, d)
    return df.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), "rank")


def _answers(spark, d):
    q = company_questions(spark, d)
    routed = q.select("qid", "company", QR.route(F.col("question")).alias("r")).select("qid", "company", "r.*")
    # Some statements are missing, so the year case has to fall back.
    income = I.stored_statements(spark, d, "income_statement").filter(F.col("year") % 3 != 0)
    return R.structured_answers(
        routed.select("qid", "query_type", "company", "year", "metric"), I.metric_facts(spark, d), income, I.companies(spark, d), I.reports(spark, d)
    )


cte(
    "answers",
    f"""WITH r AS (SELECT r.*, c.company, c.company_id FROM ({_route_sql('cq')}) r JOIN cq c ON c.qid = r.qid WHERE query_type IN ('sql', 'hybrid') AND c.company IS NOT NULL)
       SELECT qid, 'metric' AS source, f.company_id, f.year, f.normalized_metric_name AS metric, CAST(value AS DOUBLE) AS value, unit FROM r JOIN facts f ON f.company_id = r.company_id AND f.year = r.year AND f.normalized_metric_name = r.metric
       UNION ALL SELECT qid, 'course', f.company_id, f.year, r.metric, CAST(value AS DOUBLE), unit FROM r JOIN facts f ON f.company_id = r.company_id AND f.normalized_metric_name = r.metric WHERE r.year IS NULL
       UNION ALL SELECT qid, CASE WHEN w.year % 3 <> 0 THEN 'statement' ELSE 'metric' END, w.company_id, w.year, 'net_income', CAST(net_income AS DOUBLE), 'KMAD' FROM r JOIN wide w ON w.company_id = r.company_id AND w.year = r.year WHERE r.metric IS NULL
       UNION ALL SELECT qid, 'statement', w.company_id, w.year, m, CAST(CASE m WHEN 'revenue' THEN revenue WHEN 'gross_profit' THEN gross_profit ELSE income_tax END AS DOUBLE), 'KMAD'
        FROM r JOIN wide w ON w.company_id = r.company_id AND w.year = r.year, (VALUES ('revenue'), ('gross_profit'), ('income_tax')) v(m) WHERE r.metric IS NULL AND w.year % 3 <> 0
       UNION ALL SELECT qid, 'years', p.company_id, p.year, NULL, NULL, NULL FROM r JOIN reports p ON p.company_id = r.company_id WHERE r.metric IS NULL AND r.year IS NULL""",
    uses=("cq", "facts", "wide", "reports"),
)


@query("r12_structured_answers", "SELECT qid, source, name AS company, year, metric, value, unit FROM answers JOIN companies USING (company_id)", uses=("answers", "companies"))
def _(spark, d):
    return _answers(spark, d)


@query(
    "r13_assemble_context",
    f"""WITH hits AS (SELECT qid, string_agg('--- Passage ' || rank || ' [' || company || ' ' || year || ' · p.' || page || '] ---' || chr(10) || chr(10) || r.text, chr(10) || chr(10) ORDER BY rank) AS p FROM ranked r JOIN sc USING (chunk_id) WHERE rank <= 2 GROUP BY 1)
        SELECT q.qid, CASE WHEN p IS NULL THEN '{R.NO_CONTEXT}' ELSE '## Passages du rapport annuel' || chr(10) || p END AS context FROM asked q LEFT JOIN hits h ON h.qid = q.qid""",
    uses=("asked", "ranked", "sc"),
)
def _(spark, d):
    prepared = R.prepare_questions(asked(spark, d))
    answers = spark.createDataFrame([], "qid BIGINT, source STRING, company STRING, year INT, metric STRING, value DOUBLE, unit STRING")
    hits = _hits(spark, d).withColumn("source", F.col("report"))
    return R.assemble_context(prepared, answers, hits, max_passages=2)


@query(
    "r13_structured_context",
    f"""SELECT q.qid, CASE WHEN n IS NULL THEN '{R.NO_CONTEXT}' ELSE '{R.ROWS_TITLE.strip()}' END AS first_line, coalesce(n, 0) AS n_rows FROM cq q LEFT JOIN (SELECT qid, count(*) AS n FROM answers GROUP BY 1) a ON a.qid = q.qid""",
    uses=("cq", "answers"),
)
def _(spark, d):
    none = F.lit(None).cast("string")
    empty = spark.createDataFrame([], "qid BIGINT, rank INT, text STRING, company STRING, year STRING, page INT, source STRING")
    df = R.assemble_context(company_questions(spark, d), _answers(spark, d), empty)
    lines = F.split("context", "\n")
    return df.select("qid", F.get(lines, F.lit(0)).alias("first_line"), F.greatest(F.size(lines) - 2, F.lit(0)).cast("bigint").alias("n_rows"))


@query(
    "r13_full_context",
    f"""WITH q AS (SELECT item_id AS qid, item_id % 50 + 1 AS company_id, 1996 + item_id % 5 AS year, item_id % 2 = 0 AS by_metric FROM benchmark),
       lines AS (SELECT q.qid, q.company_id, q.year, f.normalized_metric_name AS metric, CAST(f.value AS DOUBLE) AS value, f.unit FROM q JOIN facts f ON f.company_id = q.company_id AND f.year = q.year AND f.normalized_metric_name = 'net_income'
          WHERE by_metric OR q.year % 3 = 0
        UNION ALL SELECT qid, q.company_id, q.year, m, CAST(CASE m WHEN 'revenue' THEN revenue WHEN 'gross_profit' THEN gross_profit WHEN 'income_tax' THEN income_tax ELSE net_income END AS DOUBLE), 'KMAD'
          FROM q JOIN wide w ON w.company_id = q.company_id AND w.year = q.year, (VALUES ('revenue'), ('gross_profit'), ('income_tax'), ('net_income')) v(m) WHERE NOT by_metric AND q.year % 3 <> 0),
       rows AS (SELECT qid, string_agg(line, chr(10) ORDER BY year, line) AS r FROM (SELECT qid, year, name || ' | ' || year || ' | ' || metric || ' | ' || format('{{:,.2f}}', value) || ' | ' || unit AS line FROM lines JOIN companies USING (company_id)) GROUP BY 1),
       hits AS (SELECT qid, string_agg('--- Passage ' || rank || ' [' || company || ' ' || year || ' · p.' || page || '] ---' || chr(10) || chr(10) || r.text, chr(10) || chr(10) ORDER BY rank) AS p FROM ranked r JOIN sc USING (chunk_id) GROUP BY 1)
       SELECT a.qid, coalesce(nullif(concat_ws(chr(10) || chr(10), '{R.ROWS_TITLE}' || 'company | year | metric | value | unit' || chr(10) || r, '{R.PASSAGES_TITLE}' || p), ''), '{R.NO_CONTEXT}') AS context
       FROM asked a LEFT JOIN rows r ON r.qid = a.qid LEFT JOIN hits h ON h.qid = a.qid""",
    uses=("asked", "ranked", "sc", "facts", "wide", "companies"),
)
def _(spark, d):
    """Whole contexts: structured rows and passages of the same question."""
    q = F.col("item_id")
    routes = I.table(spark, d, "benchmark").select(
        q.alias("qid"), F.lit("hybrid").alias("query_type"), (q % 50 + 1).alias("company_id"), (q % 5 + 1996).cast("int").alias("year"),
        F.when(q % 2 == 0, "net_income").alias("metric"),
    ).join(I.companies(spark, d).select("company_id", F.col("normalized_name").alias("company")), "company_id").drop("company_id")
    income = I.stored_statements(spark, d, "income_statement").filter(F.col("year") % 3 != 0)
    answers = R.structured_answers(routes, I.metric_facts(spark, d), income, I.companies(spark, d), I.reports(spark, d))
    hits = _hits(spark, d).withColumn("source", F.col("report"))
    return R.assemble_context(R.prepare_questions(asked(spark, d)), answers, hits)


@query(
    "r14_prompt_context",
    """SELECT qid, string_agg('[' || company || ' ' || year || ' · p.' || page || ']' || chr(10) || substr(r.text, 1, 1500), chr(10) || chr(10) ORDER BY rank) AS context FROM ranked r JOIN sc USING (chunk_id) GROUP BY 1""",
    uses=("ranked", "sc"),
)
def _(spark, d):
    return R.prompt_context(_hits(spark, d))


@query(
    "r14_recent_turns",
    "SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4 GROUP BY 1",
)
def _(spark, d):
    df = R.recent_turns(I.table(spark, d, "conversations"), pairs=2)
    return df.select("conv_id", F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), h["text"])), "|").alias("history"))


@query(
    "r15_citations",
    "SELECT DISTINCT qid, company || ', p.' || page AS label, page, report, year, 'https://files.example.com/' || substr(report, 2) AS url FROM ranked JOIN sc USING (chunk_id)",
    uses=("ranked", "sc"),
)
def _(spark, d):
    df = R.citations(_hits(spark, d))
    return df.withColumn("page", F.col("page").cast("bigint"))


@query(
    "r16_doubled_text",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR length(text) >= 20 THEN text ELSE text || text END AS text FROM documents",
)
def _(spark, d):
    doubled = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", "text"))
    return I.table(spark, d, "documents").select("doc_id", halved_if_doubled(doubled).alias("text"))


@query(
    "r19_routing_accuracy",
    f"""SELECT suite, count(*) AS questions, count(*) FILTER (WHERE ok) AS passed, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy FROM (
        SELECT 'wording ' || (company_id + CAST(c.qid % 10000 AS INTEGER)) % 6 AS suite, list_contains(CASE CAST((company_id + c.qid % 10000) % 6 AS INTEGER) WHEN 1 THEN ['hybrid'] WHEN 2 THEN ['vector'] WHEN 4 THEN ['vector', 'hybrid'] ELSE ['sql'] END, query_type) AS ok
        FROM cq c JOIN ({_route_sql('cq')}) r ON r.qid = c.qid) GROUP BY 1""",
    uses=("cq",),
)
def _(spark, d):
    q = company_questions(spark, d)
    which = ((F.col("company_id") + F.col("qid") % 10000) % 6).cast("int")
    expected = F.when(which == 1, F.array(F.lit("hybrid"))).when(which == 2, F.array(F.lit("vector"))).when(which == 4, F.array(F.lit("vector"), F.lit("hybrid"))).otherwise(F.array(F.lit("sql")))
    labelled = q.select(
        F.concat(F.lit("wording "), which.cast("string")).alias("suite"), expected.alias("expected"), QR.route(F.col("question")).alias("r")
    ).select("suite", "expected", "r.query_type", "r.confidence")
    return R.routing_accuracy(labelled).select("suite", "questions", "passed", F.round("accuracy", 6).alias("accuracy"))
