"""Hybrid retrieval for many questions at once: filters, keyword and vector top-k, contexts.

Keywords find their chunks through the posting lists of `grams`. Vectors meet in parts: the
exact search pairs a question with the chunks of its sector (or all), the approximate one with
the chunks in the buckets it probes (`buckets`). A part is compared block by block, each pair of
blocks in steps that only look for what beats the best k so far; it keeps the best k per
question, and only those rows are shuffled again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import NAME_STOP, keyword_score, keywords
from ..functions.text import ascii_lower
from ..functions.vocab import STATEMENT_METRICS
from ..session import stored_small
from .buckets import MAX_BITS, Buckets, as_rows
from .grams import containing_words

FILTERS = ("report", "company_normalized", "year", "sector")
QUESTION_BLOCK, CHUNK_BLOCK = 16384, 16384
#: Rows of a block that are multiplied at once, chunks growing from the first step; pairs whose distances are taken at once.
QUESTION_STEP, FIRST_STEP, CHUNK_STEP, PIECE = 512, 512, 2048, 65536
TOP_K = 4


def matches(chunk_prefix: str = "", report=None, company=None, years=None, sector=None) -> Column:
    """Predicate of one question's metadata filter; terms left out are not tested."""
    col = lambda n: F.col(f"{chunk_prefix}{n}")
    test = F.lit(True)
    if report:
        test = test & (col("report") == report)
    if company:
        test = test & (col("company_normalized") == company)
    if years:
        test = test & col("year").isin(*[str(y) for y in years])
    if sector:
        test = test & (col("sector") == sector)
    return test


def _visible(wanted: dict, chunks: pd.DataFrame) -> np.ndarray | None:
    mask = None
    for name, value in (("report", wanted["f_report"]), ("company_normalized", wanted["f_company"]), ("sector", wanted["f_sector"])):
        if value:
            test = (chunks[name] == value).to_numpy()
            mask = test if mask is None else mask & test
    years = wanted["f_years"]
    if years:
        test = chunks["year"].isin(years).to_numpy()
        mask = test if mask is None else mask & test
    return mask


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as a matrix; they must be of one length."""
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError("vectors of different lengths")
    return pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), sizes["max"] or 0)


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each element among its equals; equals stand together, in rising order."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _few_copies(have: np.ndarray, ords: np.ndarray, k: int) -> np.ndarray:
    """Positions without those chunks that k equal vectors precede in corpus order: they are never among k nearest."""
    if not have.size:
        return np.arange(len(have))
    same = np.unique(np.ascontiguousarray(have).view(f"V{have.itemsize * have.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ords, same))
    return np.sort(order[_places(same[order]) < k])


def _nearest(wanted: np.ndarray, have: np.ndarray, ords: np.ndarray, k: int, metric: str, meets=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(questions, chunks, distances): the k least (distance, ord) of every question, as positions.

    Matrix products find the candidates: what is not farther than the k-th best so far (with a
    margin far above the rounding error). Their distances are then taken from the differences, so
    equal vectors tie exactly. `meets(questions, chunks)` tells which pairs count, as a matrix of
    questions and buckets and the bucket of each chunk.
    """
    size, sizes = (wanted**2).sum(axis=1), (have**2).sum(axis=1)
    fit = np.isfinite(sizes) & (sizes > 0) if metric == "cosine" else np.isfinite(sizes)
    able = np.isfinite(size) & (size > 0) if metric == "cosine" else np.isfinite(size)
    if metric == "cosine":
        lengths, their_lengths = np.linalg.norm(wanted, axis=1), np.linalg.norm(have, axis=1)
        left, right = -wanted / np.where(able, lengths, 1.0)[:, None], have / np.where(fit, their_lengths, 1.0)[:, None]
        offset, margin = np.ones(len(wanted)), np.full(len(wanted), 1e-9)
    else:
        left, right = np.hstack([-2.0 * wanted, np.ones((len(wanted), 1))]), np.hstack([have, sizes[:, None]])
        offset, margin = size, 1e-9 * (1.0 + size + sizes.max(where=fit, initial=0.0))

    def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            return 1.0 - (have[c] * wanted[q]).sum(axis=1) / (their_lengths[c] * lengths[q])
        return ((have[c] - wanted[q]) ** 2).sum(axis=1)

    chunks = np.flatnonzero(fit)
    chunks = chunks[_few_copies(have[chunks], ords[chunks], k)]
    asking = np.flatnonzero(able)
    parts = []
    for at in range(0, len(asking), QUESTION_STEP):
        asked = asking[at : at + QUESTION_STEP]
        limit = np.full(len(asked), np.inf)
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        start, step = 0, FIRST_STEP
        while start < len(chunks):
            block = chunks[start : start + step]
            start, step = start + step, min(2 * step, CHUNK_STEP)
            rows = np.arange(len(asked))
            if meets is not None:
                seen, bucket = meets(asked, block)
                rows = np.flatnonzero(seen.any(axis=1))
                seen = seen[rows]
                if not len(rows):
                    continue
            rough = left[asked[rows]] @ right[block].T
            extra = margin[asked[rows]]
            bound = limit[rows] - offset[asked[rows]] + extra
            new = np.flatnonzero(np.isinf(limit[rows]))
            if len(new) and len(block) > k:
                own = rough[new] if meets is None else np.where(seen[new][:, bucket], rough[new], np.inf)
                bound[new] = np.partition(own, k - 1, axis=1)[:, k - 1] + extra[new]
            i, j = np.divmod(np.flatnonzero(rough <= bound[:, None]), len(block))
            if meets is not None:
                ok = seen[i, bucket[j]]
                i, j = i[ok], j[ok]
            q, c = rows[i], block[j]
            pieces = [slice(p, p + PIECE) for p in range(0, len(q), PIECE)]
            key = np.concatenate([np.empty(0), *[exact(asked[q[p]], c[p]) for p in pieces]])
            q, c, key = (np.concatenate(both) for both in zip(kept, (q, c, key)))
            order = np.lexsort((ords[c], key, q))
            q, c, key = q[order], c[order], key[order]
            place = _places(q)
            limit[q[place == k - 1]] = key[place == k - 1]
            kept = tuple(column[place < k] for column in (q, c, key))
        parts.append((asked[kept[0]], *kept[1:]))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(columns) for columns in zip(empty, *parts))


_OUT = "qid BIGINT, variant INT, chunk_id STRING, ord BIGINT, key DOUBLE"
_FOUND = pa.schema([("qid", pa.int64()), ("variant", pa.int32()), ("chunk_id", pa.string()), ("ord", pa.int64()), ("key", pa.float64())])


def _compare(left: pa.Table, right: pa.Table, k: int, metric: str, index: Buckets | None) -> pa.Table:
    """Best k chunks per question of two blocks, questions with the same filters together."""
    if not left.num_rows or not right.num_rows:
        return _FOUND.empty_table()
    wanted, have = _rows(left["embedding"]), _rows(right["embedding"])
    ords = right["ord"].to_numpy()
    chunks = right.select(list(FILTERS)).to_pandas()
    alike: dict[tuple, list[int]] = {}
    filters = ("f_report", "f_company", "f_years", "f_sector")
    for i, values in enumerate(zip(*[left[f].to_pylist() for f in filters])):
        alike.setdefault(tuple(tuple(v) if isinstance(v, list) else v for v in values), []).append(i)
    if index is not None:
        band = left["cell"][0].as_py() >> MAX_BITS
        sides, reach = index.sides(as_rows(wanted, metric))[:, band], left["reach"].to_numpy()
        buckets = right["bucket"].to_numpy() & ((1 << MAX_BITS) - 1)
    parts = []
    for values, questions in alike.items():
        mask, q = _visible(dict(zip(filters, values)), chunks), np.array(questions)
        c = np.arange(len(have)) if mask is None else np.flatnonzero(mask)
        meets = None
        if index is not None:
            c = c[np.argsort(buckets[c], kind="stable")]

            def meets(asked, block, q=q, c=c):
                there, bucket = np.unique(buckets[c[block]], return_inverse=True)
                return index.within(sides[q[asked]], reach[q[asked]], there), bucket

        found = _nearest(wanted[q], have[c], ords[c], k, metric, meets)
        parts.append((q[found[0]], c[found[1]], found[2]))
    q, c, key = (np.concatenate(columns) for columns in zip(*parts))
    columns = [left["qid"].take(q), left["variant"].take(q), right["chunk_id"].take(c), right["ord"].take(c), pa.array(key)]
    return pa.Table.from_arrays(columns, schema=_FOUND)


def _sector_parts(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A part is a sector, or everything for questions without one."""
    own = F.coalesce(F.nullif("f_sector", F.lit("")), F.lit("*"))
    of_chunk = F.explode(F.array_distinct(F.array(F.coalesce("sector", F.lit("-")), F.lit("*"))))
    return questions.withColumn("part", own), chunks.withColumn("part", of_chunk)


def _top_k(questions: DataFrame, chunks: DataFrame, k: int, metric: str, question_block: int, chunk_block: int, index: Buckets | None = None) -> DataFrame:
    """Best k chunks per question of the parts they share; a chunk that is met in several parts counts once."""
    probing, bucketed = (("cell", "reach"), ("bucket",)) if index is not None else ((), ())
    q = questions.select(F.col("qid").cast("bigint").alias("qid"), F.col("variant").cast("int").alias("variant"), "embedding", "f_report", "f_company", "f_years", "f_sector", "part", *probing)
    # Columns of its own, since questions and chunks may come from one table.
    c = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ord").cast("bigint").alias("ord"), *[F.col(n).alias(n) for n in ("embedding", *FILTERS, "part", *bucketed)])
    blocks = lambda df, n, size: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    # Sizes of the parts are stored, so that rows go to their blocks without a shuffle by part.
    parts = stored_small(blocks(q, "n_q", question_block).join(blocks(c, "n_c", chunk_block), "part"), "parts")
    block = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qs = q.join(parts, "part").withColumn("qb", block(("qid", "variant"), "n_q")).withColumn("cb", every("n_c")).drop("n_q", "n_c")
    cs = c.join(parts, "part").withColumn("cb", block(("chunk_id",), "n_c")).withColumn("qb", every("n_q")).drop("n_q", "n_c")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compare(left, right, k, metric, index)

    found = qs.groupBy("part", "qb", "cb").cogroup(cs.groupBy("part", "qb", "cb")).applyInArrow(pair, _OUT)
    # A question's rows meet once: its chunks are told apart and ranked in the same place.
    found = found.repartition("qid", "variant").groupBy("qid", "variant", "chunk_id").agg(F.min("ord").alias("ord"), F.min("key").alias("key"))
    best = Window.partitionBy("qid", "variant").orderBy("key", "ord")
    return found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k).withColumnRenamed("_rn", "rank")


def prepare_questions(questions: DataFrame) -> DataFrame:
    """(qid, question[, report, company, years, sector]) with keywords and filter columns."""
    has = set(questions.columns)
    text = lambda n: F.col(n) if n in has else F.lit(None).cast("string")
    years = F.col("years") if "years" in has else F.lit(None).cast("array<string>")
    return questions.select(
        F.col("qid").cast("bigint").alias("qid"), "question", keywords(F.col("question")).alias("keywords"),
        text("report").alias("f_report"), text("company").alias("f_company"), years.alias("f_years"), text("sector").alias("f_sector"),
    )


def keyword_top_k(prepared: DataFrame, chunks: DataFrame, k: int = TOP_K, postings: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, ord, score, rank): best keyword scores, corpus order among equals.

    A question meets only chunks that hold one of its words, which the posting lists of
    `grams` tell. `postings` is a stored `grams.token_postings` of the chunks' folded texts;
    without it the texts are cut into tokens. Rows are the hits of a question's words,
    so a word that most chunks hold costs as many rows; a hot word's join is split by Spark.
    """
    asked = prepared.select("qid", "f_report", "f_company", "f_years", "f_sector", F.explode("keywords").alias("k"))
    asked = asked.select("qid", "f_report", "f_company", "f_years", "f_sector", "k.word", "k.weight")
    texts = chunks.select("chunk_id", "ord", ascii_lower(F.col("text")).alias("folded"), *FILTERS)
    hits = containing_words(asked.select("word"), texts, postings)
    test = lambda wanted, has: (F.coalesce(wanted, F.lit("")) == "") | F.coalesce(F.col(has) == F.col(wanted), F.lit(False))
    years = F.coalesce(F.size("f_years"), F.lit(0)) <= 0
    seen = (
        test("f_report", "report") & test("f_company", "company_normalized") & test("f_sector", "sector")
        & (years | F.coalesce(F.array_contains("f_years", F.col("year")), F.lit(False)))
    )
    # The few weights of a question are added in the order of its words, so equal sets of words tie exactly.
    found = F.sort_array(F.collect_list(F.struct("word", "weight")))
    score = F.aggregate(found, F.lit(0.0), lambda a, k: a + k["weight"]).alias("score")
    scores = hits.drop("folded").join(asked, "word").filter(seen).groupBy("qid", "chunk_id").agg(F.min("ord").alias("ord"), score)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, chunks: DataFrame, k: int = TOP_K, metric: str = "l2", question_block: int = QUESTION_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """(qid, variant, chunk_id, ord, distance, rank) for question vectors (qid, variant,
    embedding and filter columns) over chunks with a vector. Metric: squared l2 or cosine.

    Exact: a question is compared with every chunk of its sector.
    """
    hits = _top_k(*_sector_parts(vectors, chunks.filter(F.col("embedding").isNotNull())), k, metric, question_block, chunk_block)
    return hits.withColumnRenamed("key", "distance")


def near_vectors(vectors: DataFrame, chunks: DataFrame, index: Buckets, k: int = TOP_K, metric: str = "l2", question_block: int = QUESTION_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """`vector_top_k` over the chunks that share a bucket with the question: approximate, with exact distances.

    Every chunk is in one bucket of each band and every question probes several buckets of
    each; the two meet by an equi-join on (sector, band, cell), where a cell is as many buckets as
    fill a block: those that agree in their first bits. So a question is sent once to a cell
    however many of its buckets it probes, and meets only the chunks in these. The index says how
    many probes its sample needed for the recall that was asked for.
    """
    q, c = _sector_parts(vectors, chunks.filter(F.col("embedding").isNotNull()))
    bits = F.ceil(F.log2(F.count(F.lit(1)) / chunk_block)).cast("int")
    fixed = stored_small(c.groupBy("part").agg(F.least(F.greatest(bits, F.lit(0)), F.lit(index.bits)).alias("fixed")), "fixed")
    in_cell = lambda df: df.withColumn("part", F.concat_ws("/", "part", F.col("cell").cast("string")))
    band, low = F.lit(-1 << MAX_BITS), F.expr("shiftleft(1L, fixed) - 1")
    q = q.join(fixed, "part").withColumn("probed", index.probed(F.col("embedding"), F.col("fixed"))).withColumn("cell", F.explode("probed.cells"))
    q = in_cell(q.withColumn("reach", F.get("probed.reach", F.shiftright("cell", MAX_BITS).cast("int"))))
    c = c.join(fixed, "part").withColumn("bucket", F.explode(index.own(F.col("embedding"))))
    c = in_cell(c.withColumn("cell", F.col("bucket").bitwiseAND(band.bitwiseOR(low))))
    return _top_k(q, c, k, metric, question_block, chunk_block, index).withColumnRenamed("key", "distance")


def best_distance(hits: DataFrame) -> DataFrame:
    """Least distance per (question, chunk) over the question's variants."""
    return hits.groupBy("qid", "chunk_id").agg(F.min("distance").alias("distance"), F.min("ord").alias("ord"))


def hybrid_rank(prepared: DataFrame, chunks: DataFrame, nearest: DataFrame, k: int = TOP_K, postings: DataFrame | None = None) -> DataFrame:
    """Keyword hits by score, then distance, then corpus order; the rest filled by distance.

    `nearest` is (qid, chunk_id, ord, distance). A chunk without distance that ranks among
    the first k also ranks among the first k by (score, order) alone, so the keyword top-k
    plus the scored neighbours hold every candidate. The neighbours are stored, and sent to the
    chunks while they are few, so that the texts are not shuffled.
    """
    nearest = stored_small(nearest.select("qid", "chunk_id", "ord", "distance"), "nearest")
    by_words = keyword_top_k(prepared, chunks, k, postings).select("qid", "chunk_id", "ord", "score")
    scored = (
        nearest.join(chunks.select("chunk_id", "text"), "chunk_id")
        .join(prepared.select("qid", "keywords"), "qid")
        .select("qid", "chunk_id", "ord", "distance", keyword_score(F.col("keywords"), ascii_lower(F.col("text"))).alias("score"))
    )
    both = by_words.withColumn("distance", F.lit(None).cast("double")).unionByName(scored)
    both = both.groupBy("qid", "chunk_id").agg(
        F.min("ord").alias("ord"), F.max("score").alias("score"), F.min("distance").alias("distance")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("distance"), "ord")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def company_aliases(stems: DataFrame) -> DataFrame:
    """(alias, company_normalized): name parts that identify a company, the first company wins.

    `stems` carries (company_normalized, company, order) with `order` the place in the dim.
    """
    firsts = stems.groupBy("company_normalized").agg(F.min_by("company", "order").alias("company"), F.min("order").alias("order"))
    stop = F.array(*[F.lit(w) for w in NAME_STOP])
    slug_parts = F.filter(F.split("company_normalized", "_"), lambda p: (F.length(p) >= 3) & ~F.array_contains(stop, p))
    short = F.transform(F.regexp_extract_all("company", F.lit(r"\(([A-Z]{2,})\)"), F.lit(1)), F.lower)
    words = F.filter(
        F.transform(F.split("company", r"(?U)[\s\-_()/]+"), ascii_lower), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)
    )
    rows = firsts.select(F.explode(F.array_distinct(F.concat(slug_parts, short, words))).alias("alias"), "company_normalized", "order")
    return rows.groupBy("alias").agg(F.min_by("company_normalized", F.struct("order", "company_normalized")).alias("company_normalized"))


def resolve_company(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Fill a missing `company` with that of the first word known as an alias."""
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("question")), F.lit(r"\w+"), F.lit(0)))
    open_ = questions.filter(F.coalesce("company", F.lit("")) == "")
    found = (
        open_.select("qid", F.posexplode(tokens).alias("pos", "alias"))
        .join(aliases, "alias")
        .groupBy("qid")
        .agg(F.min_by("company_normalized", "pos").alias("_found"))
    )
    rest = [c for c in questions.columns if c != "company"]
    return questions.join(found, "qid", "left").select(
        *rest, F.coalesce(F.nullif("company", F.lit("")), "_found").alias("company")
    )


def structured_answers(routes: DataFrame, facts: DataFrame, income: DataFrame, companies: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows that answer the structured part of routed questions.

    `routes` is (qid, query_type, company, year, metric). With metric and year: that fact;
    with a metric: its course over the years; with a year: every known line of the income
    statement, or net income where there is none; otherwise the years on file. Each case is one join.
    """
    asked = routes.filter(F.col("query_type").isin("sql", "hybrid") & (F.coalesce("company", F.lit("")) != ""))
    who = companies.select("company_id", F.col("normalized_name").alias("company"), "name")
    asked = asked.join(who, "company")
    has_metric, has_year = F.col("metric").isNotNull(), F.col("year").isNotNull()
    f = facts.select("company_id", "year", F.col("normalized_metric_name").alias("metric"), F.col("value").cast("double").alias("value"), "unit")
    out = ("qid", "source", F.col("name").alias("company"), "year", "metric", "value", "unit")
    text = lambda v: F.lit(v).cast("string")

    newest = Window.partitionBy("qid").orderBy(F.desc("year"), F.desc("value"))
    exact = asked.filter(has_metric & has_year).join(f, ["company_id", "year", "metric"]).withColumn("source", F.lit("metric"))
    exact = exact.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 10).select(*out)
    course = asked.filter(has_metric & ~has_year).drop("year").join(f, ["company_id", "metric"]).withColumn("source", F.lit("course")).select(*out)
    yearly = asked.filter(~has_metric & has_year).drop("metric")
    lines = income.select("company_id", "year", "unit", *[F.col(c).cast("double").alias(c) for c in STATEMENT_METRICS["income_statement"]])
    statement = (
        yearly.join(lines, ["company_id", "year"])
        .unpivot(["qid", "name", "year", "unit"], STATEMENT_METRICS["income_statement"], "metric", "value").filter("value is not null")
        .withColumn("source", F.lit("statement")).select(*out)
    )
    fallback = (
        yearly.join(lines.select("company_id", "year"), ["company_id", "year"], "left_anti")
        .join(f.filter(F.col("metric") == "net_income"), ["company_id", "year"]).withColumn("source", F.lit("metric")).select(*out)
    )
    years = (
        asked.filter(~has_metric & ~has_year).drop("year", "metric").join(reports.select("company_id", "year"), "company_id")
        .withColumns({"source": F.lit("years"), "metric": text(None), "value": F.lit(None).cast("double"), "unit": text(None)}).select(*out)
    )
    return exact.unionByName(course).unionByName(statement).unionByName(fallback).unionByName(years)


NO_CONTEXT = "[Aucune donnée disponible pour cette question.]"
ROWS_TITLE = "## Données financières structurées (PostgreSQL)\n"
PASSAGES_TITLE = "## Passages du rapport annuel\n"


def assemble_context(questions: DataFrame, answers: DataFrame, hits: DataFrame, max_passages: int = 5) -> DataFrame:
    """(qid, context): structured rows and the first passages of each question as one text.

    `hits` carries (qid, rank, text, company, year, page, source); passages beyond the limit
    are filtered before anything is collected.
    """
    line = F.concat_ws(" | ", "company", F.col("year").cast("string"), F.coalesce("metric", F.lit("")), F.coalesce(F.format_number("value", 2), F.lit("")), F.coalesce("unit", F.lit("")))
    rows = answers.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("year", line.alias("line")))).alias("r"))
    label = F.when(
        F.coalesce("company", F.lit("")) != "",
        F.concat(F.lit("["), F.col("company"), F.lit(" "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(" · p."), F.col("page").cast("string"), F.lit("]")),
    ).otherwise(F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("]")))
    passage = F.concat(F.lit("--- Passage "), F.col("rank").cast("string"), F.lit(" "), label, F.lit(" ---\n\n"), F.col("text"))
    passages = hits.filter(F.col("rank") <= max_passages).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", passage.alias("p")))).alias("p")
    )
    rows_text = F.concat(F.lit(ROWS_TITLE + "company | year | metric | value | unit\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    passages_text = F.concat(F.lit(PASSAGES_TITLE), F.array_join(F.transform("p", lambda x: x["p"]), "\n\n"))
    joined = F.concat_ws("\n\n", rows_text, passages_text)
    return questions.select("qid").join(rows, "qid", "left").join(passages, "qid", "left").select(
        "qid", F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_CONTEXT)).alias("context")
    )


def prompt_context(hits: DataFrame, cut: int = 1500) -> DataFrame:
    """(qid, context): one headed block per hit in rank order, each text cut."""
    head = F.concat(
        F.lit("["), F.coalesce("company", "report"), F.lit(" "), F.coalesce("year", F.lit("")), F.lit(" · p."),
        F.col("page").cast("string"), F.lit("]\n"), F.substring("text", 1, cut),
    )
    blocks = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", head.alias("b")))).alias("b"))
    return blocks.select("qid", F.array_join(F.transform("b", lambda x: x["b"]), "\n\n").alias("context"))


def recent_turns(turns: DataFrame, pairs: int = 8) -> DataFrame:
    """Last 2 x pairs turns per conversation, oldest first, as one array.

    The ranked filter is cut per partition, so a conversation of any length costs its tail.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 2 * pairs)
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))


def citations(hits: DataFrame) -> DataFrame:
    """One source per (question, report, page); the later hit wins; labels in order."""
    label = F.concat(F.coalesce(F.nullif("company", F.lit("")), "report"), F.lit(", p."), F.col("page").cast("string"))
    last = hits.groupBy("qid", "report", "page").agg(
        F.max_by(F.struct(label.alias("label"), F.coalesce("year", F.lit("")).alias("year"), F.coalesce("url", F.lit("")).alias("url")), "rank").alias("s")
    )
    return last.select("qid", "s.label", "page", "report", "s.year", "s.url").orderBy("qid", "label")


def routing_accuracy(labelled: DataFrame) -> DataFrame:
    """Share of right routes per suite for (suite, expected array, query_type, confidence)."""
    ok = F.array_contains("expected", F.col("query_type"))
    return labelled.groupBy("suite").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(ok).alias("passed"),
        F.avg(ok.cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"),
    )
