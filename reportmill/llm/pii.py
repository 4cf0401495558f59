"""Personal data by patterns, and the terms whose use in the corpus gives an entity away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, within
from .common import WORD, fresh, let, text_of, words

KINDS = ("email", "ip", "card", "phone", "term")
# Matches start where a run of their characters starts, so a long run is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SMALL_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
_PUNCTUATION = "\"'“”‘’«»()[]{}.,;:!?…"
#: Shares of an entity's information that a term may give away: from the first on it is generalised, from the second removed.
GENERALISE_AT, REMOVE_AT = 0.75, 0.95
MAX_SENT = 200_000
_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running total of an array under an associative operation, by doubling steps."""
    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda x: F.when(F.size(x) <= step, x).otherwise(
            F.transform(x, lambda v, i: F.when(i < step, v).otherwise(join(F.get(x, i - step), v)))
        )

    for j in range(26):
        values = let(values, doubled(1 << j))
    return values


def pattern_spans(text: Column, pattern: str, kind: int, holds: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches that hold, with code-point offsets, end exclusive."""
    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda p: F.length(p))
        both = F.zip_with(gaps, found, lambda g, m: g + F.length(m))
        spans = let(scan(both, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), m.alias("value"),
        )))
        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(F.filter(spans, lambda s: holds(s["value"])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.translate(value, "+ ().-", "")


def _luhn(digits: Column) -> Column:
    def weight(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weight(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """E-mail, ip, card and phone spans of a text by start, then kind."""
    found = F.concat(
        pattern_spans(text, EMAIL, 0, lambda v: F.lit(True)),
        pattern_spans(text, IP, 1, lambda v: v.rlike(_SMALL_PARTS)),
        pattern_spans(text, CARD, 2, lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))),
        pattern_spans(text, PHONE, 3, lambda v: F.length(_digits(v)).between(10, 15)),
    )
    by_place = F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])))
    sorted_spans = F.transform(by_place, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))
    return F.when(text.rlike("[0-9@]"), sorted_spans).otherwise(F.array().cast(_SPAN))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _term(word: Column) -> Column:
    return F.translate(F.lower(word), _PUNCTUATION, "")


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, entities, terms, rows) of texts with base spans: who is in them and the terms besides; h hashes the text."""
    rows = docs.select(_key(id_col, text_col).alias("k"), text_of(text_col).alias("text")).withColumn("spans", base_spans(F.col("text"))).filter(F.size("spans") > 0)
    entity = lambda s: F.xxhash64(s["kind"], F.when(s["kind"] >= 2, _digits(s["value"])).otherwise(F.lower(s["value"])))
    blank = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("shown")))
    rest = words(_term(_cleaned(F.col("text"), blank)))
    rows = rows.select("k", F.xxhash64("text").alias("h"), F.array_distinct(F.transform("spans", entity)).alias("entities"), F.array_distinct(rest).alias("terms"))
    return rows.groupBy("k", "h", "entities", "terms").agg(F.count(F.lit(1)).alias("rows"))


def telling_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((term, entity, disclosure), (k, h, rows, term, entity)): the terms that give an entity away, and the texts that hold both.

    A term t gives away the share PMI(t; e) / IC(e) of the information in an entity e:
    log(n(t,e) D / (n(t) n(e))) / log(D / n(e)), with n counted in rows of the whole corpus, n(t,e)
    in rows that hold both anywhere, and D its rows. A term used only with e gives away
    everything, a common word nothing. Only a pair that two different texts hold is judged,
    so copies of one text prove nothing. A term can reach GENERALISE_AT only if it is rare for
    the entity; frequent ones leave before pairs are made. Words of all texts are counted for
    candidates only, which are sent to all tasks below MAX_SENT of them and else joined by
    shuffle with the same result. Null and empty texts hold nothing; an empty table gives none.
    """
    mentions = materialise(_mentions(docs, id_col, text_col), "pii-mentions")
    two = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("rows").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").drop("a", "b")
    held = mentions.select("k", "h", "rows", F.explode("entities").alias("entity"))
    entities = two(held, "entity").withColumnRenamed("n", "n_entity")
    held = materialise(held.join(entities, "entity"), "pii-entities")
    used = mentions.join(held.select("k").distinct(), "k", "left_semi").select("k", "h", "rows", F.explode("terms").alias("term"))
    candidates = materialise(two(used, "term").select("term"), "pii-candidates")
    sent = F.broadcast(candidates) if within(candidates, MAX_SENT) else candidates
    said = docs.select(F.explode(F.array_distinct(words(_term(text_of(text_col))))).alias("term")).join(sent, "term", "left_semi")
    size = docs.agg(F.count(F.lit(1)).cast("double").alias("d"))
    rare = lambda n, d: F.pow(d, F.lit(1 - GENERALISE_AT)) * F.pow(n, F.lit(GENERALISE_AT)) * (1 + 1e-9)
    counts = said.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).withColumn("d", size.scalar()).withColumn("most", held.agg(F.max("n_entity").alias("n")).scalar())
    counts = counts.filter(F.col("n_term") <= rare(F.col("most"), F.col("d")))
    both = used.join(counts, "term").join(held.select("k", "entity", "n_entity"), "k").filter(F.col("n_term") <= rare(F.col("n_entity"), F.col("d")))
    both = materialise(both.select("k", "h", "rows", "term", "entity", "n_term", "n_entity", "d"), "pii-both")
    pairs = two(both, "term", "entity", "n_term", "n_entity", "d").filter("d > n_entity")
    share = F.log(F.col("n") * F.col("d") / (F.col("n_term") * F.col("n_entity"))) / F.log(F.col("d") / F.col("n_entity"))
    telling = pairs.select("term", "entity", share.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE_AT)
    return materialise(telling, "pii-telling"), both.select("k", "h", "rows", "term", "entity")


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, told) of the texts that hold telling terms, a map from the terms to their disclosure there; marked to be sent to all tasks below MAX_SENT pairs.

    A term goes, wherever it stands, from every text that holds an entity it tells of. From
    REMOVE_AT on it stands for the entity itself and goes from all other texts as well.
    """
    telling, both = telling_terms(docs, id_col, text_col)
    here = both.join(telling, ["term", "entity"]).select("k", "term", "disclosure")
    strong = telling.filter(F.col("disclosure") >= REMOVE_AT).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    sent = F.broadcast(strong) if within(strong, MAX_SENT) else strong
    said = docs.select(_key(id_col, text_col).alias("k"), F.explode(F.array_distinct(words(_term(text_of(text_col))))).alias("term")).join(sent, "term")
    rows = materialise(here.unionByName(said.select("k", "term", "disclosure")).groupBy("k", "term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")
    told = rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))
    return F.broadcast(told) if within(rows, MAX_SENT) else told


def _term_spans(text: Column, told: Column, base: Column) -> Column:
    """Every occurrence of a text's telling terms (a map to their disclosure) outside base spans."""
    def shown(found: Column) -> Column:
        apart = F.filter(found, lambda t: told[_term(t["value"])].isNotNull() & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.transform(apart, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(4).alias("kind"), _term(t["value"]).alias("value"), told[_term(t["value"])].alias("disclosure"),
        ))

    return let(pattern_spans(text, WORD, 4, lambda v: F.lit(True)), shown)


def _found(docs: DataFrame, id_col: str, text_col: str, base: str, terms: str) -> DataFrame:
    """docs with columns of the given names for base spans and disclosing terms."""
    key, held = fresh(docs, "_key"), fresh(docs, "_told")
    told = _told(docs, id_col, text_col).withColumnsRenamed({"k": key, "told": held})
    rows = docs.withColumn(key, _key(id_col, text_col)).join(told, key, "left").drop(key)
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string,disclosure:double>>")
    rows = rows.withColumn(base, base_spans(text_of(text_col)))
    return rows.withColumn(terms, F.when(F.col(held).isNotNull(), _term_spans(text_of(text_col), F.col(held), F.col(base))).otherwise(none)).drop(held)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs plus base (spans of patterns) and terms (spans that disclose).

    Spans are (start, end, kind, value) in code points, end exclusive; kind counts in KINDS.
    Terms never overlap a base span. Null and empty texts have no spans; repeated rows get
    the same spans; an empty table gives no rows; columns of these two names are replaced.
    """
    return _found(docs.drop("base", "terms"), id_col, text_col, "base", "terms")


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined, by start and then kind."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of_all() -> Column:
    """Base spans and terms of a row of find(), without values."""
    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.concat(bare(F.col("base")), bare(F.col("terms")))


def _cleaned(text: Column, spans: Column) -> Column:
    """Text with spans replaced; overlapping ones become one, named after the first."""
    def build(s: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(ends, i - 1)))

            def write(h: Column) -> Column:
                def part(at: Column, j: Column) -> Column:
                    before = F.when(j == 0, F.lit(0)).otherwise(F.get(ends, at - 1))
                    return F.concat(F.substring(text, before + 1, F.get(s, at)["start"] - before), F.get(s, at)["shown"])

                return F.concat(F.array_join(F.transform(h, part), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

            return let(heads, write)

        return let(scan(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), with_ends)

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(build(s)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with personal data replaced in the text column; other columns are unchanged.

    length_col, where given, gets the length of the new text in code points.

    Base spans become [EMAIL], [IP], [CARD] or [PHONE]. A disclosing term is generalised to
    [NUMBER] or [WORD], or removed where it gives away REMOVE_AT or more of an entity. A
    null text stays null; a text without spans is returned as it is.
    """
    base, terms, spans = (fresh(docs, f"_{name}") for name in ("base", "terms", "spans"))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    shown = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("shown")))
    told = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(
        s["disclosure"] >= REMOVE_AT, F.lit("")).when(s["value"].rlike("[0-9]"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]")).alias("shown")))
    found = _found(docs, id_col, text_col, base, terms).withColumn(spans, F.sort_array(F.concat(shown, told)))
    cleaned = found.withColumn(text_col, _cleaned(F.col(text_col), F.col(spans)))
    if length_col:
        changed = F.when(F.size(spans) > 0, F.length(text_col)).otherwise(F.col(length_col))
        cleaned = cleaned.withColumn(length_col, changed.cast(docs.schema[length_col].dataType))
    return cleaned.select(*docs.columns)
