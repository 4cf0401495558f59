"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, within
from .common import let, text_of, words

WINDOW = 8
#: A window with fewer plain words is searched by its literal words; one of placeholders alone says nothing.
MIN_PLAIN = 4
#: Share of an item's windows that must be found in line, in percent.
MIN_SHARE = 50
#: Template windows that may be sent to every task; a larger benchmark is joined by shuffle.
MAX_SENT = 200_000
#: Windows are first tried by their two leading words in a table of this many bits.
GATES = 1 << 16

#: Ways to read a text: names inside sentences; every capitalised word, runs folded; no names, in lower case.
INSIDE, FOLDED, LOWER = range(3)
READINGS = (INSIDE, FOLDED, LOWER)
#: Hits on diagonals so many words apart are added up.
NEARBY = 3

UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers mile miles "
    "gram grams kilogram kilograms liter liters litre litres hour hours minute minutes second seconds degree degrees"
).split()
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
SLOTS = (NUMBER, NAME, UNIT)
_PUNCTUATION = "\"'“”‘’«»()[]{}.,;:!?…"
_IS_NUMBER = r"(?<![^\s(\[\"'“‘«])[$€£]?[+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th)?%?(?![^\s.,;:!?)\]\"'”’»…])"
_IS_UNIT = rf"(?<=<number>[\s])(?:{'|'.join(UNITS)})(?![^\s.,;:!?)\]\"'”’»…])"
_IS_NAME = r"\p{Lu}(?<=[^.!?:…\"'“”‘’)\]»\s]\s\p{Lu})\p{Ll}[\p{L}’'-]*"


_ANY_NAME = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}’'-]*(?:\x01\p{Lu}[\p{L}’'-]*)*"
_NAME_GAP = r"((?<![\p{L}\p{N}])\p{Lu}[\p{L}’'-]*+)\s++(?=\p{Lu})"
_UNIT_GAP = rf"(?<=[0-9])\s+(?=(?:{'|'.join(UNITS)})(?![^\s.,;:!?)\]\"'”’»…]))"


def _split(text: Column) -> Column:
    return words(F.translate(F.lower(text), _PUNCTUATION, ""))


def _read(text: Column, reading: int) -> Column:
    """The text of a reading: runs that are one placeholder become one word."""
    if reading == INSIDE:
        return text
    joined = let(text, lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, _UNIT_GAP, "\x01")).otherwise(t))
    return F.regexp_replace(joined, _NAME_GAP, "$1\x01") if reading == FOLDED else F.lower(joined)


def _templated(text: Column, reading: int) -> Column:
    """A text read so with names, numbers and units replaced inside their words, so words stay in place."""
    named = text if reading == LOWER else F.regexp_replace(text, _IS_NAME if reading == INSIDE else _ANY_NAME, NAME)
    joined = rf"{_IS_NUMBER[: _IS_NUMBER.rindex('(?!')]}(?:\x01(?:{'|'.join(UNITS)}))?{_IS_NUMBER[_IS_NUMBER.rindex('(?!') :]}"
    return let(named, lambda t: F.when(
        t.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(t, _IS_NUMBER, NUMBER), _IS_UNIT, UNIT) if reading == INSIDE else F.regexp_replace(t, joined, NUMBER)
    ).otherwise(t))


def _few_plain(slots: Column, size: int) -> Column:
    """Whether a window's words are too few besides placeholders to be found by its template."""
    return F.size(F.filter(slots, lambda x: ~x.isin(*SLOTS))) < min(MIN_PLAIN, (size + 1) / 2)


def _gate(hashes: Column, i: Column, size: int) -> Column:
    """Number of a window's two leading words, below GATES."""
    both = hashes[i] if size == 1 else hashes[i].bitwiseXOR(F.shiftleft(hashes[i + 1], 1))
    return both.bitwiseAND(F.lit(GATES - 1)).cast("int")


def _windows(text: Column, sizes: list[int], reading: int, sieve: Column | None = None) -> Column:
    """(at, size, gate, key, said) of every window of a reading; said holds its words where it has a placeholder.

    Words are in lower case without punctuation; a number, a unit after a number and a
    name of the reading become typed placeholders. A window of too few plain words is keyed
    by its own words. Windows whose gate is not set in the sieve (an array of booleans) are
    left out.
    """
    def searched(slots: Column, said: Column, plain: Column) -> Column:
        def of(size: int) -> Column:
            def window(hashes: Column, i: Column) -> Column:
                template = F.xxhash64(F.lit(reading), *[hashes[i + k] for k in range(size)])
                few = ~plain & _few_plain(F.slice(slots, i + 1, size), size)
                key = F.when(few, F.xxhash64(F.lit(reading), F.lit("said"), F.array_join(F.slice(said, i + 1, size), " "))).otherwise(template)
                return F.struct(i.cast("int").alias("at"), F.lit(size).alias("size"), _gate(hashes, i, size).alias("gate"), key.alias("key"), F.when(
                    ~plain & F.exists(F.slice(slots, i + 1, size), lambda w: w.isin(*SLOTS)), F.slice(said, i + 1, size)
                ).alias("said"))

            def tried(hashes: Column) -> Column:
                places = F.sequence(F.lit(0), F.size(slots) - size)
                open_at = places if sieve is None else let(sieve, lambda s: F.filter(places, lambda i: s[_gate(hashes, i, size)]))
                return F.transform(open_at, lambda i: window(hashes, i))

            made = let(F.transform(slots, lambda w: F.xxhash64(w)), tried)
            none = F.array().cast("array<struct<at:int,size:int,gate:int,key:bigint,said:array<string>>>")
            return F.when(F.size(slots) >= size, made).otherwise(none)

        return F.concat(*map(of, sizes)) if len(sizes) > 1 else of(sizes[0])

    def both(t: Column) -> Column:
        return let(_split(t["slots"]), lambda slots: let(
            F.when(t["plain"], slots).otherwise(_split(t["text"])), lambda said: searched(slots, said, t["plain"])
        ))

    made = let(_read(text, reading), lambda t: let(_templated(t, reading), lambda s: F.struct(s.alias("slots"), t.alias("text"), (s == t).alias("plain"))))
    return let(made, both)


def _sieve(wanted: DataFrame) -> Column:
    """Which gates the benchmark's windows use, as a constant array of GATES booleans."""
    used = {r["gate"] for r in wanted.select("gate").distinct().collect()}  # at most GATES
    return F.split(F.lit(",".join("1" if g in used else "0" for g in range(GATES))), ",").cast("array<boolean>")


#: Words of an anchor, the longest first; bits of the filter that holds all anchors.
ANCHORS, FILTER_BITS = (3, 2, 1), 1 << 20
_JOIN = "\x01"


def _run_hash(hashes: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[hashes[i + k] for k in range(size)])


def _anchor(said: Column, slots: Column, few: Column) -> Column:
    """(n, letters, hash) of neighbouring words of a window that every text which takes it over holds; null where none is sure.

    Words that a reading leaves as they are stand in the text as they stand in the window, side
    by side where they do so there. A window keyed by its own words holds all of them, with
    those parted that the reading has joined. The longest anchor is taken, among equally long
    ones that with most letters.
    """
    def best(words_of: Column, sure: Column) -> Column:
        def of(size: int) -> Column:
            places = F.when(F.size(sure) >= size, F.sequence(F.lit(0), F.size(sure) - size)).otherwise(F.array().cast("array<int>"))
            kept = F.filter(places, lambda i: F.forall(F.slice(sure, i + 1, F.lit(size)), lambda x: F.coalesce(x, F.lit(False))))
            listed = F.transform(kept, lambda i: F.struct(
                F.length(F.array_join(F.slice(words_of, i + 1, F.lit(size)), "")).alias("letters"),
                _run_hash(F.transform(words_of, lambda w: F.xxhash64(w)), i, size).alias("h"),
            ))
            return F.when(F.size(listed) > 0, let(F.array_max(listed), lambda b: F.struct(F.lit(size).alias("n"), b["letters"].alias("letters"), b["h"].alias("h"))))

        return F.coalesce(*map(of, ANCHORS))

    own = F.filter(F.flatten(F.transform(said, lambda w: F.split(w, _JOIN))), lambda w: w != "")
    unchanged = F.zip_with(said, slots, lambda w, s: (w == s) & ~F.contains(w, F.lit(_JOIN)) & ~F.contains(w, F.lit("<")))
    return F.when(few, best(own, F.transform(own, lambda w: F.lit(True)))).otherwise(best(said, unchanged))


def _held(wanted: DataFrame, total: DataFrame, min_share: int) -> Callable[[Column], Column]:
    """Whether a text may hold an anchor of one of the benchmark's windows: a Bloom filter of FILTER_BITS, sent as a constant.

    Most texts hold none and need not be read in three ways. An item counts when a share of
    its windows is found, m of them, so all but m - 1 of its windows suffice: those with the
    longest anchors. The filter lets some texts too many through and none too few: a window
    without an anchor lets all pass, and so does a text that holds the character by which
    readings join words.
    """
    share = lambda n: F.ceil(F.col(n) * min_share / 100)
    least = F.greatest(F.lit(1), F.when(F.col("wanted_plain") > 0, F.least(share("wanted"), share("wanted_plain"))).otherwise(share("wanted")))
    found = wanted.withColumn("a", _anchor(F.coalesce("asked", "asked_slots"), F.col("asked_slots"), F.col("few")))
    place = F.row_number().over(Window.partitionBy("item", "reading").orderBy(F.desc_nulls_last("a.n"), F.desc("a.letters"), "item_at"))
    kept = found.withColumn("place", place).join(total, ["item", "reading"]).filter(F.col("place") <= F.col("wanted") - least + 1)
    anchors = kept.select(F.coalesce("a.n", F.lit(0)).alias("n"), F.coalesce("a.h", F.lit(0)).alias("h"))
    bit = lambda h: h.bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = anchors.select("n", F.explode(F.array(bit(F.col("h")), bit(F.shiftright("h", 32)))).alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    cells = bits.groupBy("n", F.shiftright("b", 6).alias("cell")).agg(F.bit_or(one).alias("set")).collect()  # at most FILTER_BITS / 64 of a size
    if any(c["n"] == 0 for c in cells):
        return lambda text: F.lit(True)
    table = [0] * (FILTER_BITS // 64)
    for c in cells:
        table[c["cell"]] |= c["set"]
    sizes = sorted({c["n"] for c in cells}, reverse=True)
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def is_set(table: Column, b: Column) -> Column:
        return F.call_function("shiftrightunsigned", table[F.shiftright(b, 6).cast("int")], b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def held(text: Column) -> Column:
        def any_of(table: Column, hashes: Column, size: int) -> Column:
            def tried(i: Column) -> Column:
                h = _run_hash(hashes, i, size)  # taken again for the second bit only where the first is set
                return is_set(table, bit(h)) & is_set(table, bit(F.shiftright(h, 32)))

            there = F.exists(F.sequence(F.lit(0), F.size(hashes) - size), tried)
            return F.when(F.size(hashes) >= size, there).otherwise(False)

        def tried(table: Column, hashes: Column) -> Column:
            out = any_of(table, hashes, sizes[0])
            for size in sizes[1:]:
                out = out | any_of(table, hashes, size)
            return out

        hashes = F.transform(_split(text), lambda w: F.xxhash64(w))
        return F.contains(text, F.lit(_JOIN)) | let(constant, lambda table: let(hashes, lambda h: tried(table, h)))

    return held if sizes else lambda text: F.lit(False)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """(id, item, found, wanted, changed): every row that takes over a benchmark item.

    Texts and items become templates in each of READINGS; windows of `window` template words
    (the whole item where it is shorter) are joined by hash. Hits of one row, item and
    reading on one diagonal (place in the text less place in the item), or on diagonals at
    most NEARBY words from it, belong together. They count when at least min_share percent
    of the item's windows are found there and the slots agree: each value in the item's
    slots stands for one value in the text. `changed` counts slots with another value: 0 for
    a plain copy, more for a re-parameterised question. Windows with fewer than MIN_PLAIN
    plain words (or half of a shorter item) are searched by their own words; the others
    suffice alone where they are most of a reading's windows or names inside sentences are
    the only ones.

    A null or empty text or id matches nothing; repeated rows or items match once; empty
    tables give no rows. A text is read in three ways only where it holds words that a window
    cannot be found without (`_held`). Texts are never shuffled: a window travels as (hash, place), with
    its words only where it holds a placeholder. The benchmark's windows are sent to all
    tasks below MAX_SENT of them and else joined by shuffle with the same result.
    """
    items = benchmark.select(F.col(item_col).alias("item"), text_of(item_text).alias("text")).filter("item is not null").distinct()
    asked = {r: items.withColumn("slots", _split(_templated(_read(F.col("text"), r), r))).withColumn("n_asked", F.size("slots")).filter("n_asked > 0") for r in READINGS}
    n = F.least("n_asked", F.lit(window)).alias("n")
    sizes = {r: sorted(x["n"] for x in asked[r].select(n).distinct().collect()) or [window] for r in READINGS}

    def windows_of(reading: int) -> DataFrame:
        parts = let(F.col("slots"), lambda s: F.transform("w", lambda x: F.struct(
            x["at"].alias("item_at"), x["size"].alias("size"), x["gate"].alias("gate"), x["key"].alias("key"), x["said"].alias("asked"), F.slice(s, x["at"] + 1, x["size"]).alias("asked_slots"),
        )))
        rows = asked[reading].withColumn("w", _windows(F.col("text"), sizes[reading], reading)).select("item", "n_asked", F.explode(parts).alias("w"))
        few = sum((F.when((F.col("w.size") == k) & _few_plain(F.col("w.asked_slots"), k), 1).otherwise(0) for k in sizes[reading]), F.lit(0)) > 0
        return rows.filter(F.col("w.size") == F.least("n_asked", F.lit(window))).select("item", F.lit(reading).alias("reading"), few.alias("few"), "w.*")

    wanted = materialise(windows_of(INSIDE).union(windows_of(FOLDED)).union(windows_of(LOWER)), "benchmark-windows")
    total = wanted.groupBy("item", "reading").agg(F.count(F.lit(1)).alias("wanted"), F.count_if(~F.col("few")).alias("wanted_plain"))
    sent = F.broadcast(wanted) if within(wanted, MAX_SENT) else wanted

    sieve, text = _sieve(wanted), text_of(text_col)
    every = F.when(_held(wanted, total, min_share)(text), let(sieve, lambda open_: F.concat(*[_windows(text, sizes[r], r, open_) for r in READINGS])))
    said = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(every).alias("w"))
    hits = said.select("id", "w.key", "w.size", "w.at", "w.said").join(sent, ["key", "size"])
    pairs = F.filter(F.transform("asked_slots", lambda s, k: F.struct(
        s.alias("slot"), F.get("asked", k).alias("asked"), F.get("said", k).alias("said"),
    )), lambda p: p["slot"].isin(*SLOTS))
    near = F.sequence(F.lit(-NEARBY), F.lit(NEARBY))
    hits = hits.select("id", "item", "reading", "few", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", F.when(F.col("said").isNotNull(), pairs).alias("pairs"), F.explode(near).alias("off"))

    def line(on: Column) -> Column:
        found = F.collect_set(F.when(on, F.struct("item_at", "few")))
        return F.struct(F.size(found).alias("found"), F.size(F.filter(found, lambda x: ~x["few"])).alias("plain"), F.array_distinct(F.flatten(F.collect_set(F.when(on, F.col("pairs"))))).alias("pairs"))

    both = F.array(line(F.col("off") == 0), line(F.lit(True)))
    lines = hits.groupBy("id", "item", "reading", (F.col("shift") + F.col("off")).alias("shift")).agg(both.alias("x"))
    lines = lines.join(total, ["item", "reading"]).select("id", "item", "reading", "wanted", "wanted_plain", F.inline("x"))
    by_template = (F.col("wanted_plain") > 0) & (100 * F.col("plain") >= min_share * F.col("wanted_plain")) & (
        (F.col("reading") == INSIDE) | (2 * F.col("wanted_plain") >= F.col("wanted")))
    lines = lines.filter(by_template | (100 * F.col("found") >= min_share * F.col("wanted")))
    agree = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["slot"], p["asked"])))) == F.size("pairs")
    changed = F.size(F.filter("pairs", lambda p: ~p["asked"].eqNullSafe(p["said"])))
    counts = F.when(by_template, F.struct(F.col("plain").alias("found"), F.col("wanted_plain").alias("wanted"))).otherwise(F.struct("found", "wanted"))
    best = F.max(counts)
    return lines.filter(agree).groupBy("id", "item").agg(best["found"].alias("found"), best["wanted"].alias("wanted"), F.min(changed).alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that take over no benchmark item, with all their columns; null ids stay."""
    found = matches(docs, benchmark, id_col, text_col).select(F.col("id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
