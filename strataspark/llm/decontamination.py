"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts and items are canonicalised alike: numbers become a typed placeholder,
so do units after a number and capitalised words inside a sentence (names);
all else is lower-cased and loses its punctuation.  Windows of ``width``
canonical words, hashed, are joined by hash.  A window with fewer than
``LITERALS`` of its words outside slots says little by its template: it is
hashed with its slots' values, so it matches only where these are equal too,
and counts as one without slots.  Any other window with slots must also
agree with its item: along one alignment of a document with an item, equal
values of the item's slots have equal values in the document's.  An item is
found in a document if its matching windows reach ``share`` of its windows.

Items are broadcast only while their windows number ``BROADCAST_WINDOWS`` at
most, and so are the few documents that need their slots compared; beyond,
Spark shuffles both sides.

Defined cases: null and empty texts or items match nothing; an item of fewer
than ``width`` words, but at least ``LEAST_WORDS``, is one window, of its own
width; shorter items are never looked for; repeated rows with one doc_id count
as one document; rows with a null doc_id never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

WIDTH, LEAST_WORDS, SHARE, LITERALS = 8, 5, 0.25, 0.6
BROADCAST_WINDOWS, BROADCAST_DOCS = 200_000, 500_000
MARK = "\u0001"
_NO_WINDOW = "cast(array() as array<struct<pos:int,h:bigint,width:int>>)"
#: Units that follow a number.
UNITS = "km kg cm mm m g mg l ml lb lbs oz ft in mi mph kph hz khz mhz ghz kb mb gb tb w kw v a c f k s ms h min sec hours hour minutes minute seconds second days day weeks week months month years year meters metres miles feet inches pounds dollars cents euros percent degrees liters litres grams kilograms kilometers kilometres".split()

#: A look ahead comes first, so that most places fail at their own character.
_NUMBER = r"(?=[-+$€£\d])(?<![^\s(\[\"'])[-+$€£]?\d[\d.,:/]*%?(?=[\s)\]\"'.,;:!?]|$)"
_NAME = r"(?=\p{Lu})(?<=[^\s.!?:\n][ \t])(\p{Lu}\p{Ll}+)"


def marked(text: Column) -> Column:
    """Slots become words that start with MARK, their type and their value."""
    numbers = F.regexp_replace(text, _NUMBER, f"{MARK}n$0 ")
    units = F.when(text.rlike(r"\d"), F.regexp_replace(numbers, f"({MARK}n\\S* +)({'|'.join(UNITS)})\\b", f"$1{MARK}u$2")).otherwise(text)
    names = F.regexp_replace(units, _NAME, f"{MARK}p$1")
    plain = F.regexp_replace(F.lower(names), f"[^\\p{{L}}\\p{{N}}\\s{MARK}]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def _keys(words: Column) -> Column:
    """A hash for each word; of a slot its type only counts."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.startswith(MARK), F.substring(w, 1, 2)).otherwise(w)))


def _own_keys(words: Column) -> Column:
    """A hash for each word, of slots with their values."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _slots(words: Column) -> Column:
    return F.filter(words, lambda w: w.startswith(MARK))


def _is_slot(words: Column) -> Column:
    return F.transform(words, lambda w: w.startswith(MARK))


def _dense(slot: Column, width) -> Column:
    """Whether a window, given as whether each word is a slot, has too many slots to be known by its template."""
    return F.size(F.array_remove(slot, False)) > (1 - LITERALS) * width


def _windows(width: int) -> Column:
    """(pos, h, width) of each window of ``width`` words of a text with ``keys``, ``own`` keys and ``slot``; pos from 1, none for shorter texts."""
    last = F.size("keys") - width + 1

    def window(i, dense: Column | None = None):
        h = F.xxhash64(F.slice("keys", i, width))
        if dense is not None:
            h = F.when(dense, F.xxhash64(F.slice("own", i, width))).otherwise(h)
        return F.struct(i.alias("pos"), h.alias("h"), F.lit(width).alias("width"))

    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    # a text with few slots in all has no dense window
    cut = F.when(_dense(F.col("slot"), width), F.transform(places, lambda i: window(i, _dense(F.slice("slot", i, width), width)))).otherwise(F.transform(places, lambda i: window(i)))
    return F.when(last >= 1, cut).otherwise(F.expr(_NO_WINDOW))


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, width, pos, h, slots (of the window, in order; none of a dense one), n_windows."""
    words = items.filter("item_id is not null and text is not null").select("item_id", marked(F.col("text").cast("string")).alias("marked")).dropDuplicates()
    words = words.withColumn("size", F.size("marked")).filter(F.col("size") >= LEAST_WORDS).withColumn("width", F.least(F.lit(width), F.col("size")))
    last = F.col("size") - F.col("width") + 1
    window = F.explode(F.sequence(F.lit(1), last))
    cut = words.select("item_id", "marked", "width", last.alias("n_windows"), window.alias("item_pos")).withColumn("words", F.slice("marked", F.col("item_pos"), F.col("width")))
    dense = _dense(_is_slot(F.col("words")), F.col("width"))
    h = F.xxhash64(F.when(dense, _own_keys(F.col("words"))).otherwise(_keys(F.col("words"))))
    slots = F.when(dense, F.slice("words", 1, 0)).otherwise(_slots(F.col("words")))
    return cut.select("item_id", "width", "item_pos", h.alias("h"), slots.alias("slots"), "n_windows")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots, first_word): items (item_id, text) found in ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    found = written(item_windows(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), width), "items")
    small = found.count() <= BROADCAST_WINDOWS
    widths = sorted(r[0] for r in found.select("width").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    words = F.col("words")
    templates = texts.select("doc_id", marked(F.col("text")).alias("words")).select("doc_id", _keys(words).alias("keys"), _own_keys(words).alias("own"), _is_slot(words).alias("slot"))
    # windows of all widths (one, and those of items that are shorter) in one pass over the texts
    cuts = [_windows(w) for w in widths or [width]]
    all_ = F.concat(*cuts) if len(cuts) > 1 else cuts[0]
    keys = found.select("item_id", "item_pos", "width", "h", "slots", "n_windows")
    matched = templates.select("doc_id", F.explode(all_).alias("x")).select("doc_id", "x.*").join(F.broadcast(keys) if small else keys, ["h", "width"])
    matched = matched.select("doc_id", "item_id", "pos", "item_pos", "slots", "n_windows", "width")
    matched = written(matched, "matches")
    bare = matched.filter(F.size("slots") == 0).select("doc_id", "item_id", "pos", "item_pos", "n_windows", F.lit(0).alias("n_slots"))
    full = matched.filter(F.size("slots") > 0)
    if not full.isEmpty():
        need = full.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "width")).alias("at"))
        need = F.broadcast(need) if need.count() <= BROADCAST_DOCS else need
        own = texts.join(need, "doc_id").select("doc_id", "at", marked(F.col("text")).alias("words"))
        own = own.select("doc_id", F.explode("at").alias("x"), "words").select("doc_id", "x.pos", "x.width", _slots(F.slice("words", F.col("x.pos"), F.col("x.width"))).alias("values"))
        pairs = full.join(own.dropDuplicates(["doc_id", "pos", "width"]), ["doc_id", "pos", "width"]).withColumn("at", F.col("pos") - F.col("item_pos"))
        slot = pairs.select("doc_id", "item_id", "at", F.explode(F.arrays_zip("slots", "values")).alias("s")).groupBy("doc_id", "item_id", "at", "s.slots").agg(F.count_distinct("s.values").alias("n"))
        verdict = slot.groupBy("doc_id", "item_id", "at").agg(F.max("n").alias("most"), F.count("*").cast("int").alias("n_slots")).filter("most = 1")
        bare = bare.unionByName(pairs.join(verdict, ["doc_id", "item_id", "at"]).select("doc_id", "item_id", "pos", "item_pos", "n_windows", "n_slots"))
    out = bare.groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("n_matched"), F.max("n_windows").cast("long").alias("n_windows"), F.max("n_slots").cast("long").alias("n_slots"), (F.min("pos") - 1).cast("long").alias("first_word"))
    out = written(out.filter(F.col("n_matched") >= share * F.col("n_windows")), "found")
    drop(found, matched)
    return out
