"""Op 3 [native]: benchmark decontamination by templates.

A text becomes a template: numbers, names and units turn into typed placeholders.  Templates are
compared by hashed windows of `WINDOW` tokens in a hash join, and a window counts only if its
slots are consistent: two slots hold one value in the document exactly if the same two do in the
benchmark item.  So a question is found again with other numbers or names in it.  Every
capitalised word is a name slot, for one that opens a sentence may be a name as well.
A window with next to no plain words says nothing as a template: it is compared by its words.

Slots are also checked along an item: the windows of one diagonal (place in the document minus
place in the item) bind each value of the item to one value of the document and back, and a
window that goes against the binding most of them have does not count.

A document is contaminated by an item if at least `COVERAGE` of the item's windows are found in
it.  Everything here is built-in DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.llm.common import cut

WINDOW = 8
COVERAGE = 0.5
# Windows of the benchmark up to which their hashes are broadcast (some 16 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
# Places of hits up to which they are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_PLACES = 1_000_000
# Units of measure, as lower-case words.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "n", "pa", "kpa", "k", "c", "f", "in", "ft", "yd", "mi", "oz", "lb", "gal", "mph", "inch", "inches", "feet", "foot", "yards", "miles", "mile", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "pound", "pounds", "percent", "degree", "degrees"]
NUMBER, NAME, UNIT = "@d", "@n", "@u"
SLOTS = (NUMBER, NAME, UNIT)
TOKENS = r"\p{L}[\p{L}\p{N}]*|[0-9]+(?:[.,][0-9]+)*"
PLAIN = 4  # a window of fewer than a quarter of plain words is compared by its words


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens_of(text: Column) -> Column:
    """Words and numbers with their separators; a unit glued to a number is a word of its own."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))


def template(k: Column) -> Column:
    """The tokens in lower case, with placeholders for numbers, units after numbers, and capitalised words.

    Tokens are told by their first byte, as strings compare by bytes: most are done after one comparison.
    """
    number = lambda y: (y >= "0") & (y < ":")

    def one(k: Column, x: Column, i: Column) -> Column:
        unit = (i > 0) & number(F.element_at(k, F.greatest(i, F.lit(1)))) & F.lower(x).isin(UNITS)
        first = x.substr(1, 1)
        return F.when((x >= "a") & (x < "{") & ~unit, F.lower(x)).when(number(x), NUMBER).when(unit, UNIT).when(first != F.lower(first), NAME).otherwise(F.lower(x))

    return _let(k, lambda k: F.transform(k, lambda x, i: one(k, x, i)))


def lowered(k: Column) -> Column:
    return F.transform(k, lambda x: F.lower(x))


def _windows(t: Column, window: int) -> Column:
    """Hashes of all windows, each of two shorter windows' hashes; a shorter text has none."""

    def joined(t: Column, by: int) -> Column:
        n = lambda t: F.greatest(F.size(t) - by, F.lit(0))
        return _let(t, lambda t: F.zip_with(F.slice(t, F.lit(1), n(t)), F.slice(t, F.lit(by + 1), n(t)), lambda x, y: F.xxhash64(x, y)))

    if window == 1:
        return F.transform(t, lambda x: F.xxhash64(x))
    span = 1
    while span < window:
        by = min(span, window - span)
        t, span = joined(t, by), span + by
    return t


def _pattern(template_window: Column, words: Column) -> Column:
    """For each slot of a window the place at which its value comes first; 0 for plain tokens."""
    return F.transform(template_window, lambda t, i: F.when(t.isin(*SLOTS), F.array_position(words, F.element_at(words, i + 1))).otherwise(0))


def _marks(k: Column, span: int, words: bool) -> Column:
    """span, n, hs: the hashes of a document's n windows, of templates and, if asked for, of words."""

    def hashes(h: Column) -> Column:
        return F.struct(F.lit(span).alias("span"), F.size(h["t"]).alias("n"), F.concat(h["t"], h["w"]).alias("hs") if words else h["t"].alias("hs"))

    return _let(F.struct(_windows(template(k), span).alias("t"), *([_windows(lowered(k), span).alias("w")] if words else [])), hashes)


def _part(c: Column, at: Column, span: Column) -> Column:
    return F.slice(c, at + 1, span)


def _items(benchmark: DataFrame, window: int, short_items: bool) -> tuple[DataFrame, list[int]]:
    """(item_id, at, span, bare, probe, h, slots, w) of each item's windows, and the spans below `window`.

    A bare window is compared by its words, others by their template.
    """
    b = benchmark.select("item_id", _let(tokens_of(F.col("text")), lambda k: F.struct(lowered(k).alias("w"), template(k).alias("t"))).alias("x")).select("item_id", "x.*").distinct()
    n = F.size("w")
    short = sorted(r["n"] for r in b.where((n > 0) & (n < window)).select(n.alias("n")).distinct().collect()) if short_items else []  # fewer than `window` rows

    def of(span: int) -> DataFrame:
        own = b.where(n >= window if span == window else n == span).select("item_id", "w", "t", F.posexplode(F.arrays_zip(_windows(F.col("w"), span).alias("pw"), _windows(F.col("t"), span).alias("pt"))).alias("at", "p"))
        own = own.select("item_id", "at", "p", *[_part(F.col(x), F.col("at"), F.lit(span)).alias(x) for x in ("w", "t")])
        own = own.withColumn("bare", F.size(F.filter("t", lambda x: ~x.isin(*SLOTS))) * PLAIN < span)
        pick = lambda yes, no: F.when(F.col("bare"), F.col(yes)).otherwise(F.col(no))
        return own.select("item_id", "at", F.lit(span).alias("span"), "bare", pick("p.pw", "p.pt").alias("probe"), F.xxhash64(pick("w", "t")).alias("h"), _pattern(pick("w", "t"), F.col("w")).alias("slots"), "w")

    return cut(reduce(DataFrame.unionByName, [of(span) for span in (window, *short)]).distinct(), "items"), short


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, short_items: bool = True) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage): for each pair that shares a consistent window.

    An item shorter than `window` tokens is one window of its own length.  A window with fewer
    than a quarter of plain words is compared by its words.  Without `short_items` shorter items
    are compared nowhere.
    An item without tokens is compared nowhere; null texts are empty; null ids are ids of their own;
    empty tables give no rows; texts of any length are read whole.  Repeated rows of one id count
    once, and rows of one id with different texts are one document.  Other columns are ignored.
    """
    items, short = _items(benchmark, window, short_items)
    probes = items.select("probe").distinct()
    if probes.count() <= BROADCAST_WINDOWS:
        probes = F.broadcast(probes)
    bare = {r["span"] for r in items.where("bare").select("span").distinct().collect()}  # at most `window` rows
    d = docs.select("doc_id", _let(tokens_of(F.col("text")), lambda k: F.array(*[_marks(k, span, span in bare) for span in (window, *short)])).alias("m"))
    # Outer, for the optimizer would evaluate what a plain generator takes a second time, as a filter; null probes join nothing.
    d = d.select("doc_id", F.inline_outer("m")).select("doc_id", "span", "n", F.posexplode_outer("hs").alias("at", "probe"))
    hits = d.join(probes, "probe").groupBy("doc_id").agg(F.collect_set(F.col("at") % F.col("n") * F.lit(window + 1).cast("long") + F.col("span")).alias("places"))
    hits = cut(hits, "hits")
    if (hits.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES:
        hits = F.broadcast(hits)
    both = _let(tokens_of(F.col("text")), lambda k: F.struct(lowered(k).alias("w"), template(k).alias("t")))
    found = docs.select("doc_id", "text").join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]), "inner").select(docs["doc_id"].alias("doc_id"), both.alias("x"), "places")

    def cell(x: Column, place: Column, name: str) -> Column:
        at = F.call_function("div", place, F.lit(window + 1)).cast("int")
        c, w = (_part(x[k], at, (place % (window + 1)).cast("int")) for k in (name, "w"))
        return F.struct(F.lit(name == "w").alias("bare"), F.xxhash64(c).alias("h"), _pattern(c, w).alias("slots"), at.alias("place"), w.alias("dw"))

    forms = ["t", *(["w"] if bare else [])]
    found = found.select("doc_id", F.explode_outer(_let(F.struct("x", "places"), lambda y: F.flatten(F.transform(y["places"], lambda p: F.array(*[cell(y["x"], p, name) for name in forms]))))).alias("y")).select("doc_id", "y.*").distinct()
    pairs = _bound(found.join(items.select("item_id", "at", "bare", "h", "slots", "w"), ["bare", "h", "slots"]))
    count = F.countDistinct("at").cast("long")
    pairs = pairs.groupBy("doc_id", "item_id").agg(count.alias("n_windows"))
    total = items.groupBy("item_id").agg(count.alias("item_windows"))
    pairs = pairs.join(total, pairs["item_id"].eqNullSafe(total["item_id"])).select("doc_id", pairs["item_id"].alias("item_id"), "n_windows", "item_windows")
    return pairs.select("*", (F.col("n_windows") / F.col("item_windows")).alias("coverage"))


def _bound(pairs: DataFrame) -> DataFrame:
    """The pairs of windows that agree with the binding of their diagonal.

    On a diagonal each value of the item goes with the document's value that most places of the
    item have (on a tie the smallest), and the other way round; a window agrees if all its slots do.
    """
    line = ["doc_id", "item_id", "diagonal"]
    pairs = pairs.withColumn("diagonal", F.col("place") - F.col("at"))
    slot = F.filter(F.transform(F.col("slots"), lambda s, j: F.struct(s.alias("s"), (F.col("at") + j).alias("spot"), F.element_at("w", j + 1).alias("iv"), F.element_at("dw", j + 1).alias("dv"))), lambda x: x["s"] > 0)
    each = pairs.select(*line, "at", F.explode(slot).alias("x")).select(*line, "at", "x.spot", "x.iv", "x.dv")
    votes = each.groupBy(*line, "iv", "dv").agg(F.countDistinct("spot").alias("votes"))
    first = lambda a, b: F.row_number().over(Window.partitionBy(*line, a).orderBy(F.desc("votes"), b)) == 1
    votes = votes.withColumn("there", first("iv", "dv")).withColumn("back", first("dv", "iv"))
    same = lambda a, b, more: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in (*line, *more)])
    no = votes.where(~(F.col("there") & F.col("back")))
    off = each.join(no, same(each, no, ("iv", "dv")), "left_semi").select(*line, "at").distinct()
    return pairs.join(off, same(pairs, off, ("at",)), "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, short_items: bool = True) -> DataFrame:
    """The pairs of contamination() that reach `coverage`."""
    return contamination(docs, benchmark, short_items=short_items).where(F.col("coverage") >= coverage)
