r"""Benchmark decontamination by canonical templates.

Texts are cut into words; numbers, names and units become typed placeholders,
other words lose case, punctuation is dropped. Windows
of WINDOW consecutive template words of the documents are joined by hash with
those of the benchmark items (items that are shorter by their whole length).
Windows of one document and item on one diagonal (position in the document minus
position in the item) form runs without gaps. The slots of a run must be
consistent: one value of the item always stands for one value of the document, so
that a re-parameterised copy passes and an accidental template does not; a run is
cut where they are not. A document leaks an item if a consistent piece has
LEAST_WORDS words, or is the whole item, and if LEAST_LITERALS of its words are no
placeholders; one such word is enough in a whole item of LEAST_WORDS words.

Windows of nothing but numbers and units say nothing by themselves: they are not
joined, but where another window of the item has put a document on a diagonal, they
count as met there, and each of their slots is then compared with the word of
the document that stands at its place.

Beside the templates, windows of the words as written (but for case) are joined
and form runs of their own, so exact copies are found however many numbers and
names they have.

Numbers are words with a digit. Names are capitalised words that follow a
lower-case word or a comma; windows of items and documents are kept with and
without placeholders for names, so copies in one case, or in the midst of a
sentence, are found too. Units are the fixed
words below after a number.

Edge cases: null and empty texts have no window; a document without any leak has
no row in leaks(); repeated benchmark rows count once per item, repeated
document rows give the same leak once; null ids are kept as a value of their
own; empty tables give empty results. Only doc_id (item_id) and text are read.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WINDOW = 8
LEAST_WORDS = 13
#: Words of a piece that must not be placeholders.
LEAST_LITERALS = 4
#: Up to so many benchmark windows (24 bytes each) are broadcast; beyond, windows are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
# Units of measure and money.
UNITS = "mm cm m km in ft yd mi g kg mg lb lbs oz t l ml cl gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent mph kmh degrees meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces mile miles inch inches foot feet liter liters litre litres".split()
# Placeholders: private-use characters, which no word has.
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_IN = r"\p{L}\p{M}\p{N}"
NUMBER = rf"(?<![{_IN}])[\p{{L}}\p{{M}}]*+\p{{N}}[{_IN}]*+(?:[.,:/-]\p{{N}}++)*+"
NAMED = rf"(?=\p{{Lu}})(?<=[\p{{Ll}},;{NUM}]\x20)\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*+"
AFTER_NUMBER = rf"{NUM}\x20({NAME}?)(?:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![{_IN}])"
BETWEEN = rf"[^{_IN}{NUM}{NAME}{UNIT}]+"


def _cut(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def marked(text: Column) -> Column:
    """The template words of a text, with NAME before each word that is a name."""
    clean = F.regexp_replace(text, f"[{NUM}{NAME}{UNIT}]", " ")
    clean = F.when(text.rlike(f"[{NUM}{NAME}{UNIT}]"), clean).otherwise(text)
    counted = F.regexp_replace(clean, NUMBER, NUM)
    named = lambda t: F.lower(F.regexp_replace(t, NAMED, f"{NAME}$0"))
    with_units = F.regexp_replace(named(counted), AFTER_NUMBER, f"{NUM} $1{UNIT}")
    return _cut(F.when(text.rlike(r"\p{N}"), with_units).otherwise(named(clean)))


def of_marked(words: Column, names: bool = True) -> Column:
    """The template of marked() words: with placeholders for names, or with the names as they are."""
    return F.transform(words, lambda w: F.when(w.startswith(NAME), F.lit(NAME) if names else w.substr(2, 1 << 30)).otherwise(w))


def template(text: Column, names: bool = True) -> Column:
    """The template words of a text."""
    return of_marked(marked(text), names)


def values(text: Column) -> Column:
    """The words that stand behind the template words of a text, one for one, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{NUMBER}|[{_IN}]++"), F.lit(0)), F.lower)


def written(text: Column) -> Column:
    """The words of a text as values() has them; cut faster where no number can hold its signs together."""
    clean = F.when(text.rlike(f"[{NUM}{NAME}{UNIT}]"), F.regexp_replace(text, f"[{NUM}{NAME}{UNIT}]", " ")).otherwise(text)
    return F.when(text.rlike(r"\p{N}"), values(clean)).otherwise(_cut(F.lower(clean)))


def forms_of(texts: DataFrame, *names: str) -> DataFrame:
    """texts(text, ...) with the word lists, in columns of these names, whose windows a document is searched by.

    They are those with placeholders, the names as they are or not, and as written where numbers make that another list. Both templates are cut from one list.
    """
    text, words = F.col("text"), F.col("_marked")
    forms = [of_marked(words, names=False), of_marked(words), F.when(text.rlike(r"\p{N}"), written(text)).otherwise(F.array().cast("array<string>"))]
    return texts.withColumn("_marked", marked(text)).withColumns(dict(zip(names, forms, strict=True))).drop("_marked")


def windows(words: Column, length: int) -> Column:
    """Hashes of all windows of length words (none if there are fewer words)."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    count = F.size(words) - length + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    # the hashes of the words are bound once, by an outer array of one element; a slice would copy all of them for each window
    return F.get(F.transform(F.array(hashed), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i - 1 + k) for k in range(length)]))), F.lit(0))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, item_words, at, length, exact): windows of the items, as written and with placeholders, those for names or not; hash is null for windows of numbers and units only."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    form = lambda words, exact: items.select("item_id", words.alias("words"), F.lit(exact).alias("exact"))
    text = F.col("text")
    forms = form(template(text), False).unionByName(form(template(text, names=False), False)).unionByName(form(written(text), True))
    sized = forms.withColumn("item_words", F.size("words")).where("item_words > 0").withColumn("length", F.least(F.col("item_words"), F.lit(WINDOW)))
    rows = sized.select("item_id", "item_words", "length", "exact", "words", F.explode(F.sequence(F.lit(1), F.col("item_words") - F.col("length") + 1)).alias("at"))
    part = F.slice("words", F.col("at"), F.col("length"))
    rows = rows.where(F.col("exact") | F.exists(part, lambda w: w != NAME))
    bare = ~F.col("exact") & ~F.exists(part, lambda w: ~w.isin(NUM, UNIT))
    return rows.select(F.when(~bare, F.xxhash64(F.transform(part, lambda w: F.xxhash64(w)))).alias("hash"), "item_id", "item_words", F.col("at").cast("int").alias("at"), "length", "exact").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, item_words, covered_words, position): the best consistent run of each document and item."""
    every_window = stored(item_windows(benchmark))
    items, bare = every_window.where("hash is not null"), every_window.where("hash is null")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # WINDOW numbers at most
    texts = docs.select("doc_id", F.col("text")).where("text is not null")
    names = ["_words0", "_words1", "_words2"]
    cut = forms_of(texts, *names).select("doc_id", F.xxhash64("text").alias("text_hash"), *names)
    small = items.count() <= BROADCAST_WINDOWS
    side = items.withColumnRenamed("length", "_length")
    found = None
    # outer: before an inner one the optimizer asks for the size of the array, and so makes it twice
    for length in lengths:
        of = side.where(F.col("_length") == length)
        hashed = cut.select("doc_id", "text_hash", *[windows(F.col(name), length).alias(name) for name in names])
        # one array for all forms, told apart by the place in it
        ends = [F.size(names[0]).alias("_end0"), (F.size(names[0]) + F.size(names[1])).alias("_end1")]
        placed = hashed.select("doc_id", "text_hash", *ends, F.posexplode_outer(F.concat(*names)).alias("_place", "hash"))
        start = F.when(F.col("_place") < F.col("_end0"), 0).when(F.col("_place") < F.col("_end1"), F.col("_end0")).otherwise(F.col("_end1"))
        rows = placed.select("doc_id", "text_hash", (F.col("_place") - start).alias("pos"), "hash")
        hits = rows.join(F.broadcast(of) if small else of, "hash")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return _no_leaks(docs, benchmark)
    found = stored(found.withColumn("shift", F.col("pos") + 1 - F.col("at")).select(*_DIAGONAL, "at", "_length"))
    # windows of numbers and units count as met on the diagonals that others of their item have found
    met = found.where("not exact").select(*_DIAGONAL).distinct().join(bare.select("item_id", "item_words", "at", F.col("length").alias("_length")), ["item_id", "item_words"])
    runs = stored(segments(found.unionByName(met.select(*_DIAGONAL, "at", "_length"))))
    exact = runs.where("exact").select(*_DIAGONAL, "first", "last")
    every = exact.unionByName(consistent_pieces(runs.where("not exact"), texts, benchmark)).where(_long_enough())
    best = F.max(F.struct((F.col("last") - F.col("first")).alias("n"), (-(F.col("shift") + F.col("first") - 1)).alias("s"), "item_words"))
    return every.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("_b")).select("doc_id", "text_hash", "item_id", F.col("_b.item_words").alias("item_words"), F.col("_b.n").alias("covered_words"), (-F.col("_b.s")).alias("position"))


_DIAGONAL = ["doc_id", "text_hash", "item_id", "item_words", "shift", "exact"]


def _long_enough() -> Column:
    return F.col("last") - F.col("first") >= F.least(F.lit(LEAST_WORDS), F.col("item_words"))


def segments(found: DataFrame) -> DataFrame:
    """(diagonal, first, last): the item's words from first on, up to but not with last, that windows cover without a gap."""
    order = Window.partitionBy(*_DIAGONAL).orderBy("at")
    starts = (F.col("at") > F.lag(F.col("at") + F.col("_length")).over(order)).cast("int")
    numbered = found.select(*_DIAGONAL, "at", "_length").distinct().withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn("_segment", F.sum("_new").over(order))
    return numbered.groupBy(*_DIAGONAL, "_segment").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("_length")).alias("last")).drop("_segment").where(_long_enough())


def consistent_pieces(runs: DataFrame, texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(diagonal, first, last) of the longest pieces of segments in which an item's value stands for one value of the document."""
    items = stored(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("_t", template(F.col("text"))).withColumn("_v", values(F.col("text"))).select("item_id", F.size("_t").alias("item_words"), "_t", "_v"))
    slots = items.select("item_id", "item_words", F.filter(F.transform("_t", lambda t, i: F.struct((i + 1).alias("at"), F.get("_v", i).alias("value"), t.alias("slot"))), lambda s: s["slot"].isin(NUM, NAME, UNIT)).alias("_slots"))
    slots = stored(slots.where(F.size("_slots") > 0))
    # only items with placeholders need the words themselves
    known = stored(runs.join(slots, ["item_id", "item_words"], "left").withColumn("_inside", F.filter("_slots", lambda s: (s["at"] >= F.col("first")) & (s["at"] < F.col("last")))).drop("_slots"))
    free = known.where("_inside is null or size(_inside) = 0").select(*_DIAGONAL, "first", "last")
    open_ = known.where("size(_inside) > 0")
    owners = stored(open_.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    few = owners.count() <= BROADCAST_WINDOWS
    sources = stored(hashed.join(F.broadcast(owners) if few else owners, same).select("_id", "_hash", values(F.col("text")).alias("_words")).dropDuplicates(["_id", "_hash"]))
    pairs = F.transform("_inside", lambda s: F.struct(s["at"].alias("at"), s["value"].alias("item"), s["slot"].alias("slot"), F.get("_words", s["at"] + F.col("shift") - 1).alias("doc")))
    rows = stored(open_.join(sources, same).select(*_DIAGONAL, "first", "last", pairs.alias("_pairs"))).select(*_DIAGONAL, "first", "last", F.explode("_pairs").alias("_pair")).select(*_DIAGONAL, "first", "last", "_pair.*")
    # before a slot, the last place where its item value stood for another value: a piece cannot reach back to it
    run = [*_DIAGONAL, "first"]
    of_value = Window.partitionBy(*run, "item").orderBy("at")
    changed = F.when(~F.lag("doc").over(of_value).eqNullSafe(F.col("doc")), F.lag("at").over(of_value))
    rows = rows.withColumn("_changed", changed).withColumn("_back", F.max("_changed").over(of_value.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = Window.partitionBy(*run).orderBy("at")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    # nor can it hold a number or a unit where the document has none
    kept = F.coalesce(F.when(F.col("slot") == NUM, F.col("doc").rlike(r"\p{N}")).when(F.col("slot") == UNIT, F.col("doc").isin(*UNITS)).otherwise(True), F.lit(False))
    barred = F.max(F.when(~kept, F.col("at"))).over(upto)
    start = F.greatest(F.col("first"), F.coalesce(F.max("_back").over(upto) + 1, F.lit(0)), F.coalesce(barred + 1, F.lit(0)))
    pieces = rows.select(*_DIAGONAL, start.alias("_first"), F.coalesce(F.lead("at").over(in_order), F.col("last")).alias("last")).withColumnRenamed("_first", "first")
    within = F.size(F.filter("_slots", lambda s: (s["at"] >= F.col("first")) & (s["at"] < F.col("last"))))
    said = pieces.join(slots, ["item_id", "item_words"]).withColumn("_literals", F.col("last") - F.col("first") - within)
    whole = (F.col("last") - F.col("first") == F.col("item_words")) & (F.col("item_words") >= LEAST_WORDS) & (F.col("_literals") >= 1)
    said = said.where(whole | (F.col("_literals") >= F.least(F.lit(LEAST_LITERALS), F.col("item_words"))))
    return free.unionByName(said.select(*_DIAGONAL, "first", "last"))


def _no_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).cast(dict(benchmark.dtypes)["item_id"]).alias("item_id"), F.lit(0).alias("item_words"), F.lit(0).alias("covered_words"), F.lit(0).alias("position"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti").select("row.*")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, position): every leak of a benchmark item in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "item_words", "covered_words", "position")
