"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units after a number and names (capitalised words inside a sentence) become typed placeholders; windows of
five canonical words of documents and benchmark items meet in a hash join. An item leaks into a document that holds 0.8
or more of its windows. If the item has placeholders, the document's words in their place must be a consistent
re-parameterisation: each value of the item has one partner (the most frequent), and windows that contradict it do
not count. A document may hold several variants, so partners are chosen, and windows counted, in each occurrence alone,
and the best one decides.

Items without a window that identifies them ("What is 2 + 2?") are looked for word by word with their own values: the
whole item must occur, and one of fewer than LEAST_WORDS words must be the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deltaloom.llm._shared import documents, write_out

WINDOW = 5
COVERAGE = 0.8
#: A window needs so many words that are no placeholders to identify an item.
LITERALS = 2
#: Shorter items occur by chance in any text; they only match documents that hold nothing else.
LEAST_WORDS = 3
#: An occurrence is looked for among windows whose alignments differ by less than so many times the item's length.
REACH = (0.5, 2, 8)
#: Benchmark windows, and candidate pairs, beyond this number are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000
_NUMBER, _NAME, _UNIT = "\ue000", "\ue001", "\ue002"  # private-use code points, taken out of the texts first
_MARKS = f"{_NUMBER}-{_UNIT}"
#: Units of measure.
UNITS = "mm cm m km in ft yd mi mg g kg t ml cl l s sec ms min h hr hrs hours minutes seconds days weeks months years hz khz mhz ghz w kw v a j k c f pa bar eur usd gbp euros dollars pounds cents percent meters metres kilometers kilometres miles feet inches grams kilograms liters litres gallons degrees".split()
_DIGITS = r"[0-9]+(?:[.,][0-9]+)*"


def canonical_words(text) -> F.Column:
    """Words in lower case with placeholders for numbers, units and names; the last may be empty."""
    for mark in (_NUMBER, _NAME, _UNIT):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    text = F.replace(text, F.lit("İ"), F.lit("I"))
    text = F.regexp_replace(text, rf"{_DIGITS}[ \t]*(?i:{'|'.join(UNITS)})(?!\p{{L}})", f" {_NUMBER} {_UNIT} ")
    text = F.regexp_replace(text, _DIGITS, f" {_NUMBER} ")
    text = F.regexp_replace(text, r"\p{Lu}(?<=[^.!?:;\s][ \t]\p{Lu})\p{L}*", f" {_NAME} ")
    text = F.regexp_replace(F.lower(text), rf"^[^\p{{L}}{_MARKS}]+", "")
    return F.split(text, rf"[^\p{{L}}{_MARKS}]+")


def plain_words(text) -> F.Column:
    """The words that the canonical ones stand for, one for each."""
    for mark in (_NUMBER, _NAME, _UNIT):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.regexp_extract_all(F.replace(text, F.lit("İ"), F.lit("I")), F.lit(rf"{_DIGITS}|\p{{L}}+"), F.lit(0))


def windows(words: str) -> F.Column:
    """Hashes of all windows of an array of canonical words."""
    last = f"size({words}) - if(element_at({words}, -1) = '', 1, 0) - {WINDOW}"
    hashed = ", ".join(f"get({words}, i + {k})" for k in range(WINDOW))
    return F.expr(f"if({last} < 0, cast(array() as array<bigint>), transform(sequence(0, {last}), i -> xxhash64({hashed})))")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, at, hash, slots, values, total, span): the windows that identify an item, its placeholders' values, its length."""
    table = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t")).dropDuplicates()
    table = table.select("item", canonical_words(F.col("t")).alias("w"), plain_words(F.col("t")).alias("p"))
    table = table.select("item", "w", "p", F.posexplode(windows("w")).alias("at", "hash"))
    slots = F.expr(f"filter(sequence(0, {WINDOW - 1}), k -> get(w, at + k) >= '{_NUMBER}' and get(w, at + k) <= '{_UNIT}')")
    table = table.withColumn("slots", slots).where(f"size(slots) <= {WINDOW - LITERALS}")
    table = table.select("item", "at", "hash", "slots", F.expr("transform(slots, k -> get(p, at + k))").alias("values"))
    totals = table.groupBy("item").agg(F.countDistinct("at").alias("total"), (F.max("at") - F.min("at") + WINDOW).alias("span"))
    return table.join(totals, "item")


def occurrences() -> F.Column:
    """Structs (kind, place) of the groups that a window belongs to: the whole document, those at the item's own values,
    those at one alignment of item and document, and buckets of near alignments.

    Copies that follow each other differ in alignment by the item's length. Buckets of each width come twice, half a width
    apart, so words put into or left out of a copy part it in at most one of them.
    """
    groups = ["if(size(values) = 0 or forall(sequence(0, size(values) - 1), k -> lower(get(values, k)) = lower(get(own, k))), struct(1, 0L), struct(0, 0L))", "struct(0, 0L)", "struct(2, cast(pos - at as bigint))"]
    for k, reach in enumerate(REACH):
        width = f"greatest(2, cast({reach} * span as int))"
        groups += [f"struct({3 + 2 * k + half}, cast(floor((pos - at + {half} * ({width} div 2)) / {width}) as bigint))" for half in range(2)]
    return F.expr(f"array_distinct(array({', '.join(groups)}))")


def short_items(items: DataFrame, bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, words, seed, hash): items without a row in ``bench``, their words as they are, and a hash of the first ``seed``."""
    table = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t"))
    table = table.join(bench.select("item").distinct(), "item", "left_anti").select("item", F.transform(plain_words(F.col("t")), F.lower).alias("words")).where("size(words) > 0").dropDuplicates()
    table = table.withColumn("seed", F.expr(f"least({WINDOW}, size(words))"))
    return table.withColumn("hash", F.expr("xxhash64(seed, array_join(slice(words, 1, seed), ' '))"))


def short_hits(source: DataFrame, short: DataFrame) -> DataFrame:
    """Rows (id_, item) of texts that hold a short item as a whole."""
    seeds = [row.seed for row in short.select("seed").distinct().collect()]  # WINDOW of them at most
    starts = lambda k: f"if(size(p) < {k}{f' or size(p) > {k}' if k < LEAST_WORDS else ''}, cast(array() as array<struct<pos:int,hash:bigint>>), transform(sequence(0, size(p) - {k}), i -> struct(i as pos, xxhash64({k}, array_join(slice(p, i + 1, {k}), ' ')) as hash)))"
    words = source.select("id_", F.transform(plain_words(F.col("text_")), F.lower).alias("p"))
    placed = words.select("id_", "p", F.inline(F.expr(f"concat({', '.join(starts(k) for k in seeds)})")))
    return placed.join(short, "hash").where("slice(p, pos + 1, size(words)) = words").select("id_", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Pairs of documents and the benchmark items they hold.

    Rows (id_col, item_id, n_windows, n_matched, coverage, reparameterised): the item's windows, how many the document
    holds consistently in its best occurrence, their share, and whether any placeholder has another value there. An item without a
    window of five words of which two are no placeholders counts as one window: the whole item with its own values.

    * Nulls: null texts and ids, of documents or items, match nothing. Empty texts hold nothing, and items without a word are in nothing.
    * Very long texts are searched whole.
    * Ties: of partners met equally often the smallest string is chosen; of occurrences that hold equally many windows
      one with the item's own values decides.
    * Repeated rows of one id count as one document. Empty tables give an empty result.
    * Other columns are not carried, so their names cannot clash.
    """
    bench, _ = write_out(benchmark_windows(items, item_id, item_text), "benchmark-windows")
    small = bench.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    source = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    placed = source.select("id_", canonical_words(F.col("text_")).alias("w")).select("id_", F.explode(windows("w")).alias("hash"))
    hits = placed.join(hint(bench.select("hash", "item", "at", "total")), "hash").select("id_", "item", "total", "at").distinct()
    counted = hits.groupBy("id_", "item", "total").agg(F.count("*").alias("matched")).where(F.col("matched") >= coverage * F.col("total"))
    pairs, _ = write_out(counted, "benchmark-pairs")
    slotted = bench.where("size(slots) > 0").select("item").distinct()
    open_pairs = pairs.join(slotted, "item", "left_semi")
    plain = pairs.join(slotted, "item", "left_anti").select("id_", "item", "total", "matched", F.lit(False).alias("changed"))

    near = open_pairs.select("id_", "item")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    again = source.join(near.select("id_").distinct(), "id_", "left_semi").dropDuplicates()
    again = again.select("id_", canonical_words(F.col("text_")).alias("w"), plain_words(F.col("text_")).alias("p"))
    again = again.select("id_", "p", F.posexplode(windows("w")).alias("pos", "hash")).join(hint(bench), "hash").join(near, ["id_", "item"])
    again = again.select("id_", "item", "total", "span", "at", "pos", "values", F.expr("transform(slots, k -> get(p, pos + k))").alias("own"))
    again, _ = write_out(again, "benchmark-slots")
    again = again.select("id_", "item", "total", "at", "values", "own", F.explode(occurrences()).alias("o"))
    place = ["id_", "item", "o"]
    partners = again.select(*place, F.explode(F.arrays_zip("values", "own")).alias("z")).groupBy(*place, F.lower("z.values").alias("value"), F.lower("z.own").alias("partner")).count()
    order = Window.partitionBy(*place, "value").orderBy(F.desc("count"), "partner")
    agreed = partners.withColumn("rank", F.row_number().over(order)).where("rank = 1").groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("value", "partner"))).alias("agreed"), F.max(F.col("value") != F.col("partner")).alias("changed"))
    judged = again.join(agreed, place, "left").where("size(values) = 0 or forall(sequence(0, size(values) - 1), k -> element_at(agreed, lower(get(values, k))) = lower(get(own, k)))")
    judged = judged.groupBy(*place, "total").agg(F.countDistinct("at").alias("matched"), F.coalesce(F.max("changed"), F.lit(False)).alias("changed")).where(F.col("matched") >= coverage * F.col("total"))
    best = judged.groupBy("id_", "item", "total").agg(F.max(F.struct("matched", (~F.col("changed")).alias("same"))).alias("best"))
    judged = best.select("id_", "item", "total", F.col("best.matched").alias("matched"), (~F.col("best.same")).alias("changed"))

    both = plain.unionByName(judged)
    short, _ = write_out(short_items(items, bench, item_id, item_text), "benchmark-short")
    listed = short.count()
    if listed:
        met = short_hits(source, F.broadcast(short) if listed <= BROADCAST_ROWS else short)
        both = both.unionByName(met.select("id_", "item", F.lit(1).cast("long").alias("total"), F.lit(1).cast("long").alias("matched"), F.lit(False).alias("changed")))
    return both.select(F.col("id_").alias(id_col), F.col("item").alias(item_id), F.col("total").cast("long").alias("n_windows"), F.col("matched").cast("long").alias("n_matched"), (F.col("matched") / F.col("total")).alias("coverage"), F.col("changed").alias("reparameterised"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
