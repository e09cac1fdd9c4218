"""Ordered blocks to sections and segments: context carried forward by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions import text

#: Segment of the blocks before the first list item.
MAIN = "_MAIN"


def _so_far(doc: str, ord_col: str):
    return Window.partitionBy(doc).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(rows: DataFrame, value: Column, name: str, doc: str = "doc", ord_col: str = "ord", default=None) -> DataFrame:
    """The last non-null ``value`` up to each row of its document; ``default`` before the first."""
    filled = F.last(value, ignorenulls=True).over(_so_far(doc, ord_col))
    return rows.withColumn(name, filled if default is None else F.coalesce(filled, F.lit(default)))


def heading_context(blocks: DataFrame, doc: str = "doc", ord_col: str = "ord", deepest: int = 4) -> DataFrame:
    """Blocks (doc, ord, level int or null, text) with section_ord, title and key of the heading above each.

    A heading resets the deeper levels: level k shows only if it came after the last heading of every lesser level.
    Blocks before the first heading belong to no section (null).
    """
    so_far = _so_far(doc, ord_col)
    out = blocks
    for k in range(1, deepest + 1):
        at = F.when(F.col("level") == k, F.col(ord_col))
        out = out.withColumn(f"at{k}", F.max(at).over(so_far)).withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.col("text")), True).over(so_far))
    shown = []
    for k in range(1, deepest + 1):
        above = F.greatest(*[F.coalesce(F.col(f"at{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
        shown.append(F.when(F.col(f"at{k}") > above, F.col(f"h{k}")))
    out = out.withColumn("key", F.concat_ws(" > ", *shown)).withColumn("section_ord", F.max(F.when(F.col("level").isNotNull(), F.col(ord_col))).over(so_far))
    out = out.withColumn("title", F.last(F.when(F.col("level").isNotNull(), F.col("text")), True).over(so_far))
    return out.drop(*[f"{c}{k}" for c in ("at", "h") for k in range(1, deepest + 1)])


def segments(blocks: DataFrame, doc: str = "doc", section: str = "section_ord", ord_col: str = "ord", body: str = "text") -> DataFrame:
    """Blocks with seg_id (the list item above, MAIN before the first; reset in each section) and seg_pos from 0."""
    within = Window.partitionBy(doc, section).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("seg_id", F.coalesce(F.last(text.item_id(body), True).over(within), F.lit(MAIN)))
    return out.withColumn("seg_pos", F.row_number().over(Window.partitionBy(doc, section, "seg_id").orderBy(ord_col)) - 1)


def to_sections(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """One row for each section of heading_context and segments: its content as lines ``segment TAB text`` in order."""
    content = blocks.where(F.col("section_ord").isNotNull())
    line = F.when(F.col("level").isNull() & (F.trim("text") != ""), F.struct("seg_id", "ord", F.concat("seg_id", F.lit("\t"), F.trim("text")).alias("line")))
    grouped = content.groupBy(doc, "section_ord").agg(F.max("key").alias("key"), F.max("title").alias("title"), F.array_sort(F.collect_list(line)).alias("lines"), F.count_if(line.isNotNull()).alias("n_blocks"))
    return grouped.withColumn("body", F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).drop("lines")


def section_ends(headings: DataFrame, doc: str = "doc", ord_col: str = "ord", level: str = "level") -> DataFrame:
    """Headings with end_ord: the next heading of the same or a lesser level, null at the document's end."""
    after = Window.partitionBy(doc).orderBy(ord_col).rowsBetween(1, Window.unboundedFollowing)
    following = F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(level).alias("l"))).over(after)
    end = F.array_min(F.transform(F.filter(following, lambda x: x["l"] <= F.col(level)), lambda x: x["o"]))
    return headings.withColumn("end_ord", end)


def look_ahead(rows: DataFrame, hit: Column, value: Column, name: str, most: int = 11, doc: str = "doc", ord_col: str = "ord") -> DataFrame:
    """``value`` of the first of the next ``most`` rows for which ``hit`` holds; null for none."""
    ahead = Window.partitionBy(doc).orderBy(ord_col).rowsBetween(1, most)
    return rows.withColumn(name, F.first(F.when(hit, value), ignorenulls=True).over(ahead))


def module_units(headings: DataFrame, doc: str = "doc", ord_col: str = "ord", module_level: int = 1) -> DataFrame:
    """Units (headings below ``module_level``) with the module heading above them and their position in it."""
    filled = forward_fill(headings, F.when(F.col("level") <= module_level, F.col("text")), "module", doc, ord_col)
    filled = forward_fill(filled, F.when(F.col("level") <= module_level, F.col(ord_col)), "module_ord", doc, ord_col)
    units = filled.where((F.col("level") > module_level) & F.col("module").isNotNull())
    return units.withColumn("position", F.row_number().over(Window.partitionBy(doc, "module_ord").orderBy(ord_col))).select(doc, "module", F.col("text").alias("unit"), "level", "position")


def heading_functions(blocks: DataFrame, doc: str = "doc", ord_col: str = "ord", most: int = 11) -> DataFrame:
    """Which headings with a stable number describe which function: rows (doc, function, ids).

    A heading's function is the first one that is declared within the ``most`` blocks after it.
    """
    declared = F.regexp_extract("text", r"^\s*(?:[A-Za-z_]\w*[\s\*]+)+([A-Za-z_]\w*)\s*\([^()]*\)\s*;?\s*$", 1)
    seen = look_ahead(blocks.withColumn("declared_", declared), F.col("declared_") != "", F.col("declared_"), "function", most, doc, ord_col)
    named = seen.where(F.col("level").isNotNull() & F.col("function").isNotNull()).withColumn("id", text.document_id("text")).where("id is not null")
    return named.groupBy(doc, "function").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), "id"))), lambda x: x["id"]).alias("ids"))


def neighbours(rows: DataFrame, value: str, doc: str = "doc", ord_col: str = "ord") -> DataFrame:
    """Previous and next ``value`` in order."""
    order = Window.partitionBy(doc).orderBy(ord_col)
    return rows.withColumn(f"prev_{value}", F.lag(value).over(order)).withColumn(f"next_{value}", F.lead(value).over(order))


def renumber(rows: DataFrame, group: str, ord_col: str, prefix: str = "M", width: int = 3) -> DataFrame:
    """A fresh id for each row: prefix, group, zero-padded position (never cut) in the group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(ord_col)).cast("string")
    padded = F.lpad(nth, F.greatest(F.length(nth), F.lit(width)), F.lit("0"))
    return rows.withColumn("new_id", F.concat(F.lit(prefix), F.col(group).cast("string"), F.lit("_"), padded))


def next_id(ids: DataFrame, column: str) -> DataFrame:
    """For each ``prefix_N`` family of ids the next free one, as wide as its widest member."""
    parts = ids.select(F.regexp_extract(column, r"^(.+?)_(\d+)$", 1).alias("prefix"), F.regexp_extract(column, r"^(.+?)_(\d+)$", 2).alias("n")).where("n <> ''")
    top = parts.groupBy("prefix").agg(F.max(F.col("n").cast("long")).alias("last"), F.max(F.length("n")).alias("width"))
    number = (F.col("last") + 1).cast("string")
    return top.select("prefix", F.concat("prefix", F.lit("_"), F.lpad(number, F.greatest(F.length(number), F.col("width")), F.lit("0"))).alias("next_id"))


def unique_titles(rows: DataFrame, title: str, identity: str) -> DataFrame:
    """Titles with duplicates told apart: the first by identity keeps its title, the others get ``_n``, n from 2, past names that exist.

    The numbers that existing titles take from a family (``a_2`` from ``a``) leave gaps; the k-th duplicate gets the k-th number that is
    free. Both are merged in one order: before the j-th taken number t there are t - 1 - j free ones.
    """
    nth = F.row_number().over(Window.partitionBy(title).orderBy(identity))
    numbered = rows.withColumn("nth_", nth)
    taken = rows.select(F.regexp_extract(title, r"(?s)^(.*)_([1-9]\d{0,17})$", 1).alias("base_"), F.regexp_extract(title, r"(?s)^(.*)_([1-9]\d{0,17})$", 2).alias("n_")).where("n_ <> ''")
    taken = taken.select("base_", F.col("n_").cast("long").alias("n_")).where("n_ >= 2").distinct()
    order = Window.partitionBy("base_").orderBy("n_")
    gaps = taken.select(F.col("base_").alias(title), (F.col("n_") - F.row_number().over(order)).alias("at_"), F.lit(1).alias("taken_"))  # reached from the at_-th duplicate on
    again = numbered.where("nth_ > 1").select(title, (F.col("nth_") - 1).cast("long").alias("at_"), F.lit(0).alias("taken_")).distinct()
    merged = Window.partitionBy(title).orderBy("at_", F.desc("taken_")).rowsBetween(Window.unboundedPreceding, 0)
    placed = gaps.unionByName(again).withColumn("shift_", F.sum("taken_").over(merged)).where("taken_ = 0").select(title, (F.col("at_") + 1).alias("nth_"), "shift_")
    both = numbered.join(placed, [title, "nth_"], "left")
    name = F.when(F.col("shift_").isNull(), F.col(title)).otherwise(F.concat(F.col(title), F.lit("_"), (F.col("nth_") + F.col("shift_")).cast("string")))
    return both.select(*[c for c in rows.columns if c != "unique_title"], name.alias("unique_title"))


def diagnostic(rows: DataFrame, title: str = "title", key: str = "key", doc: str | None = None) -> DataFrame:
    """Rows with document_id, duplicate_key and duplicate_id: whether their key or document number stands in other rows too.

    Counts are made in each ``doc``, or over all rows. Empty and null keys and numbers are no duplicates.
    """
    within = [doc] if doc else []
    known = rows.withColumn("document_id", text.document_id(title))
    held = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    counts = lambda c, name: known.where(held(c)).groupBy(*within, c).agg((F.count("*") > 1).alias(name))
    out = known.join(counts(key, "duplicate_key"), [*within, key], "left").join(counts("document_id", "duplicate_id"), [*within, "document_id"], "left")
    return out.select(*rows.columns, "document_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("duplicate_key", "duplicate_id")])


def nesting(lines: DataFrame, doc: str = "doc", ord_col: str = "ord", body: str = "text") -> DataFrame:
    """Brace depth before and after each line, as prefix sums."""
    delta = F.length(F.regexp_replace(F.coalesce(body, F.lit("")), r"[^{]", "")) - F.length(F.regexp_replace(F.coalesce(body, F.lit("")), r"[^}]", ""))
    out = lines.withColumn("depth_after", F.sum(delta).over(_so_far(doc, ord_col)))
    return out.withColumn("depth_before", F.col("depth_after") - delta)


def drop_void_else(lines: DataFrame, doc: str = "doc", ord_col: str = "ord", body: str = "text") -> DataFrame:
    """Lines without an ELSE directly before END IF, and one of adjacent equal lines; source_ords keeps what each stands for."""
    order = Window.partitionBy(doc).orderBy(ord_col)
    kept = lines.where(F.trim(body) != "").withColumn("next_", F.lead(F.upper(F.trim(body))).over(order))
    kept = kept.where(~((F.upper(F.trim(body)) == "ELSE") & F.coalesce(F.col("next_") == "END IF", F.lit(False)))).drop("next_")
    kept = kept.withColumn("new_", F.coalesce((F.lag(body).over(order) != F.col(body)).cast("int"), F.lit(1)))
    kept = kept.withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy(doc, "island_").agg(F.min(ord_col).alias(ord_col), F.min(body).alias(body), F.sort_array(F.collect_list(ord_col)).alias("source_ords")).drop("island_")
