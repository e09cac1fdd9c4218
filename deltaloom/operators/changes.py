"""Change rows between two versions of sections, segments, files and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltaloom.functions import similarity, text
from deltaloom.operators.code import core_text, function_table
from deltaloom.plans.session import materialise

ADDED, DELETED, MODIFIED = "added", "deleted", "modified"


def differs(old: Column, new: Column) -> Column:
    """Whether two texts differ in more than width, white space and zero-width marks; null counts as empty."""
    return text.fold_text(old) != text.fold_text(new)


def change_type(old: Column, new: Column) -> Column:
    """added, deleted or modified by which side has text."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(has(old) & ~has(new), DELETED).when(has(new) & ~has(old), ADDED).otherwise(MODIFIED)


def version_changes(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """Rows (key, change, old_body, new_body) of keyed texts: added, deleted, modified (in meaning), same."""
    a = old.select(F.col(key), F.col(body).alias("old_body"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key), F.col(body).alias("new_body"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("in_old").isNull(), ADDED).when(F.col("in_new").isNull(), DELETED).when(differs(F.col("old_body"), F.col("new_body")), MODIFIED).otherwise("same")
    return both.select(key, kind.alias("change"), "old_body", "new_body")


def title_changes(pairs: DataFrame, old_title: str, new_title: str) -> DataFrame:
    """Pairs whose titles differ by more than foot-note marks, width and white space."""
    return pairs.where((F.coalesce(old_title, F.lit("")) != F.coalesce(new_title, F.lit(""))) & (text.fold_title(old_title) != text.fold_title(new_title)))


def segment_changes(old: DataFrame, new: DataFrame, pairs: DataFrame, least_change: float = 0.0) -> DataFrame:
    """Changes of paired sections, segment by segment.

    ``old``/``new``: rows (ord, seg_id, body), one for each segment of a section; ``pairs``: (old_ord, new_ord, method,
    score), one side null for a whole section added or deleted. A section added or deleted with several segments gives one
    row with seg_id ``*`` whose text joins them in order. With ``least_change`` above zero a modified segment needs
    that dissimilarity.
    """
    tell = ["old_ord", "new_ord", "method", "score"]
    left = pairs.where("old_ord is not null").join(old.select(F.col("ord").alias("old_ord"), "seg_id", F.col("body").alias("old_body")), "old_ord")
    right = pairs.where("new_ord is not null").join(new.select(F.col("ord").alias("new_ord"), "seg_id", F.col("body").alias("new_body")), "new_ord")
    paired = lambda df: df.where("old_ord is not null and new_ord is not null")
    met = paired(left).select(*tell, "seg_id", "old_body").join(paired(right).select("old_ord", "new_ord", "seg_id", "new_body"), ["old_ord", "new_ord", "seg_id"], "full_outer")
    met = met.drop("method", "score").join(pairs.select(*tell), ["old_ord", "new_ord"])
    both = F.col("old_body").isNotNull() & F.col("new_body").isNotNull()
    met = met.withColumn("change", F.when(F.col("old_body").isNull(), ADDED).when(F.col("new_body").isNull(), DELETED).when(both & differs(F.col("old_body"), F.col("new_body")), change_type(F.col("old_body"), F.col("new_body"))))
    met = met.where("change is not null")
    if least_change > 0:
        met = met.where(~both | (1 - similarity.ratio(F.col("old_body"), F.col("new_body")) > least_change))
    columns = [*tell, "seg_id", "change", "old_body", "new_body"]

    def whole(rows: DataFrame, body: str, other: str, change: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", body))), lambda x: x[body]), "\n")
        out = rows.groupBy(*tell).agg(F.when(F.count("*") > 1, "*").otherwise(F.min("seg_id")).alias("seg_id"), joined.alias(body))
        return out.select(*tell, "seg_id", F.lit(change).alias("change"), *([F.col(body), F.lit(None).cast("string").alias(other)] if body == "old_body" else [F.lit(None).cast("string").alias(other), F.col(body)]))

    gone = whole(left.where("new_ord is null"), "old_body", "new_body", DELETED)
    come = whole(right.where("old_ord is null"), "new_body", "old_body", ADDED)
    return met.select(columns).unionByName(gone).unionByName(come)


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (rel_path, content) of two trees: added, deleted, modified by their bytes; equal files have no row."""
    both = old.select("rel_path", F.col("content").alias("old_text")).join(new.select("rel_path", F.col("content").alias("new_text")), "rel_path", "full_outer")
    kind = F.when(F.col("old_text").isNull(), ADDED).when(F.col("new_text").isNull(), DELETED).when(F.sha2("old_text", 256) != F.sha2("new_text", 256), MODIFIED)
    return both.withColumn("change", kind).where("change is not null")


def function_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aligned functions of two versions of each file.

    Rows (rel_path, ord, name, signature, body). The sequences of function cores (body without its first line) are
    aligned by an edit script; equal cores have no row, a replaced run pairs its members in order, what is left is new
    or deleted. Returns rel_path, change_kind, old_name, new_name, old_signature, new_signature, old_body, new_body. Only the script itself
    is made in Python; a file's functions are one row.
    """
    one = F.struct("ord", "name", "signature", F.coalesce("body", F.lit("")).alias("body"))
    side = lambda df, name: df.groupBy("rel_path").agg(F.array_sort(F.collect_list(one)).alias(name))
    both = side(old, "a").join(side(new, "b"), "rel_path", "full_outer")
    none = F.array().cast("array<string>")
    cores = lambda c: F.coalesce(F.transform(c, lambda f: core_text(f["body"])), none)
    ops = both.select("rel_path", "a", "b", cores(F.col("a")).alias("x"), cores(F.col("b")).alias("y")).where("x <> y")
    ops = ops.select("rel_path", "a", "b", F.explode(similarity.opcodes_udf("x", "y")).alias("op")).where("op.tag <> 'equal'")
    rows = ops.withColumn("gone", F.col("op.i2") - F.col("op.i1")).withColumn("come", F.col("op.j2") - F.col("op.j1")).withColumn("k", F.explode(F.expr("sequence(0, greatest(gone, come) - 1)")))
    rows = rows.select("rel_path", F.when(F.col("k") < F.col("gone"), F.get("a", F.col("op.i1") + F.col("k"))).alias("old"), F.when(F.col("k") < F.col("come"), F.get("b", F.col("op.j1") + F.col("k"))).alias("new"))
    kind = F.when(F.col("old").isNull(), "new_function").when(F.col("new").isNull(), "deleted_function").otherwise("modified_function")
    return rows.select("rel_path", kind.alias("change_kind"), *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("name", "signature", "body") for side in ("old", "new")])


def code_changes(old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Change rows (rel_path, change_kind, function_name, old_text, new_text) of two source trees (rel_path, content).

    C files that exist on both sides give their functions' changes, or one file_global_changed if the functions agree; a
    changed header is one header_changed; files on one side are new_file or deleted_file. Only files that
    differ on both sides are parsed.
    """
    files = materialise(file_changes(old_files, new_files), "file-changes")
    header = F.lower("rel_path").rlike(r"\.(h|hpp)$")
    by_file = F.when(F.col("change") == ADDED, "new_file").when(F.col("change") == DELETED, "deleted_file").when(header, "header_changed")
    whole = files.withColumn("change_kind", by_file)
    plain = whole.where("change_kind is not null").select("rel_path", "change_kind", F.lit("").alias("function_name"), "old_text", "new_text")
    both = whole.where("change_kind is null").select("rel_path", "old_text", "new_text")
    sides = (function_table(both.select("rel_path", F.col(text_col).alias("content"))) for text_col in ("old_text", "new_text"))
    inner = materialise(function_changes(*sides), "function-changes")
    rows = inner.select("rel_path", "change_kind", F.coalesce("new_name", "old_name").alias("function_name"), F.col("old_body").alias("old_text"), F.col("new_body").alias("new_text"))
    rest = both.join(rows.select("rel_path"), "rel_path", "left_anti").select("rel_path", F.lit("file_global_changed").alias("change_kind"), F.lit("").alias("function_name"), "old_text", "new_text")
    return plain.unionByName(rows).unionByName(rest)


def change_summary(changes: DataFrame, *columns: str) -> DataFrame:
    """Counts of change rows by the given columns."""
    return changes.groupBy(*columns).agg(F.count("*").alias("n"))


def table_rows_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two tables that differ, keyed; equal rows within a key cancel out as a multiset."""
    digest = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]))
    count = lambda df, name: df.groupBy(key, digest.alias("digest")).agg(F.count("*").alias(name))
    both = count(old, "a").join(count(new, "b"), [key, "digest"], "full_outer").fillna(0, ["a", "b"])
    per_key = both.groupBy(key).agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("gone"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("come"), F.sum("a").alias("n_old"), F.sum("b").alias("n_new"))
    kind = F.when(F.col("n_old") == 0, ADDED).when(F.col("n_new") == 0, DELETED).otherwise(MODIFIED)
    return per_key.where("gone > 0 or come > 0").select(key, kind.alias("change"), "gone", "come")


def sequence_rows_diff(old: DataFrame, new: DataFrame, columns: list[str], doc: str = "doc", ord_col: str = "ord") -> DataFrame:
    """Changed runs of rows of tables without a key: rows (doc, tag, at, old_rows, new_rows) by an edit script over the rows in order.

    A table is one value here, as it stands in one document.
    """
    row = F.concat_ws("\t", *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns])
    side = lambda df, name: df.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), row.alias("v")))), lambda x: x["v"]).alias(name))
    none = F.array().cast("array<string>")
    both = side(old, "a").join(side(new, "b"), doc, "full_outer").select(doc, F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")).where("a <> b")
    ops = both.select(doc, "a", "b", F.posexplode(similarity.opcodes_udf("a", "b")).alias("at", "op")).where("op.tag <> 'equal'")
    cut = lambda c, i, j: F.slice(c, F.col(i) + 1, F.col(j) - F.col(i))
    return ops.select(doc, F.col("op.tag").alias("tag"), F.col("op.i1").alias("at"), cut("a", "op.i1", "op.i2").alias("old_rows"), cut("b", "op.j1", "op.j2").alias("new_rows"))


def table_changes(old: DataFrame, new: DataFrame, columns: list[str], doc: str = "doc", ord_col: str = "ord") -> DataFrame:
    """Changed rows of tables (doc, ord, columns) by the first way that fits each: rows (doc, way, change, row_key, old_row, new_row).

    ``key``: the first column whose values are distinct and not blank on both sides pairs the rows; ``sequence``: without such a
    column an edit script over the rows in order tells what went and came; ``all``: a table on one side keeps all its rows.
    """
    value = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    row = F.concat_ws("\t", *[value(c) for c in columns])

    def fits(df: DataFrame, name: str) -> DataFrame:
        # sets of a table's values: distinct counts of several columns would shuffle a row for each column and value, twice
        stats = df.groupBy(doc).agg(*[((F.size(F.collect_set(value(c))) == F.count("*")) & (F.count_if(value(c) == "") == 0)).alias(c) for c in columns])
        return stats.select(doc, F.array(*columns).alias(name))

    ways = fits(old, "x").join(fits(new, "y"), doc, "full_outer")
    both = F.array_position(F.transform(F.arrays_zip("x", "y"), lambda z: z["x"] & z["y"]), True)
    ways = ways.select(doc, F.when(F.col("x").isNull() | F.col("y").isNull(), "all").when(both > 0, "key").otherwise("sequence").alias("way"), both.alias("which"))
    ways = materialise(ways, "table-ways")
    side = lambda df, name: df.join(ways, doc).withColumn(name, row)
    keyed = lambda df, name: side(df, name).where("way = 'key'").select(doc, F.element_at(F.array(*[value(c) for c in columns]), F.col("which").cast("int")).alias("row_key"), name)
    met = keyed(old, "old_row").join(keyed(new, "new_row"), [doc, "row_key"], "full_outer")
    kind = F.when(F.col("old_row").isNull(), ADDED).when(F.col("new_row").isNull(), DELETED).when(F.col("old_row") != F.col("new_row"), MODIFIED)
    paired = met.withColumn("change", kind).where("change is not null").select(doc, F.lit("key").alias("way"), "change", "row_key", "old_row", "new_row")
    only = lambda df: df.join(ways.where("way = 'sequence'"), doc, "left_semi")
    runs = sequence_rows_diff(only(old), only(new), columns, doc, ord_col)
    null = F.lit(None).cast("string")
    gone = runs.select(doc, F.lit("sequence").alias("way"), F.lit(DELETED).alias("change"), null.alias("row_key"), F.explode("old_rows").alias("old_row"), null.alias("new_row"))
    come = runs.select(doc, F.lit("sequence").alias("way"), F.lit(ADDED).alias("change"), null.alias("row_key"), null.alias("old_row"), F.explode("new_rows").alias("new_row"))
    whole = lambda df, change, name: side(df, name).where("way = 'all'").select(doc, "way", F.lit(change).alias("change"), null.alias("row_key"), *[F.col(c) if c == name else null.alias(c) for c in ("old_row", "new_row")])
    return paired.unionByName(gone).unionByName(come).unionByName(whole(old, DELETED, "old_row")).unionByName(whole(new, ADDED, "new_row"))


def change_snippets(rows: DataFrame, key: str, old: str = "old_text", new: str = "new_text", context: int = 3) -> DataFrame:
    """Changed runs of lines with ``context`` lines around them: rows (key, tag, line, old_snippet, new_snippet)."""
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n")
    ops = rows.select(key, lines(old).alias("a"), lines(new).alias("b")).withColumn("op", F.explode(similarity.opcodes_udf("a", "b"))).where("op.tag <> 'equal'")

    def cut(c: str, i: str, j: str) -> Column:
        first = F.greatest(F.col(i) - context, F.lit(0))
        return F.array_join(F.slice(c, first + 1, F.least(F.col(j) + context, F.size(c)) - first), "\n")

    return ops.select(key, F.col("op.tag").alias("tag"), (F.col("op.j1") + 1).alias("line"), cut("a", "op.i1", "op.i2").alias("old_snippet"), cut("b", "op.j1", "op.j2").alias("new_snippet"))


def key_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How well each column identifies rows: distinct and blank values; a key column has as many distinct as rows."""
    stats = rows.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in columns], *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"b_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"b_{c}").alias("n_blank"), ((F.col(f"d_{c}") == F.col("n")) & (F.col(f"b_{c}") == 0)).alias("is_key")) for c in columns])
    return stats.select(F.inline(each))


def four_way(doc: DataFrame, code: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two descriptions of the same things: same, conflict, only_doc, only_code (null-safe equality of all columns)."""
    a = doc.select(key, F.struct(*columns).alias("doc"))
    b = code.select(key, F.struct(*columns).alias("code"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("doc").isNull(), "only_code").when(F.col("code").isNull(), "only_doc").when(F.col("doc").eqNullSafe(F.col("code")), "same").otherwise("conflict")
    return both.select(key, kind.alias("status"))
