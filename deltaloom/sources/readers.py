"""Ledgers, JSON lists, dictionaries, code trees, block documents and markdown requirements as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from deltaloom.functions import text
from deltaloom.operators.ordering import number_rows

#: Header names of a ticket ledger, by the column they mean.
ALIASES = {
    "seq": ("序号", "seq", "no", "index", "编号"),
    "title": ("问题", "问题描述", "title", "problem", "description"),
    "ticket_no": ("问题单编号", "问题单号", "单号", "ticket_no", "ticket", "ticketno"),
}
#: Encodings tried in order.
CODE_ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")
EXCLUDED_DIRS = ("build", "out", "dist", "node_modules", "__pycache__")


@pandas_udf(T.StringType())
def decode_udf(content: pd.Series) -> pd.Series:
    """Bytes as text by the first encoding that fits."""

    def decode(raw):
        for name in CODE_ENCODINGS:
            try:
                return bytes(raw or b"").decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(raw or b"").decode("utf-8", "replace")

    return content.map(decode)


def map_headers(columns: list[str]) -> dict[str, str]:
    """Which column means what: by exact alias, then by suffix, then by position."""
    fold = lambda name: name.strip().lower().replace(" ", "")
    found: dict[str, str] = {}
    for want, names in ALIASES.items():
        exact = next((c for c in columns if fold(c) in names and c not in found.values()), None)
        ending = next((c for c in columns if any(fold(c).endswith(n) for n in names) and c not in found.values()), None)
        if exact or ending:
            found[want] = exact or ending
    if "seq" not in found and "title" not in found:
        found |= {want: c for want, c in zip(ALIASES, columns) if c not in found.values()}
    return found


def ticket_rows(raw: DataFrame) -> DataFrame:
    """Ledger rows (seq, title, ticket_no): headers mapped, numbers found in text, the last of a repeated seq kept."""
    names = map_headers(raw.columns)
    pick = lambda want: F.trim(F.coalesce(F.col(f"`{names[want]}`").cast("string"), F.lit(""))) if want in names else F.lit("")
    numbered = raw.withColumn("line_", F.monotonically_increasing_id())  # order within the ledger
    seq = F.regexp_extract(pick("seq"), r"(\d+)", 1).try_cast("int")
    rows = numbered.select(seq.alias("seq"), pick("title").alias("title"), pick("ticket_no").alias("ticket_no"), "line_").where("seq is not null")
    last = Window.partitionBy("seq").orderBy(F.desc("line_"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("seq", "title", "ticket_no")


def read_ticket_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A delimited ledger; the delimiter is the one of , TAB ; that the header line holds most."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = max(",\t;", key=line.count)
    return ticket_rows(spark.read.option("encoding", encoding).csv(path, header=True, sep=sep))


def read_ticket_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON ledger: a list, or a list under tickets, items or 问题单."""
    raw = spark.read.option("multiLine", True).json(path)
    for box in ("tickets", "items", "问题单"):
        if box in raw.columns:
            raw = raw.select(F.explode(box).alias("t")).select("t.*")
            break
    return ticket_rows(raw)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """By file name: .json, else delimited text."""
    return read_ticket_json(spark, path) if path.lower().endswith(".json") else read_ticket_csv(spark, path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of change rows, numbered in order; missing fields are null."""
    fields = "language string, change_kind string, key string, seg string, function_name string, old_function_name string, new_function_name string, old_text string, new_text string"
    rows = spark.read.schema(fields).option("multiLine", True).json(path)
    return rows.withColumn("idx", F.monotonically_increasing_id())


def read_decisions(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Decision rows under ``decisions``; another schema version is refused, rows without a decision are left out."""
    raw = spark.read.option("multiLine", True).schema("schema_version int, decisions array<struct<key:string,source_hash:string,decision:string,rel_path:string,function_name:string>>").json(path)
    seen = [row[0] for row in raw.select("schema_version").distinct().limit(2).collect()]
    if any(v is not None and v != version for v in seen):
        raise ValueError(f"schema version {seen}, not {version}")
    return raw.select(F.inline("decisions")).where(F.coalesce(F.trim("decision"), F.lit("")) != "")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure rows (func_name, file_path, error_type, error_message), listed or under ``failures``."""
    one = "struct<func_name:string,file_path:string,error_type:string,error_message:string,task:struct<func_name:string,source_file:string>>"
    raw = spark.read.option("multiLine", True).schema(f"failures array<{one}>, func_name string, file_path string, error_type string, error_message string, task struct<func_name:string,source_file:string>").json(path)
    rows = raw.select(F.explode("failures").alias("f")).select("f.*").unionByName(raw.where("failures is null").drop("failures"))
    return rows.select(F.coalesce("func_name", "task.func_name").alias("func_name"), F.coalesce("file_path", "task.source_file", F.lit("")).alias("file_path"), F.coalesce("error_type", F.lit("unknown")).alias("error_type"), F.coalesce("error_message", F.lit("")).alias("error_message")).where("func_name is not null")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A symbol dictionary (ident, cn, section), flat or in sections."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("k", "v"))
    inner = raw.where(F.col("v").startswith("{")).select(F.col("k").alias("section"), F.explode(F.from_json("v", "map<string,string>")).alias("ident", "cn"))
    flat = raw.where(~F.col("v").startswith("{")).select(F.lit("symbols").alias("section"), F.col("k").alias("ident"), F.col("v").alias("cn"))
    return inner.unionByName(flat).select(F.trim("ident").alias("ident"), F.trim("cn").alias("cn"), "section").where("ident <> '' and cn <> ''")


def read_index(spark: SparkSession, path: str, box: str | None = None) -> DataFrame:
    """A side-car index (key, fields map<string,string>): a JSON object of objects, of strings, or a list of objects with a key.

    With ``box`` the index lies under that name. A plain value becomes the field ``value``; of a list's objects the first of
    key, id, ident, symbol and name is the key. Entries without a key are left out.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    if box:
        raw = raw.select(F.from_json("v", "map<string,string>")[F.lit(box)].alias("v"))
    body = F.trim("v")
    listed = raw.where(body.startswith("[")).select(F.explode(F.from_json("v", "array<map<string,string>>")).alias("fields"))
    keys = F.coalesce(*[F.nullif(F.trim(F.col("fields")[F.lit(name)]), F.lit("")) for name in ("key", "id", "ident", "symbol", "name")])
    named = raw.where(body.startswith("{")).select(F.explode(F.from_json("v", "map<string,string>")).alias("key", "entry"))
    fields = F.when(F.trim("entry").startswith("{"), F.from_json("entry", "map<string,string>")).otherwise(F.create_map(F.lit("value"), "entry"))
    return listed.select(keys.alias("key"), "fields").unionByName(named.select(F.trim("key").alias("key"), fields.alias("fields"))).where("key <> ''")


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".c", ".h"), excluded: tuple[str, ...] = EXCLUDED_DIRS) -> DataFrame:
    """Files below ``root`` (rel_path, content, mtime, size) by extension, without dot-files and excluded folders."""
    glob = "*{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.substring_index("path", base, -1), r"^/+", "")
    kept = files.withColumn("rel_path", rel).where(~F.col("rel_path").rlike(r"(^|/)\.") & ~F.col("rel_path").rlike(rf"(^|/)(?:{'|'.join(excluded)})/"))
    return kept.select("rel_path", decode_udf("content").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def layer(path: Column) -> Column:
    """Layer of a file by its path: driver, middle or application."""
    p = F.lower(path)
    return F.when(p.rlike(r"(^|[/_])(?:drv|driver|bsp|hal)"), "driver").when(p.rlike(r"(^|[/_])(?:mid|middle|service)"), "middle").otherwise("application")


def ordered_files(files: DataFrame, wanted: DataFrame, explicit_only: bool = False) -> DataFrame:
    """Files in an explicit order (rel_path, ord); the others follow by layer and path unless ``explicit_only``."""
    first = files.join(wanted.select("rel_path", "ord"), "rel_path").select("rel_path", F.lit(0).alias("part"), "ord", F.lit("").alias("layer"))
    rest = files.join(wanted, "rel_path", "left_anti").select("rel_path", F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord"), layer(F.col("rel_path")).alias("layer"))
    both = first if explicit_only else first.unionByName(rest)
    return number_rows(both, [F.col(c) for c in ("part", "ord", "layer", "rel_path")], "position").select("rel_path", "position")


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of texts as ordered blocks (doc, ord, text)."""
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("ord", "text"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items of pages as ordered blocks (doc, ord, level, text)."""
    found = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?s)<(h[1-4]|p|li)[^>]*>(.*?)</"), F.lit(0))).alias("ord", "raw"))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>|</$", ""), r"\s+", " "))
    return found.select("doc", "ord", F.regexp_extract("raw", "^<h([1-4])", 1).try_cast("int").alias("level"), body.alias("text"))


def markdown_functions(docs: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """Functions of markdown requirements: headings ``### name``, the prototype and table rows ``| name | type | text |`` below."""
    lines = text_blocks(docs, id_col, text_col)
    order = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("text", r"^#{2,4}\s+`?([A-Za-z_]\w*)`?", 1), F.lit(""))
    lines = lines.withColumn("function", F.last(head, True).over(order)).where("function is not null")
    cells = F.transform(F.split(F.regexp_replace("text", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    row = F.col("text").rlike(r"^\s*\|") & ~F.col("text").rlike(r"^[\s|:-]+$") & ~F.lower("text").rlike(r"^\s*\|\s*(?:name|参数|名称)\s*\|")
    param = F.when(row, F.struct("ord", F.get(cells, F.lit(0)).alias("name"), F.get(cells, F.lit(1)).alias("type"), F.get(cells, F.lit(2)).alias("text")))
    proto = F.when(F.col("text").rlike(r"[A-Za-z_]\w*\s+\**\w+\s*\([^)]*\)\s*;?\s*$"), F.regexp_extract("text", r"([A-Za-z_][\w\s\*]*\([^)]*\))", 1))
    return lines.groupBy("doc", "function").agg(F.min("ord").alias("ord"), F.first(proto, True).alias("prototype"), F.array_sort(F.collect_list(param)).alias("params"))


def markdown_macros(docs: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """Macros of markdown requirements, from ``#define`` lines and ``| NAME | value | text |`` rows; the first non-empty value and text win."""
    lines = text_blocks(docs, id_col, text_col)
    define = lines.select("doc", "ord", F.regexp_extract("text", r"#define\s+([A-Z_]\w*)", 1).alias("name"), F.regexp_extract("text", r"#define\s+[A-Z_]\w*\s+([^/\s]+)", 1).alias("value"), F.trim(F.regexp_extract("text", r"/[/*]\s*(.*?)\s*(?:\*/)?$", 1)).alias("note"))
    rows = lines.select("doc", "ord", F.regexp_extract("text", r"^\s*\|\s*`?([A-Z_][A-Z0-9_]+)`?\s*\|", 1).alias("name"), F.trim(F.regexp_extract("text", r"^\s*\|[^|]*\|([^|]*)\|", 1)).alias("value"), F.trim(F.regexp_extract("text", r"^\s*\|[^|]*\|[^|]*\|([^|]*)\|", 1)).alias("note"))
    both = define.unionByName(rows).where("name <> ''")
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.col(c) != "", F.col("ord")))
    return both.groupBy("doc", "name").agg(first("value").alias("value"), first("note").alias("note"))


def graph_tables(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a code graph stored as Parquet, by column names."""
    n = spark.read.parquet(nodes).select("id", "name", "kind", "qualified_name", "file_path", "start_line", "end_line", "signature")
    return n, spark.read.parquet(edges).select("source", "target", "kind", "line")


def graph_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a code graph in an SQLite file, read page by page by the driver and handed on as Arrow batches.

    A database file is one machine's; larger graphs come as Parquet (``graph_tables``).
    """
    import sqlite3

    import pyarrow as pa

    wanted = {"nodes": "id, name, kind, qualified_name, file_path, start_line, end_line, signature", "edges": "source, target, kind, line"}
    tables = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for name, columns in wanted.items():
            names = columns.split(", ")
            parts, cursor = [], con.execute(f"select {columns} from {name}")
            while rows := cursor.fetchmany(100_000):
                parts.append(pa.table({c: [row[k] for row in rows] for k, c in enumerate(names)}))
            numbers = ("id", "source", "target", "start_line", "end_line", "line")
            shape = pa.schema([(c, pa.int64() if c in numbers else pa.string()) for c in names])
            tables.append(spark.createDataFrame(pa.concat_tables([p.cast(shape) for p in parts]) if parts else shape.empty_table()))
    return tables[0], tables[1]


def pick_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each wanted (name, file_path): one of the same path first, then the least path and line."""
    met = wanted.select("name", F.col("file_path").alias("asked")).join(nodes, "name")
    order = Window.partitionBy("name", "asked").orderBy(F.when(text.plain_path("file_path") == text.plain_path("asked"), 0).otherwise(1), "file_path", "start_line")
    return met.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
