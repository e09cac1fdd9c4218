"""Tickets: ledger rows, numbering, rule scores against changes, one-to-one assignment, pluggable strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions import similarity, text
from deltaloom.operators.assign import greedy
from deltaloom.operators.candidates import containment_pairs, length_pairs
from deltaloom.operators.ordering import number_rows
from deltaloom.plans.session import materialise

#: Least scores of the rules and of an external matcher.
LEAST_RULES, LEAST_EXTERNAL = 0.42, 0.55
#: Fixed value: least text similarity.
LEAST_RATIO = 0.55
#: Tickets that are broadcast: few tickets are hot keys of a shuffle.
FEW_TICKETS = 10_000
#: Words of code that identify nothing.
STOP_WORDS = "int void char return if else for while switch case const static struct uint16 uint32 uint8 true false null".split()
PATH = r"[A-Za-z0-9_./\\-]+\.(?:c|h|cpp|hpp|py|java)\b"
IDENT = r"\b[A-Za-z_][A-Za-z0-9_]+\b"


def ticket_prefix(prefix) -> Column:
    """An upper-case prefix without blanks and trailing hyphens; a bare model name gets -WT."""
    p = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(F.col(prefix) if isinstance(prefix, str) else prefix, F.lit("")), r"\s+", "")), "[-_]+$", "")
    return F.when((p != "") & ~p.endswith("-WT") & p.rlike("^[A-Z0-9]+$"), F.concat(p, F.lit("-WT"))).otherwise(p)


def ticket_number(prefix, seq, width: int = 2) -> Column:
    """PREFIX-NN, the number at least ``width`` wide; empty without a prefix."""
    p = ticket_prefix(prefix)
    n = F.greatest(F.lit(1), (F.col(seq) if isinstance(seq, str) else seq).cast("long")).cast("string")
    return F.when(p == "", "").otherwise(F.concat(p, F.lit("-"), F.lpad(n, F.greatest(F.length(n), F.lit(max(1, width))), F.lit("0"))))


def ensure_number(raw, seq, prefix, width: int = 2) -> Column:
    """A full number as it is, a bare prefix completed, nothing made from the default prefix."""
    own = F.trim(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")))
    return F.when(own.rlike(r"-\d+$"), own).when(own != "", F.coalesce(F.nullif(ticket_number(own, seq, width), F.lit("")), own)).otherwise(ticket_number(prefix, seq, width))


def heading(index: Column, change: Column, key: Column, seg: Column, number: Column) -> Column:
    """Display heading of a change: (problem N, change[, number])key - segment."""
    k, s, n = (F.trim(F.coalesce(c, F.lit(""))) for c in (key, seg, number))
    head = F.concat(F.lit("(problem "), index.cast("string"), F.lit(", "), change, F.when(n != "", F.concat(F.lit(", "), n)).otherwise(""), F.lit(")"))
    return F.concat(head, F.when((k != "") & (s != ""), F.concat(k, F.lit(" - "), s)).otherwise(F.concat(k, s)))


def last_by_seq(rows: DataFrame, seq: str = "seq", ord_col: str = "ord") -> DataFrame:
    """One ticket for each number: the last in the ledger."""
    order = Window.partitionBy(seq).orderBy(F.desc(ord_col))
    return rows.where(F.col(seq).isNotNull()).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def by_position(changes: DataFrame, tickets: DataFrame, ord_col: str = "ord", start: int = 1, prefix: str = "") -> DataFrame:
    """Changes numbered from ``start`` in order, with the ticket of that number; numbers are made from ``prefix``."""
    numbered = number_rows(changes, [F.col(ord_col)], "problem_index", max(1, start))
    both = numbered.join(tickets.select(F.col("seq").cast("long").alias("problem_index"), F.col("title").alias("ticket_title"), "ticket_no"), "problem_index", "left")
    return both.withColumn("ticket_no", ensure_number("ticket_no", "problem_index", F.lit(prefix))).withColumn("ticket_title", F.coalesce("ticket_title", F.lit("")))


def _distinct_fold(values: Column) -> Column:
    return F.array_distinct(F.transform(values, F.lower))


def document_ids(body: Column) -> Column:
    """Upper-case document numbers in a text."""
    slash = F.regexp_extract_all(body, F.lit(f"({text.ID_SLASH})"), F.lit(1))
    parts = F.filter(F.regexp_extract_all(body, F.lit(f"({text.ID_PARTS})"), F.lit(1)), lambda x: x.rlike(r"\d"))
    return F.array_distinct(F.transform(F.concat(slash, parts), F.upper))


def features(rows: DataFrame, body: Column, seg: Column | None = None, most: int = 40) -> DataFrame:
    """Adds ids, paths, idents (arrays, lower case; ids upper) found in ``body``; ``seg`` counts as an identifier."""
    paths = F.transform(F.regexp_extract_all(body, F.lit(f"({PATH})"), F.lit(1)), lambda p: F.lower(F.replace(p, F.lit("\\"), F.lit("/"))))
    words = F.filter(_distinct_fold(F.regexp_extract_all(body, F.lit(f"({IDENT})"), F.lit(1))), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    own = F.when(F.length(seg) >= 4, F.array(F.lower(seg))).otherwise(F.array().cast("array<string>")) if seg is not None else F.array().cast("array<string>")
    return rows.withColumn("ids", document_ids(body)).withColumn("paths", F.array_distinct(paths)).withColumn("idents", F.array_distinct(F.concat(own, F.slice(words, 1, most))))


def rule_scores(tickets: DataFrame, changes: DataFrame, least: float = LEAST_RULES, with_text: bool = True) -> DataFrame:
    """Rows (change_id, seq, score, reason) of pairs that reach ``least`` by the best rule.

    ``tickets``: (seq, title, ids, paths, idents); ``changes``: (change_id, key, seg, blob, ids, paths, idents). Numbers, paths, file
    names and symbols meet in equi-joins. The rules on titles look into both texts: candidates come from an index of grams, on either side,
    and are tested then. The text similarity (``with_text``) sees pairs whose lengths allow it, met by bands of lengths.
    """
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    squeeze = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    title, key_path = F.trim(F.coalesce("title", F.lit(""))), F.lower(F.replace(F.coalesce("key", F.lit("")), F.lit("\\"), F.lit("/")))
    core = F.trim(F.regexp_replace(title, "(需求变更|变更|修改|冗余|删除|新增|问题)$", ""))
    t = tickets.select("seq", title.alias("title"), core.alias("core"), squeeze(title).alias("short"), "ids", "paths", "idents")
    paths = F.when(key_path.contains("/") | key_path.rlike(r"\.[ch]$"), F.array_append("paths", key_path)).otherwise(F.col("paths"))
    c = changes.select("change_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("key", "blob")], F.trim(text.leaf_title("key")).alias("leaf"), squeeze(F.substring(F.coalesce("blob", F.lit("")), 1, 500)).alias("body"), "ids", paths.alias("paths"), F.array_append("idents", F.lower(F.coalesce("seg", F.lit("")))).alias("idents"))
    t, c = materialise(t, "tickets"), materialise(c, "ticket-changes")
    whole_side = F.broadcast if t.limit(FEW_TICKETS + 1).count() <= FEW_TICKETS else lambda df: df

    def shared(column: str, kind: str, score: Callable[[Column], Column], values: Callable[[Column], Column] = lambda v: v, good: Callable[[Column], Column] = lambda v: F.lit(True)) -> DataFrame:
        side = lambda df, key: df.select(key, F.explode(F.array_distinct(F.transform(column, values))).alias("value"))
        met = side(c, "change_id").join(whole_side(side(t, "seq")), "value").where(good(F.col("value")))
        best = met.groupBy("change_id", "seq").agg(F.min(F.struct((-score(F.col("value"))).alias("s"), (-F.length("value")).alias("l"), "value")).alias("m"))
        return best.select("change_id", "seq", F.lit(kind).alias("kind"), (-F.col("m.s")).alias("score"), F.concat(F.lit(f"{kind}:"), "m.value").alias("why"))

    found = shared("ids", "doc_id", lambda v: F.lit(0.95))
    whole = materialise(shared("paths", "path", lambda v: F.lit(0.88)), "ticket-paths")
    found = found.unionByName(whole).unionByName(shared("paths", "file", lambda v: F.lit(0.80), base).join(whole, ["change_id", "seq"], "left_anti"))
    found = found.unionByName(shared("idents", "symbol", lambda v: F.when(F.length(v) >= 6, 0.82).otherwise(0.72), good=lambda v: F.length(v) >= 4))

    name, key, leaf, word = (F.col(x) for x in ("title", "key", "leaf", "core"))
    in_leaf = (leaf != "") & (leaf.contains(name) | name.contains(leaf))
    titled = F.when(in_leaf, "leaf").when(key.contains(name), "key").when((F.length(word) >= 2) & (key.contains(word) | F.col("blob").contains(word)), "keyword")

    def scored(pairs: DataFrame) -> DataFrame:
        kind = F.col("kind")
        score = F.when(kind == "leaf", 0.70).when(kind == "key", 0.68).otherwise(0.62)
        why = F.when(kind == "keyword", F.concat(F.lit("keyword:"), F.substring("core", 1, 20))).otherwise(F.concat(F.lit("title<"), kind))
        return pairs.withColumn("kind", titled).where("kind is not null").select("change_id", "seq", "kind", score.alias("score"), why.alias("why"))

    named, plain = t.where("length(title) >= 2").select("seq", "title", "core"), c.select("change_id", "key", "leaf", "blob")
    # what holds the title holds its core, so one look-up finds both
    sought = named.select("seq", F.when(F.length("core") >= 2, F.col("core")).otherwise(F.col("title")).alias("needle"))
    texts = plain.select("change_id", F.concat_ws("\n", "leaf", "key", "blob").alias("hay"))
    met = containment_pairs(sought, texts, "seq", "needle", "change_id", "hay")
    inner = containment_pairs(plain.where("leaf <> ''").select("leaf").distinct(), named, "leaf", "leaf", "seq", "title")
    inner = inner.join(whole_side(named.select("seq", "title")), "seq").where(F.col("title").contains(F.col("leaf"))).join(plain.select("change_id", "leaf"), "leaf").select("seq", "change_id")
    pairs = met.unionByName(inner).distinct().join(whole_side(named), "seq").join(plain.hint("merge"), "change_id")
    found = found.unionByName(scored(pairs))
    if with_text:
        part = F.substring("body", F.lit(1), F.greatest(F.length("short") * 3, F.lit(80)))
        asked, told = t.select("seq", "short"), c.select("change_id", "body")
        # a body cut to three titles, or to 80 characters, is too long for the ratio; so whole bodies are compared
        met = length_pairs(told, asked, F.length("body"), F.length("short"), LEAST_RATIO)
        near = met.withColumn("ratio", similarity.ratio(F.col("short"), part, junk=True)).where(F.col("ratio") >= LEAST_RATIO)
        found = found.unionByName(near.select("change_id", "seq", F.lit("sim").alias("kind"), (0.45 + 0.25 * F.col("ratio")).alias("score"), F.concat(F.lit("sim:"), F.format_number("ratio", 2)).alias("why")))
    rank = F.array_position(F.array(*map(F.lit, ("doc_id", "path", "file", "symbol", "leaf", "key", "keyword", "sim"))), F.col("kind"))
    reasons = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "why"))), lambda x: x["why"])
    best = found.groupBy("change_id", "seq").agg(F.least(F.lit(1.0), F.max("score")).alias("score"), F.array_join(F.slice(reasons, 1, 3), "+").alias("reason"))
    return best.where(F.col("score") >= least)


def assign(scores: DataFrame) -> DataFrame:
    """Each change and each ticket at most once, by falling score, then change, then ticket."""
    return greedy(scores, "change_id", "seq", "score")


def ordered(changes: DataFrame, matches: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Changes with their ticket: matched ones first by ticket number, then the rest in order; position from 1."""
    both = changes.join(matches.select("change_id", "seq", "score", "reason"), "change_id", "left")
    return number_rows(both, [F.col("seq").isNull(), F.col("seq"), F.col(ord_col)], "position")


def match_report(changes: DataFrame, tickets: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts: changes, tickets, matched, unmatched on either side, mean score."""
    sums = matches.agg(F.count("*").alias("matched"), F.round(F.avg("score"), 4).alias("mean_score"))
    a = changes.join(matches, "change_id", "left_anti").agg(F.count("*").alias("unmatched_changes"))
    b = tickets.join(matches, "seq", "left_anti").agg(F.count("*").alias("unmatched_tickets"))
    return sums.join(a, F.lit(True)).join(b, F.lit(True))


#: A strategy takes (tickets, changes) and returns rows (change_id, seq, score, reason).
Strategy = Callable[[DataFrame, DataFrame], DataFrame]
STRATEGIES: dict[str, Strategy] = {"rules": lambda tickets, changes: assign(rule_scores(tickets, changes))}


def register(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def external(answers: DataFrame, least: float = LEAST_EXTERNAL) -> Strategy:
    """A strategy of an external matcher's answers (change_id, seq, score, reason), bounded and made one-to-one."""

    def run(tickets: DataFrame, changes: DataFrame) -> DataFrame:
        known = answers.where(F.col("score") >= least).join(tickets.select("seq"), "seq", "left_semi").join(changes.select("change_id"), "change_id", "left_semi")
        return assign(known.select("change_id", "seq", "score", "reason"))

    return run


def hybrid(first: Strategy, second: Strategy) -> Strategy:
    """The first strategy, then the second on the tickets and changes that it left."""

    def run(tickets: DataFrame, changes: DataFrame) -> DataFrame:
        found = first(tickets, changes)
        more = second(tickets.join(found, "seq", "left_anti"), changes.join(found, "change_id", "left_anti"))
        return found.unionByName(more)

    return run


def answers_from_text(rows: DataFrame, column: str) -> DataFrame:
    """Matcher answers from free text: the first {...}, fences or not, with alias names of its fields."""
    schema = "matches array<struct<ticket_seq:int,seq:int,change_index:int,index:int,score:double,confidence:double,reason:string>>, results array<struct<ticket_seq:int,seq:int,change_index:int,index:int,score:double,confidence:double,reason:string>>"
    body = F.regexp_extract(F.coalesce(column, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = rows.withColumn("p_", F.from_json(body, schema))
    one = parsed.select(F.explode(F.coalesce("p_.matches", "p_.results")).alias("m"))
    return one.select(F.coalesce("m.change_index", "m.index").alias("change_id"), F.coalesce("m.ticket_seq", "m.seq").alias("seq"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("m.score", "m.confidence"))).alias("score"), F.coalesce("m.reason", F.lit("")).alias("reason")).where("change_id is not null and seq is not null and score is not null")
