"""Normalisers of text, titles, keys and identifiers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Zero-width code points that never matter in a comparison.
ZERO_WIDTH = "[\u200b-\u200d\ufeff]"
#: White space other than the line feed.
BLANK = "[ \t\x0b\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Shapes of stable document numbers inside parentheses.
ID_SLASH = r"[A-Za-z]+/[A-Za-z0-9_./-]+"
ID_PARTS = r"[A-Za-z]{2,}[-_][A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+"
ID_MIXED = r"[A-Za-z]{2,}\d[\w.-]*"
#: Suffixes that tell a width or type in an identifier.
TYPE_SUFFIXES = ("_u8", "_u16", "_u32", "_i16", "_i32", "_f")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_width(text) -> Column:
    """Zero-width code points removed; full-width parentheses and spaces to their plain forms."""
    return F.translate(F.regexp_replace(_col(text), ZERO_WIDTH, ""), "\uff08\uff09\u3000", "() ")


def fold_text(text) -> Column:
    """Text as compared for meaning: width, white space within lines and blank edges do not count. Null is empty."""
    folded = F.regexp_replace(half_width(F.coalesce(_col(text), F.lit(""))), r"\r\n?", "\n")
    folded = F.regexp_replace(folded, f"{BLANK}+", " ")
    folded = F.regexp_replace(folded, r" ?\n ?", "\n")
    return F.regexp_replace(folded, r"^[ \n]+|[ \n]+$", "")


def fold_title(title) -> Column:
    """A title as compared: as fold_text on one line, without 1-3 digits that trail a non-digit (footnote marks)."""
    folded = F.regexp_replace(half_width(F.coalesce(_col(title), F.lit(""))), rf"(?:{BLANK}|[\r\n])+", " ")
    return F.trim(F.regexp_replace(F.trim(folded), r"([^\d\s])\d{1,3}$", "$1"))


def path_parts(key) -> Column:
    """The non-blank levels of a ``A > B > C`` key."""
    return F.filter(F.split(F.coalesce(_col(key), F.lit("")), " > "), lambda p: F.trim(p) != "")


def fold_key(key) -> Column:
    """A key whose levels are folded titles."""
    return F.array_join(F.transform(path_parts(key), fold_title), " > ")


def parent_key(key) -> Column:
    """The folded key without its last level; empty at the top."""
    parts = path_parts(key)
    return F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), fold_title), " > ")


def leaf_title(key, title=None) -> Column:
    """The last level of the key; the title where the key has none."""
    parts = path_parts(key)
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), _col(title) if title is not None else F.lit(""), F.lit(""))


def looks_like_id(token) -> Column:
    token = F.trim(_col(token))
    parts = token.rlike(ID_PARTS) & token.rlike(r"\d")
    mixed = token.rlike(rf"^(?:{ID_MIXED})$") & token.rlike("[-_]")
    return (F.length(token) >= 3) & (token.rlike(ID_SLASH) | parts | mixed)


def document_id(title) -> Column:
    """The stable number in a title's last parentheses that hold one; null without."""
    inside = F.transform(F.regexp_extract_all(F.coalesce(_col(title), F.lit("")), F.lit(r"[（(]([^）)]+)[）)]"), F.lit(1)), lambda x: F.trim(x))
    token = F.try_element_at(F.filter(inside, looks_like_id), F.lit(-1))
    slash, parts = F.regexp_extract(token, f"({ID_SLASH})", 1), F.regexp_extract(token, f"({ID_PARTS})", 1)
    return F.when(token.isNotNull(), F.coalesce(F.nullif(slash, F.lit("")), F.nullif(parts, F.lit("")), token))


def heading_level(style) -> Column:
    """Level 1-4 that a paragraph style's name tells, in any of its usual spellings; null for none."""
    raw = F.trim(F.coalesce(_col(style), F.lit("")))
    compact = F.lower(F.regexp_replace(raw, r"[\s_\-]+", ""))
    digit = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    chinese = lambda pattern: F.translate(digit(raw, pattern), "一二三四", "1234")
    level = F.coalesce(
        digit(compact, r"^(?:heading|h|title|标题)([1-4])$"),
        digit(compact, r"^([1-4])(?:级标题|级)$"),
        digit(compact, r"(?:heading|title|标题|h)([1-4])$"),
        digit(compact, r"([1-4])(?:级标题|级|标题)$"),
        chinese("(?:第)?([一二三四])(?:级)?标题"),
        chinese("([一二三四])级"),
        digit(raw, r"(?:^|[_\-\s])([1-4])$"),
    )
    return F.expr("try_cast(null as int)") if style is None else level.try_cast("int")


def is_heading(text, style, outline=None, bold=None) -> Column:
    """Level of a heading paragraph: by style, by outline level (0-based), or 4 for a short line with a stable number."""
    body = F.trim(F.coalesce(_col(text), F.lit("")))
    numbered = body.rlike(f"(?:{ID_SLASH}|{ID_PARTS})") & (F.length(body) <= 160) & ~body.contains("\n")
    hinted = F.lower(F.coalesce(_col(style), F.lit(""))).rlike("标题|heading|head|title|csci|sdd|章节|函数|功能|需求")
    short = F.size(F.split(body, r"\s+")) <= 12
    strong = F.coalesce(_col(bold), F.lit(False)) if bold is not None else F.lit(False)
    outlined = _col(outline) + 1 if outline is not None else F.lit(None).cast("int")
    return F.coalesce(heading_level(style), outlined, F.when(numbered & (hinted | strong | short), 4))


def item_id(text) -> Column:
    """The id of a list item that a text opens, a)-z) or 1)-99) or (1); null for none."""
    body = F.trim(F.coalesce(_col(text), F.lit("")))
    wide = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
    letter = F.translate(F.regexp_extract(body, f"^([a-z{wide}])[)）.、\\s]", 1), wide, "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_extract(body, r"^([1-9]\d?)[)）.、\s]", 1)
    inside = F.regexp_extract(body, r"^[（(]([1-9]\d?)[）)]", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (letter, plain, inside)])


def cells_to_text(rows) -> Column:
    """An array of arrays of cells as tab-separated lines, white space within cells folded."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    lines = F.transform(_col(rows), lambda r: F.regexp_replace(F.array_join(F.transform(r, cell), "\t"), r"\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def identifier_tokens(name) -> Column:
    """Lower-case parts of an identifier, split at underscores and changes of case."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(name), F.lit("")), F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"), F.lit(0)), F.lower)


def symbol_kind(name) -> Column:
    """macro, global, type or symbol, by an identifier's spelling."""
    name = F.trim(F.coalesce(_col(name), F.lit("")))
    return F.when(name.rlike(r"^[A-Z][A-Z0-9_]*$"), "macro").when(name.rlike("^g_"), "global").when(name.rlike("_t$"), "type").otherwise("symbol")


def has_cjk(text) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike("[\u4e00-\u9fff]")


def term_set(text) -> Column:
    """Terms of a mixed text: the parts between punctuation, and all pairs of neighbouring CJK characters."""
    parts = F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"[\s,;:，。；：、()（）/|]+"), lambda p: p != "")
    pairs = F.flatten(F.transform(parts, lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 1, F.lit(1))), lambda i: p.substr(i, F.lit(2))), lambda g: g.rlike("^[\u4e00-\u9fff]{2}$"))))
    return F.array_distinct(F.concat(parts, pairs))


def common_prefix(texts) -> Column:
    """Longest common prefix of an array of strings."""
    first = F.array_min(_col(texts))
    last = F.array_max(_col(texts))
    length = F.aggregate(F.sequence(F.lit(0), F.length(first)), F.lit(0), lambda best, i: F.when(F.substring(first, 1, i) == F.substring(last, 1, i), i).otherwise(best))
    return F.when(F.size(_col(texts)) > 0, F.substring(first, F.lit(1), length))


def head_tail(text, most: int, marker: str = " ... ") -> Column:
    """A text of at most ``most`` characters: its head and its tail around a marker."""
    body = F.coalesce(_col(text), F.lit(""))
    room = max(most - len(marker), 2)
    head = room - room // 2
    cut = F.concat(F.substring(body, 1, head), F.lit(marker), F.expr("''") if room // 2 == 0 else F.right(body, F.lit(room // 2)))
    return F.when(F.length(body) <= most, body).otherwise(cut)


def plain_path(path) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.replace(F.trim(F.coalesce(_col(path), F.lit(""))), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def short_hash(text, size: int = 16) -> Column:
    """The first hex digits of SHA-256; empty for empty."""
    body = F.coalesce(_col(text), F.lit(""))
    return F.when(body == "", "").otherwise(F.substring(F.sha2(body, 256), 1, size))


def nearest_edit(name, other) -> Column:
    """Struct (distance, ratio) of two short names; ratio is 1 - distance / longer length."""
    a, b = _col(name), _col(other)
    distance = F.levenshtein(a, b)
    return F.struct(distance.alias("distance"), (1 - distance / F.greatest(F.length(a), F.length(b), F.lit(1))).alias("ratio"))


def opening_balance(text) -> Column:
    """Whether (), [] and {} close in the order in which they open."""
    marks = F.filter(F.split(F.coalesce(_col(text), F.lit("")), ""), lambda c: c.isin("(", ")", "[", "]", "{", "}"))
    step = lambda stack, c: (
        F.when(c.isin("(", "[", "{"), F.concat(stack, c))
        .when(F.right(stack, F.lit(1)) == F.when(c == ")", "(").when(c == "]", "[").otherwise("{"), F.substring(stack, F.lit(1), F.length(stack) - 1))
        .otherwise(F.lit("!!!"))
    )
    return F.aggregate(marks, F.lit(""), step) == ""
