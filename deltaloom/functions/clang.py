"""Nesting-aware facts of C source text. A file is one value; regular expressions cannot follow its nesting.

The scanner works on a masked copy in which comments and literals are blanks of the same length, so all offsets and line
numbers are those of the original. Arrow UDFs return arrays of structs that queries explode.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
_HEAD = re.compile(r"([A-Za-z_][\w\s\*]*?[\s\*])([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
#: Words of the C language.
_NOT_CALLS = frozenset("if for while switch return sizeof do else case".split())
_ASSIGN = re.compile(r"(?P<left>\**[A-Za-z_][\w\.\[\]>\-\*]*)\s*(?P<op>\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|>>=|=(?!=))\s*(?P<right>[^;]+);")
_DECLARE = re.compile(r"^\s*(?:const\s+|static\s+|volatile\s+|register\s+|unsigned\s+|signed\s+|struct\s+)*[A-Za-z_]\w*(?:\s*\*+\s*|\s+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=\s*([^;]*))?;", re.M)
_STEP = re.compile(r"\+\+\s*([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*\+\+|--\s*([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*--")
_KEYWORDS = frozenset("return if else for while do switch case break continue goto default sizeof typedef".split())


def mask(code: str) -> str:
    """Comments and literals blanked, line feeds and length kept."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code or "")


def mask_dead(code: str) -> str:
    """Branches that ``#if 0`` and ``#if 1`` decide, and the directives, blanked; unknown conditions stay as they are."""
    stack, out = [], []
    for line in (code or "").split("\n"):
        word = re.match(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b\s*(.*)", line)
        dead = any(level["dead"] for level in stack)
        if word:
            kind, test = word[1], word[2].split("//")[0].strip()
            if kind in ("if", "ifdef", "ifndef"):
                fixed = kind == "if" and test in ("0", "1")
                stack.append({"fixed": fixed, "dead": fixed and test == "0"})
                dead = dead or fixed
            elif stack and kind in ("else", "elif"):
                dead = dead or stack[-1]["fixed"]
                if stack[-1]["fixed"]:
                    stack[-1]["dead"] = not stack[-1]["dead"]
            elif stack:
                dead = stack.pop()["fixed"] or any(level["dead"] for level in stack)
        out.append(" " * len(line) if dead else line)
    return "\n".join(out)


def closing(code: str, at: int, pair: str = "{}") -> int:
    """Offset of the bracket that closes the one at ``at``; -1 without one."""
    depth, k, (opens, shuts) = 1, at + 1, pair
    while depth:  # from one closing bracket to the next, counting those that open between
        end = code.find(shuts, k)
        if end < 0:
            return -1
        depth += code.count(opens, k, end) - 1
        k = end + 1
    return k - 1


def joined_lines(code: str) -> str:
    """Lines that end in a backslash joined with the next one; as many empty lines follow, so later lines keep their numbers."""
    return re.sub(r"(?:[^\n]*\\\n)+[^\n]*", lambda m: re.sub(r"\\\n", " ", m[0]) + "\n" * m[0].count("\\\n"), code or "")


def comments(code: str) -> list[dict]:
    """Comments by line: runs with only blanks between them are one; what they say, their last line, the next line of code (-1: none).

    Comments beside code on their line belong to that line and are left out.
    """
    plain, found = mask(code), []
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    filled = [n for n, row in enumerate(plain.split("\n"), 1) if row.strip()]
    for m in _TOKEN.finditer(code or ""):
        if m[0][0] != "/":
            continue
        first, last = (bisect.bisect_right(starts, at) for at in (m.start(), m.end() - 1))
        if plain[starts[first - 1] : m.start()].strip() or plain[m.end() :].split("\n", 1)[0].strip():
            continue
        body = re.sub(r"(?m)^/[/*]+[ \t]?|^[ \t]*\*(?!/)[ \t]?|[ \t]*\*+/$", "", m[0]).strip()
        after = bisect.bisect_right(filled, last)
        nearest = filled[after] if after < len(filled) else -1
        if found and found[-1]["next_line"] == nearest:
            found[-1] |= {"end_line": last, "text": f"{found[-1]['text']}\n{body}"}
        else:
            found.append({"end_line": last, "text": body, "next_line": nearest})
    return found


def header_symbols(code: str) -> list[dict]:
    """What a header names: macros with their values, enumerators, typedefs with what they stand for, variables, prototypes."""
    whole = joined_lines(code)
    plain, rows = mask(whole), []

    def add(ident, kind, value, at):
        rows.append({"ord": len(rows), "ident": ident, "kind": kind, "value": " ".join(value.split()), "line": plain.count("\n", 0, at) + 1})

    for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\([^)\n]*\))?[ \t]*([^\n]*)", plain, re.M):
        add(m[1], "macro_function" if m[2] else "macro", m[3], m.start(1))
    bare = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), plain)
    for m in re.finditer(r"\benum\b[^;{]*\{", bare):
        end = closing(bare, m.end() - 1)
        at = m.end()
        for part in bare[m.end() : max(end, m.end())].split(","):
            if name := re.match(r"\s*([A-Za-z_]\w*)\s*(?:=\s*(.*))?", part, re.S):
                add(name[1], "enumerator", name[2] or "", at + name.start(1))
            at += len(part) + 1
    for m in re.finditer(r"\btypedef\b([^;{}]*?)\b([A-Za-z_]\w*)\s*;", bare):
        add(m[2], "typedef", m[1], m.start(2))
    for m in re.finditer(r"\b(?:typedef\s+)?(struct|union|enum)\b[^;{(]*\{", bare):
        end = closing(bare, m.end() - 1)
        alias = re.compile(r"\s*([A-Za-z_]\w*)\s*;").match(bare, end + 1) if end >= 0 and m[0].startswith("typedef") else None
        if alias:
            add(alias[1], "typedef", m[1], alias.start(1))
    for m in re.finditer(r"^[ \t]*extern\b([^;(){}]*?)\b([A-Za-z_]\w*)\s*((?:\[[^\]]*\])*)\s*;", bare, re.M):
        add(m[2], "variable", m[1].strip() + m[3], m.start(2))
    for m in re.finditer(r"^[ \t]*((?:[A-Za-z_]\w*[\s\*]+)+)([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*;", bare, re.M):
        if m[1].split()[0] not in _KEYWORDS:
            add(m[2], "prototype", f"{m[1]}({m[3]})", m.start(2))
    return rows


def split_top(text: str, at: str = ",") -> list[str]:
    """Parts of a text between separators outside brackets and quotes."""
    parts, depth, start, quote, k = [], 0, 0, "", 0
    while k < len(text):
        c = text[k]
        if quote:
            k += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth and text.startswith(at, k):
            parts.append(text[start:k].strip())
            k += len(at)
            start = k
            continue
        k += 1
    tail = text[start:].strip()
    return parts + [tail] if tail or parts else []


def functions(code: str) -> list[dict]:
    """Function definitions: name, signature, parameters, offsets, line numbers and body, in order."""
    plain, found, at = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), mask(code)), [], 0
    while m := _HEAD.search(plain, at):
        brace = m.end() - 1
        end = closing(plain, brace)
        if m[2] in _NOT_CALLS or m[1].strip() in _KEYWORDS or end < 0:
            at = m.end(2)
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        signature = re.sub(r"\s+", " ", code[start:brace]).strip()
        params = [p for p in split_top(m[3]) if p and p != "void"]
        found.append({"ord": len(found), "name": m[2], "signature": signature, "params": params, "start": start, "end": end + 1, "line_start": plain.count("\n", 0, start) + 1, "line_end": plain.count("\n", 0, end) + 1, "body": code[start : end + 1]})
        at = end + 1
    return found


def calls(body: str) -> list[dict]:
    """Calls inside a function's text: callee, line from 0, arguments."""
    plain, found = mask(body), []
    brace = plain.find("{")
    for m in _CALL.finditer(plain, max(brace, 0)):
        if m[1] not in _NOT_CALLS and (end := closing(plain, m.end() - 1, "()")) > 0:
            found.append({"ord": len(found), "callee": m[1], "line": plain.count("\n", 0, m.start()), "args": split_top(body[m.end() : end])})
    return found


def accesses(body: str) -> list[dict]:
    """Reads and writes of assignments and steps: symbol, kind, operator, line from 0. Declarations write their name."""
    plain, found = mask(body), []

    def add(symbol, kind, op, at):
        found.append({"ord": len(found), "symbol": symbol, "kind": kind, "operator": op, "line": plain.count("\n", 0, at)})

    inside = plain.find("{") + 1
    for m in _ASSIGN.finditer(plain, inside):
        add(re.match(r"\**([A-Za-z_]\w*)", m["left"])[1], "write", m["op"], m.start())
        if m["op"] != "=":
            add(found[-1]["symbol"], "read", m["op"], m.start())
        for word in re.finditer(r"\b[A-Za-z_]\w*\b(?!\s*\()", m["right"]):
            if word[0] not in _KEYWORDS:
                add(word[0], "read", "=", m.start("right"))
    for m in _STEP.finditer(plain, inside):
        symbol = next(g for g in m.groups() if g)
        add(symbol, "write", "++" if "++" in m[0] else "--", m.start())
    return found


def local_variables(body: str) -> list[dict]:
    """Declared locals of a function's text: name, initial value, line from 0."""
    plain = mask(body)
    inside = plain.find("{") + 1
    rows = []
    for m in _DECLARE.finditer(plain, inside):
        first = m[0].split()[0]
        if first not in _KEYWORDS and m[1] not in _KEYWORDS:
            rows.append({"ord": len(rows), "name": m[1], "value": (m[2] or "").strip(), "line": plain.count("\n", 0, m.start(1))})
    return rows


def control_blocks(body: str) -> list[dict]:
    """if / else / for / while / switch / do blocks: lines from 0, depth, and the enclosing block's number (-1 for none)."""
    plain, blocks = mask(body), []
    for m in re.finditer(r"\b(if|else|for|while|switch|do)\b", plain):
        at, test = m.end(), ""
        if m[1] not in ("else", "do"):
            paren = plain.find("(", at)
            stop = closing(plain, paren, "()") if paren >= 0 and not plain[at:paren].strip() else -1
            if stop < 0:
                continue
            test, at = body[paren + 1 : stop].strip(), stop + 1
        brace = re.compile(r"\s*\{").match(plain, at)
        end = closing(plain, brace.end() - 1) if brace else plain.find(";", at)
        if end >= 0:
            blocks.append({"ord": len(blocks), "kind": m[1], "condition": test, "start": m.start(), "end": end})
    for block in blocks:
        over = [b for b in blocks if b["start"] < block["start"] and block["end"] <= b["end"]]
        block["parent"] = max(over, key=lambda b: b["start"])["ord"] if over else -1
        block["depth"] = len(over)
    for block in blocks:
        block["line_start"], block["line_end"] = (plain.count("\n", 0, block.pop(k)) for k in ("start", "end"))
    return blocks


def effects(body: str, params: list[str]) -> list[dict]:
    """What a function changes outside itself: writes through pointer parameters, writes to globals, returned values."""
    own = {v["name"] for v in local_variables(body)}
    pointers = {re.sub(r"\W*$", "", p).split()[-1].lstrip("*") for p in params if "*" in p and "const" not in p.split("*")[0].split()}
    names = {re.sub(r"\[.*", "", p).split()[-1].lstrip("*") for p in params if p.split()}
    plain, found = mask(body), []
    inside = plain.find("{") + 1
    for m in _ASSIGN.finditer(plain, inside):
        left = m["left"].strip()
        root = re.match(r"\**([A-Za-z_]\w*)", left)
        if not root or root[1] in own:
            continue
        through = left.startswith("*") or "->" in left or "[" in left
        kind = "param_write" if root[1] in pointers and through else "" if root[1] in names else "global_write"
        if kind:
            found.append({"ord": len(found), "kind": kind, "target": left, "operation": m["op"], "value": body[m.start("right") : m.end("right")].strip()})
    for m in re.finditer(r"\breturn\b\s*([^;]*);", plain[inside:]):
        found.append({"ord": len(found), "kind": "return", "target": "", "operation": "return", "value": body[inside + m.start(1) : inside + m.end(1)].strip()})
    return found


def includes(code: str) -> list[str]:
    """Names in include directives, in order, each once."""
    return list(dict.fromkeys(re.findall(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', code or "", re.M)))


def struct_members(code: str) -> list[dict]:
    """Members of struct definitions and their typedef names."""
    plain, rows = mask(code), []
    for m in re.finditer(r"\b(?:typedef\s+)?struct\s*([A-Za-z_]\w*)?\s*\{", plain):
        end = closing(plain, m.end() - 1)
        if end < 0:
            continue
        alias = re.compile(r"\s*([A-Za-z_]\w*)\s*;").match(plain, end + 1)
        name = (alias and alias[1]) or m[1] or ""
        for part in plain[m.end() : end].split(";"):
            member = re.match(r"\s*(.+?)([A-Za-z_]\w*)\s*(\[[^\]]*\])?\s*$", part, re.S)
            if member and name:
                rows.append({"ord": len(rows), "struct": name, "member": member[2], "type": re.sub(r"\s+", " ", member[1]).strip() + (member[3] or "")})
    return rows


def expression_nodes(text: str) -> list[dict]:
    """An expression as a node table (node, parent, position, kind, text), operators split by precedence, lowest first."""
    ladder = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<=", ">=", "<", ">"), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
    nodes: list[dict] = []

    def find(body: str, ops: tuple) -> tuple[int, str] | None:
        depth, k = 0, len(body) - 1
        while k > 0:
            c = body[k]
            depth += (c in ")]") - (c in "([")
            if not depth:
                for op in ops:
                    a = k - len(op) + 1
                    around = body[a - 1 : a] + body[k + 1 : k + 2]
                    if a > 0 and body[a : k + 1] == op and not any(x in "<>=!&|" for x in around) and not re.search(r"[-+*/%<>=!&|^(,]\s*$", body[:a]):
                        return a, op
            k -= 1
        return None

    def walk(body: str, parent: int, at: int) -> None:
        body = body.strip()
        while body.startswith("(") and closing(body, 0, "()") == len(body) - 1:
            body = body[1:-1].strip()
        me = len(nodes)
        nodes.append({"node": me, "parent": parent, "position": at, "kind": "name", "text": body})
        for ops in ladder:
            if hit := find(body, ops):
                nodes[me] |= {"kind": "binary", "text": hit[1]}
                walk(body[: hit[0]], me, 0)
                walk(body[hit[0] + len(hit[1]) :], me, 1)
                return
        if body[:1] in ("!", "~", "-", "*", "&") and len(body) > 1:
            nodes[me] |= {"kind": "unary", "text": body[0]}
            walk(body[1:], me, 0)
        elif (m := re.match(r"([A-Za-z_]\w*)\s*\(", body)) and closing(body, m.end() - 1, "()") == len(body) - 1:
            nodes[me] |= {"kind": "call", "text": m[1]}
            for k, arg in enumerate(split_top(body[m.end() : -1])):
                walk(arg, me, k)
        elif re.fullmatch(r"[-+]?(?:0[xX][0-9a-fA-F]+|[\d.]+)[uUlLfF]*", body):
            nodes[me]["kind"] = "literal"
        elif "->" in body or "." in body:
            nodes[me]["kind"] = "member"

    if (text or "").strip():
        walk(text, -1, 0)
    return nodes


def _rows(**fields) -> T.ArrayType:
    kinds = {int: T.IntegerType(), str: T.StringType(), list: T.ArrayType(T.StringType())}
    return T.ArrayType(T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()]))


def _udf(function, kind):
    @pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: function(x or ""))

    return run


mask_udf = _udf(mask, T.StringType())
mask_dead_udf = _udf(mask_dead, T.StringType())
functions_udf = _udf(functions, _rows(ord=int, name=str, signature=str, params=list, start=int, end=int, line_start=int, line_end=int, body=str))
calls_udf = _udf(calls, _rows(ord=int, callee=str, line=int, args=list))
accesses_udf = _udf(accesses, _rows(ord=int, symbol=str, kind=str, operator=str, line=int))
locals_udf = _udf(local_variables, _rows(ord=int, name=str, value=str, line=int))
blocks_udf = _udf(control_blocks, _rows(ord=int, kind=str, condition=str, parent=int, depth=int, line_start=int, line_end=int))
includes_udf = _udf(includes, T.ArrayType(T.StringType()))
members_udf = _udf(struct_members, _rows(ord=int, struct=str, member=str, type=str))
comments_udf = _udf(comments, _rows(end_line=int, text=str, next_line=int))
symbols_udf = _udf(header_symbols, _rows(ord=int, ident=str, kind=str, value=str, line=int))
nodes_udf = _udf(expression_nodes, _rows(node=int, parent=int, position=int, kind=str, text=str))


@pandas_udf(_rows(ord=int, kind=str, target=str, operation=str, value=str))
def effects_udf(body: pd.Series, params: pd.Series) -> pd.Series:
    return pd.Series([effects(b or "", list(p) if p is not None else []) for b, p in zip(body, params)])
