"""Logic steps of C function bodies, and their plain rendering."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from deltaloom.functions.clang import closing, mask

_CONTROL = re.compile(r"(else\s+if|if|else|for|while|do|switch|case|default)\b")
_WRITE = re.compile(r"(\**[A-Za-z_][\w.\[\]>\-\*]*)\s*((?:<<|>>|[-+*/%&|^])?=)(?!=)\s*(.+)", re.S)
_BUMP = re.compile(r"(?:\+\+|--)\s*[A-Za-z_][\w.\->\[\]]*|[A-Za-z_][\w.\->\[\]]*\s*(?:\+\+|--)")
_DECLARATION = re.compile(r"(?:(?:const|static|volatile|unsigned|signed|struct)\s+)*[A-Za-z_]\w*(?:\s*\*+\s*|\s+)[A-Za-z_]\w*\s*(?:\[[^\]]*\])?")


def steps(body: str) -> list[dict]:
    """Statements of a body in order: kind, text, operands, block depth, line from 0, whether an else is empty, confidence."""
    code, found, at, depth = body or "", [], 0, 0
    plain = mask(code)
    brace = plain.find("{")
    head = brace if brace >= 0 and ";" not in plain[:brace] else -1
    at, stop = head + 1, closing(plain, head) if head >= 0 else len(plain)
    stop = stop if stop >= 0 else len(plain)

    def add(kind, text="", target="", operator="", value="", sure=0.9, empty=False, where=0):
        found.append({"ord": len(found), "kind": kind, "text": " ".join(text.split()), "target": target, "operator": operator, "value": " ".join(value.split()), "depth": depth, "line": plain.count("\n", 0, where), "is_empty": int(empty), "confidence": sure})

    while at < stop:
        rest = plain[at:stop]
        skip = len(rest) - len(rest.lstrip(" \t\r\n;"))
        if skip:
            at += skip
            continue
        where = at
        if plain[at] == "{":
            depth, at = depth + 1, at + 1
        elif plain[at] == "}":
            depth, at = max(depth - 1, 0), at + 1
            add("end_block", where=where)
        elif m := _CONTROL.match(plain, at):
            word, at = " ".join(m[1].split()), m.end()
            test = ""
            if word in ("if", "else if", "for", "while", "switch"):
                paren = plain.find("(", at)
                end = closing(plain, paren, "()") if paren >= 0 else -1
                if end < 0 or end > stop:
                    add("unknown", code[where:stop], sure=0.2, where=where)
                    break
                test, at = code[paren + 1 : end], end + 1
            elif word in ("case", "default"):
                colon = plain.find(":", at)
                colon = colon if 0 <= colon < stop else stop
                test, at = code[at:colon].strip(), colon + 1
            kind = {"else if": "else_if", "do": "do_while"}.get(word, word)
            empty = kind == "else" and re.match(r"\s*(?:\{\s*\}|;)", plain[at:stop]) is not None
            add(kind, test, empty=empty, where=where)
        else:
            end = plain.find(";", at)
            end = end if 0 <= end < stop else stop
            text, at = code[at:end], end + 1
            bare = text.strip()
            if m := re.match(r"return\b\s*(.*)", bare, re.S):
                add("return", bare, value=m[1], where=where)
            elif bare in ("break", "continue"):
                add(bare, bare, where=where)
            elif (m := re.match(r"(?:[\w\s\*]+?[\s\*])?" + _WRITE.pattern, bare, re.S)) and closing(bare, 0, "()") != len(bare) - 1:
                add("assignment", bare, m[1].lstrip(), m[2], m[3], where=where)
            elif _BUMP.fullmatch(bare):
                add("assignment", bare, re.sub(r"\+\+|--|\s", "", bare), "++" if "++" in bare else "--", where=where)
            elif m := re.match(r"(?:\(void\)\s*)?([A-Za-z_]\w*)\s*\(", bare):
                add("call", bare, m[1], value=bare[m.end() : -1], where=where)
            elif not _DECLARATION.fullmatch(bare):
                add("unknown", bare, sure=0.3, where=where)
    return found


def render(rows: list[dict], names: dict[str, str] | None = None) -> list[str]:
    """Indented lines of steps; identifiers take their display names, an empty else and what ends a plain block are left out."""
    names = names or {}
    shown = lambda text: re.sub(r"[A-Za-z_]\w*", lambda m: names.get(m[0], m[0]), text or "")
    words = {"if": "IF", "else_if": "ELSE IF", "else": "ELSE", "for": "FOR", "while": "WHILE", "do_while": "DO WHILE", "switch": "SWITCH", "case": "CASE", "default": "DEFAULT", "break": "BREAK", "continue": "CONTINUE", "end_block": "END", "return": "RETURN"}
    lines = []
    for row in rows:
        kind, pad = row["kind"], "    " * row["depth"]
        if kind == "else" and row["is_empty"]:
            continue
        if kind == "assignment":
            value = row["value"] or "1"
            step = {"=": f"SET {shown(row['target'])} TO {shown(value)}", "++": f"ADD 1 TO {shown(row['target'])}", "--": f"SUBTRACT 1 FROM {shown(row['target'])}"}
            lines.append(pad + step.get(row["operator"], f"UPDATE {shown(row['target'])} BY {row['operator']} {shown(value)}"))
        elif kind == "call":
            lines.append(f"{pad}CALL {shown(row['target'])}({shown(row['value'])})")
        elif kind == "unknown":
            lines.append(pad + shown(row["text"]))
        else:
            tail = row["value"] if kind == "return" else row["text"] if kind not in ("break", "continue") else ""
            lines.append((pad + words[kind] + (" " + shown(tail) if tail else "")).rstrip())
    return lines


_ROW = T.StructType([T.StructField(k, t()) for k, t in (("ord", T.IntegerType), ("kind", T.StringType), ("text", T.StringType), ("target", T.StringType), ("operator", T.StringType), ("value", T.StringType), ("depth", T.IntegerType), ("line", T.IntegerType), ("is_empty", T.IntegerType), ("confidence", T.DoubleType))])


@pandas_udf(T.ArrayType(_ROW))
def steps_udf(body: pd.Series) -> pd.Series:
    return body.map(lambda x: steps(x or ""))


@pandas_udf(T.ArrayType(T.StringType()))
def rendered_udf(body: pd.Series) -> pd.Series:
    return body.map(lambda x: render(steps(x or "")))
