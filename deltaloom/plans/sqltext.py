"""SQL spellings, for DuckDB, of the text normalisers and of the two simulated versions of the documents table."""

from __future__ import annotations

BLANK = r"[ \t\x0b\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{feff}]"


def half_width(x: str) -> str:
    return f"translate(regexp_replace({x}, '{ZERO_WIDTH}', '', 'g'), '（）　', '() ')"


def fold_text(x: str) -> str:
    x = rf"regexp_replace({half_width(f"coalesce({x}, '')")}, '\r\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '{BLANK}+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?\n ?', chr(10), 'g')"
    return rf"regexp_replace({x}, '^[ \n]+|[ \n]+$', '', 'g')"


def fold_title(x: str) -> str:
    x = rf"trim(regexp_replace({half_width(f"coalesce({x}, '')")}, '(?:{BLANK}|[\r\n])+', ' ', 'g'))"
    return rf"trim(regexp_replace({x}, '([^\d\s])\d{{1,3}}$', '\1'))"


NUMBER = "CASE WHEN doc_id % 19 = 7 THEN doc_id - 1 ELSE doc_id END"
TITLE = f"concat('Doc ', lang, ' (SDD-', source, '-', {NUMBER}, ')')"
VERSIONS = f"""
old AS (SELECT doc_id AS ord, {TITLE} AS title, concat(lang, ' > ', source, ' > ', {TITLE}) AS key, text AS body,
        concat('SDD-', source, '-', {NUMBER}) AS did FROM documents WHERE doc_id % 17 <> 3),
new AS (SELECT doc_id AS ord, concat({TITLE}, CASE WHEN doc_id % 13 = 2 THEN '12' ELSE '' END) AS title,
        concat(lang, ' > ', source, ' > ', {TITLE}, CASE WHEN doc_id % 13 = 2 THEN '12' ELSE '' END) AS key,
        CASE doc_id % 13 WHEN 0 THEN concat(text, ' Revised sentence.') WHEN 1 THEN replace(text, ' ', '  ') ELSE text END AS body,
        concat('SDD-', source, '-', {NUMBER}) AS did FROM documents WHERE doc_id % 17 <> 5)"""
