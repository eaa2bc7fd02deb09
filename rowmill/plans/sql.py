"""SQL fragments shared by the DuckDB versions of the queries."""

from __future__ import annotations

from rowmill.tables import KEYS


def current(table: str) -> str:
    """A subquery: the table with redelivered rows counted once."""
    keys, at = KEYS[table]
    by = ", ".join(keys)
    return f"(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {at} DESC NULLS LAST) AS rn_ FROM {table}) WHERE rn_ = 1)"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))"


def canon(x: str) -> str:
    v = f"regexp_replace(replace(lower({x}), 'ё', 'е'), '[-\\x{{2010}}-\\x{{2015}}]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({v}, '[^0-9a-zа-я ]+', ' ', 'g'), ' +', ' ', 'g'))"


def clean_lines(text: str) -> str:
    """A list expression."""
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {ws('x')}), lambda x: NOT regexp_full_match(x, '[_ -]*'))"


WORDS = """words AS (
  SELECT doc_id, li, wi, t AS text, CAST(1 + li // 60 AS INTEGER) AS page_number,
         CAST(12 * (sum(length(t) + 1) OVER (PARTITION BY doc_id, li ORDER BY wi) - length(t) - 1) AS BIGINT) AS lft,
         CAST(40 * (li % 60) AS BIGINT) AS tp, CAST(12 * length(t) AS BIGINT) AS wd, li * 100000 + wi AS ord
  FROM (SELECT doc_id, li, unnest(range(len(a))) AS wi, unnest(a) AS t
        FROM (SELECT doc_id, li, string_split(l, ' ') AS a
              FROM (SELECT doc_id, unnest(range(len(b))) AS li, unnest(b) AS l
                    FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL)))) 
  QUALIFY t <> '')"""
DATE = "^\\d{2}\\.\\d{2}\\.\\d{4}"
