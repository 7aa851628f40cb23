"""SQL (DuckDB) that finds what rules find in planted texts: spans by offset, which of them stand, and the text that they make.

The planted texts are in a table p (doc_id, t). A pattern that needs to see what is before or after its finding matches that
too: ``lead`` and ``trail`` are the patterns of it, which are then cut off the match.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Spans:
    """A rule's findings. ``repl``: SQL of the replacement, on ``orig``; "NULL" for a question to the reader."""

    rule: str
    pattern: str
    repl: str = "NULL"
    lead: str = ""
    trail: str = ""

    def sql(self, rank: int) -> str:
        whole = quoted(f"{self.lead}{self.pattern}{self.trail}")
        before = f"length(regexp_extract(m, {quoted('^(?:' + self.lead + ')')}))" if self.lead else "0"
        orig = f"m[{before} + 1 :]"
        if self.trail:
            orig = f"regexp_replace({orig}, {quoted('(?:' + self.trail + ')$')}, '')"
        return f"""
            SELECT doc_id, {quoted(self.rule)} AS rule_id, {rank} AS rank, (upto - length(m) + {before})::INT AS start, orig, {self.repl} AS repl FROM (
                SELECT *, {orig} AS orig FROM (
                    SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
                        SELECT doc_id, unnest(f) AS m, unnest(g[: len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM (
                            SELECT doc_id, regexp_extract_all(t, {whole}) AS f, regexp_split_to_array(t, {whole}) AS g FROM p))))
        """


#: What is missing or too much at the edges of a text.
EDGES = r"""
    SELECT doc_id, 'ws.edges' AS rule_id, 999 AS rank, 0 AS start, regexp_extract(t, '^(?:[ \t]*\n)+') AS orig, '' AS repl FROM p WHERE regexp_matches(t, '^[ \t]*\n')
    UNION ALL
    SELECT doc_id, 'ws.edges', 999, edge::INT, t[edge + 1 :], chr(10) FROM (
        SELECT doc_id, t, tail, CASE
            WHEN t = '' OR tail = chr(10) THEN NULL
            WHEN length(tail) - length(replace(tail, chr(10), '')) >= 2 THEN length(t) - length(tail) + strpos(tail, chr(10)) - 1
            WHEN strpos(tail, chr(10)) = 0 AND length(t) > length(tail) THEN length(t) - length(tail) END AS edge
        FROM (SELECT doc_id, t, regexp_extract(t, '[ \t\n]*$') AS tail FROM p))
    WHERE edge IS NOT NULL
"""

_SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Runs of three or more sentences that begin with one word, by the word.
SAME_STARTS = rf"""
    SELECT doc_id, 'sty.repeat' AS rule_id, 500 AS rank, start, word AS orig, NULL AS repl FROM (
        SELECT *, count(*) OVER (PARTITION BY doc_id, word, island) AS n FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) - row_number() OVER (PARTITION BY doc_id, word ORDER BY j) AS island FROM (
                SELECT doc_id, j, regexp_extract(s, '[A-Z][a-z]+') AS word, (upto - length(s) + length(regexp_extract(s, '^{_SPACE}*')))::INT AS start, t FROM (
                    SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM (
                        SELECT doc_id, t, unnest(x) AS s, generate_subscripts(x, 1) AS j FROM (
                            SELECT doc_id, t, regexp_extract_all(t, '[^.!?\n]*[.!?\n]') AS x FROM p)))
                WHERE regexp_matches(s, '^{_SPACE}*[A-Z][a-z]+(?:[^A-Za-z0-9_].*)?[.!?]$'))
            WHERE start = 0 OR t[start] = chr(10) OR regexp_matches(right(t[: start], 60), '[.!?]{_SPACE}+$')))
    WHERE n >= 3
"""


def findings(rules: Iterable[Spans], *more: str) -> str:
    """CTEs f (all findings) and s (those that stand: of fixes that overlap the first, then the longer, then the earlier rule)."""
    found = " UNION ALL ".join([r.sql(i) for i, r in enumerate(rules)] + list(more))
    return f"""
        f AS (SELECT *, start + length(orig) AS stop FROM ({found})),
        s AS (
            SELECT doc_id, rule_id, start, stop::INT AS "end", orig, repl, CASE WHEN repl IS NULL THEN 'review' WHEN repl = '' THEN 'remove' ELSE 'replace' END AS kind FROM (
                SELECT *, max(stop) OVER (PARTITION BY doc_id, repl IS NULL ORDER BY start, stop DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM f)
            WHERE coalesce(reached, 0) <= start)
    """


#: CTE c (doc_id, t, n, applied): the texts with the fixes of s, how many they are, and the rules by their first place.
APPLIED = """
    e AS (SELECT doc_id, rule_id, start, "end", repl, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end"), 0) AS done FROM s WHERE repl IS NOT NULL),
    r AS (SELECT doc_id, rule_id, count(*) AS n, min(start) AS first FROM e GROUP BY ALL),
    a AS (SELECT doc_id, sum(n)::INT AS n, string_agg('"' || rule_id || '":' || n, ',' ORDER BY first) AS applied FROM r GROUP BY 1),
    b AS (SELECT e.doc_id, string_agg(t[done + 1 : start] || repl, '' ORDER BY start, "end") || t[max("end") + 1 :] AS t FROM e JOIN p USING (doc_id) GROUP BY e.doc_id, t),
    c AS (SELECT p.doc_id, coalesce(b.t, p.t) AS t, coalesce(a.n, 0) AS n, '{' || coalesce(a.applied, '') || '}' AS applied FROM p LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id))
"""

#: Runs of spaces between words, but for those that line up with one on the line above or below.
REPEATED_SPACES = rf"""
    SELECT doc_id, rule_id, rank, start, orig, repl FROM (
        SELECT *, upto - length(array_to_string(lines[: n], chr(10))) - (n > 0)::INT AS col, [lines[n], lines[n + 2]] AS beside FROM (
            SELECT x.*, t, start + length(orig) AS upto, string_split(t, chr(10)) AS lines, length(t[: start]) - length(replace(t[: start], chr(10), '')) AS n
            FROM ({Spans("ws.multi", " {2,}", "' '").sql(0)}) AS x JOIN p USING (doc_id)))
    WHERE start > 0 AND upto < length(t) AND NOT regexp_matches(t[start], '^{_SPACE}$') AND NOT regexp_matches(t[upto + 1], '^(?:{_SPACE}|\\p{{Cf}}|\\x{{AD}})$')
        AND len(list_filter(beside, lambda b: b IS NOT NULL AND b[greatest(col - 2, 0) + 1 : col] = '  ' AND length(b) > col AND NOT regexp_matches(b[col + 1], '^{_SPACE}$'))) = 0
"""

#: Line ends inside paragraphs; where a word may be broken, the hyphen too.
BROKEN_LINES = rf"""
    SELECT doc_id, 'ws.unwrap' AS rule_id, 0 AS rank, (stop - broken::INT)::INT AS start, CASE WHEN broken THEN '-' ELSE '' END || chr(10) AS orig, CASE WHEN NOT broken THEN ' ' END AS repl FROM (
        SELECT *, regexp_matches(line, '[A-Za-z]-$') AND regexp_matches(following, '^[a-z]') AS broken FROM (
            SELECT *, sum(length(line) + 1) OVER w - 1 AS stop, lead(line) OVER w AS following FROM (
                SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM p))
            WINDOW w AS (PARTITION BY doc_id ORDER BY i))
        WHERE regexp_matches(line, '[^\s\x{{A0}}]') AND regexp_matches(following, '[^\s\x{{A0}}]') AND NOT regexp_matches(line, '(?:  |\\)$|^[ \t]*(?:#{{1,6}}\s|\||```|~~~)')
            AND NOT regexp_matches(following, '^[ \t]*(?:[-*+\x{{2022}}]\s|\d{{1,3}}[.)]\s|#{{1,6}}\s|>|\||```|~~~|\\(?:item|begin|end|section|subsection|chapter|paragraph)\b|[ \t]{{4}})'))
"""

#: Sentences of twelve words or more that stand in a text three times or more: their first twenty places each.
SAME_SENTENCES = rf"""
    SELECT doc_id, 'sty.duplicate' AS rule_id, 0 AS rank, start, orig, NULL AS repl FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, start) AS place FROM (
            SELECT *, count(*) OVER k AS n, min(start) OVER k AS first, row_number() OVER (PARTITION BY doc_id, key ORDER BY start) AS nth FROM (
                SELECT doc_id, regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS orig, lower(regexp_replace(regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')) AS key,
                    (upto - length(s) + length(regexp_extract(s, '^{_SPACE}*')))::INT AS start FROM (
                    SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM (
                        SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS j FROM (
                            SELECT doc_id, regexp_extract_all(t || ' ', '[^.!?\n]+(?:[.!?]{_SPACE}?)?|[.!?\n]') AS x FROM p)))
                WHERE regexp_matches(s, '[.!?]{_SPACE}$') AND len(regexp_extract_all(s, '\b[\w''-]+\b')) >= 12)
            WINDOW k AS (PARTITION BY doc_id, key))
        WHERE n >= 3 AND nth <= 20)
    WHERE place <= 100
"""
