"""The same answers in SQL for DuckDB, by other means than the Spark side uses.

Spans come from markers put around the matches by ``regexp_replace``; offsets are
window sums; overlaps are resolved by a recursive walk down the ranking; numbers
are window ranks; masked texts are string aggregates.  Patterns with lookaround
are restated with a captured neighbour or a test of the text before or after.
"""

from __future__ import annotations

from ..plans import corpora
from ..rules import (
    LOCATION_DENYLIST, NAME_DENYLIST, PII_RULES, SECRET_RULES, SEPARATORS, STRUCTURAL_IDS,
    VULNERABILITY_RULES, CodeRule, SpanRule, select_rules,
)

lit = corpora.literal
MARK = "chr(1)"
WORD = r"[\p{L}\p{N}\p{M}_]+"

DOCUMENTS_SQL = "SELECT doc_id, text FROM documents"
PAGES_SQL = "SELECT page_id AS doc_id, html AS text FROM pages"

# Lookaround rules as (before)(value)(after), plus a test on {text}, {start}, {value}.
_RESTATED = {
    "PHONE_INTL_PLUS": (r"(^|[^A-Z0-9])(\+\d[\d\s\-().]{6,20}\d)()", None),
    "PHONE_LOCAL": (
        r"(^|[^A-Z0-9])((?:\(\d{2,4}\)[\s\-]?)?\d{2,4}[\s\-]\d{3,4}[\s\-]\d{3,4})([^\d]|$)", None),
    "CREDIT_CARD_EXTENDED": (
        r"()(\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
        r"|6(?:011|5[0-9]{2})[0-9]{12}|(?:\d{4}[- ]){3}\d{4})\b)()",
        r"NOT regexp_matches(substr({text}, 1, {start}), '[A-Z]{{2}}\d{{2}}\s?$')"),
    "URL_WITH_SCHEME": (r"(^|\s)(https?://[^\s/$.?#][^\s]*)()", None),
    "URL_WWW": (r"(^|\s)(www\.[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?)(\s|$)", None),
    "NAME_AFTER_LABEL": (
        r"(\b(?:Name|Contact|Manager|Prepared by)[ \t]*:[ \t]*)(\p{Lu}\p{L}+(?:[ \t]\p{Lu}\p{L}+){1,3})()",
        r"NOT regexp_matches(substr({text}, 1, {start}), '(Account|Bank) Name[ \t]*:[ \t]*$')"),
    "API_KEY_SK": (r"()(\bsk-(?:proj-)?[A-Za-z0-9]{20,})()", None),
    "SEC-RULE-009": (
        r"()(yaml\.load\s*\(\s*)()",
        "NOT contains(substr({text}, {start} + length({value}) + 1), 'Loader=yaml.SafeLoader')"),
    "SEC-RULE-010": (r"()(\beval\s*\()(\s|[^'\"\s]|\z)", None),
    "SEC-RULE-012": (
        r"()(['\"]http://[^'\"]{4,}['\"])()",
        r"NOT regexp_matches({value}, '^.http://(localhost|127\.0\.0\.1|0\.0\.0\.0)')"),
    "SEC-RULE-020": (
        r"()(^[\w\-]+\s*(?:>=|<=|~=|!=|>|<)\s*[\d.]+\s*$|^[\w\-]+\s*$)()", None),
}


def _pattern(name: str, rule) -> tuple[str, str | None, str]:
    """Pattern, test and replacement text that puts marks around the value."""
    both = f"'\\1' || {MARK} || '\\2' || {MARK} || '\\3'"
    if name in _RESTATED:
        regex, test = _RESTATED[name]
        return "(?ms)" + regex, test, both
    regex = rule.regex
    flag = ""
    if regex.startswith("(?i)"):
        flag, regex = "(?i)", regex[4:]
    group = getattr(rule, "group", 0)
    if not group:
        return f"(?ms){flag}({regex})", None, f"{MARK} || '\\1' || {MARK}"
    opening = next(
        i for i, c in enumerate(regex) if c == "(" and regex[i + 1] != "?" and regex[i - 1] != "\\"
    )
    closing = regex.rindex(")")
    parts = f"({regex[:opening]})({regex[opening + 1:closing]})({regex[closing + 1:]})"
    return f"(?ms){flag}{parts}", None, both


def match_rows(name: str, rule, corpus: str = "corpus") -> str:
    """(doc_id, text, start, value) of every match of a rule."""
    regex, test, marked = _pattern(name, rule)
    where = f" WHERE {test.format(text='text', start='start', value='value')}" if test else ""
    return f"""
      SELECT doc_id, text, start, value FROM (
        SELECT doc_id, text, j, part AS value,
               coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY j
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start
        FROM (SELECT doc_id, text, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS j
              FROM (SELECT doc_id, text, string_split(
                      regexp_replace(text, {lit(regex)}, {marked}, 'g'), {MARK}) AS parts
                    FROM {corpus} WHERE regexp_matches(text, {lit(regex)})))
      ) WHERE j % 2 = 0{' AND ' + where[7:] if where else ''}"""


def span_rows(rules, corpus: str = "corpus", boost: int = 35, window: int = 5, least: int = 50) -> str:
    """Findings of several rules with boosted scores, at or above the threshold."""
    parts = []
    for r in rules:
        pct = str(r.pct)
        if boost and r.context and r.pct < 100:
            words = ", ".join(lit(w) for w in r.context)
            pct = (
                f"CASE WHEN list_has_any(regexp_extract_all(lower(substr(text, 1, start)), {lit(WORD)})"
                f"[-{window}:], [{words}]) THEN {min(100, r.pct + boost)} ELSE {r.pct} END"
            )
        parts.append(
            f"SELECT doc_id, {lit(r.entity)} AS entity, {lit(r.label)} AS label, {lit(r.rule)} AS rule, "
            f"start, (start + length(value))::INTEGER AS stop, {pct} AS pct, value, text "
            f"FROM ({match_rows(r.rule, r, corpus)})"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE pct >= {least}"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


def clipped_rows(source: str) -> str:
    """Spans cut at the pipe."""
    before = strip("substr(value, 1, strpos(value, '|') - 1)")
    return f"""
      SELECT doc_id, entity, label, rule, start,
             CASE WHEN contains(value, '|') THEN (start + length({before}))::INTEGER ELSE stop END AS stop,
             pct,
             CASE WHEN contains(value, '|') THEN substr(value, 1, length({before})) ELSE value END AS value,
             text
      FROM {source} WHERE NOT contains(value, '|') OR length({before}) > 1"""


def noise(names=NAME_DENYLIST, locations=LOCATION_DENYLIST) -> str:
    """Test of one finding (entity, value) for a false positive."""
    bare = strip("value")
    name_list = ", ".join(lit(n) for n in names)
    place_list = ", ".join(lit(n) for n in locations)
    ids = " OR ".join(f"regexp_matches({bare}, {lit(p)})" for p in STRUCTURAL_IDS)
    return f"""(
        regexp_matches(value, '[{SEPARATORS}]')
        OR (entity = 'PERSON' AND upper({bare}) = {bare} AND lower({bare}) <> {bare} AND length({bare}) > 2)
        OR (entity = 'PERSON' AND lower({bare}) IN ({name_list}))
        OR (entity = 'LOCATION' AND lower({bare}) IN ({place_list}))
        OR {ids})"""


def clean_rows(source: str, names=NAME_DENYLIST, locations=LOCATION_DENYLIST) -> str:
    return f"SELECT * FROM {source} WHERE NOT {noise(names, locations)}"


def with_settled(corpus_sql: str, rules, clean: bool = True, extra: str | None = None,
                 where: str = "", **span_options) -> str:
    """CTEs corpus, raw, clean, ranked, walk, kept; to be followed by a SELECT."""
    raw = span_rows(rules, **span_options)
    if extra:
        raw = f"{raw} UNION ALL {extra}"
    steps = (
        f"clipped AS ({clipped_rows('raw')}), clean AS (SELECT * FROM ({clean_rows('clipped')}){where})"
        if clean else f"clean AS (SELECT * FROM raw{where})"
    )
    return f"""
    WITH RECURSIVE corpus AS ({corpus_sql}),
    raw AS ({raw}),
    {steps},
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id
        ORDER BY pct DESC, start, stop - start DESC, entity, rule) AS place FROM clean),
    walk AS (
      SELECT doc_id, place, [{{'s': start, 'e': stop, 'p': place}}] AS taken FROM ranked WHERE place = 1
      UNION ALL
      SELECT w.doc_id, r.place,
             CASE WHEN len(list_filter(w.taken, lambda t: t.s < r.stop AND t.e > r.start)) > 0 THEN w.taken
                  ELSE list_append(w.taken, {{'s': r.start, 'e': r.stop, 'p': r.place}}) END
      FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.place = w.place + 1),
    last AS (SELECT doc_id, arg_max(taken, place) AS taken FROM walk GROUP BY doc_id),
    kept AS (
      SELECT r.* FROM ranked r JOIN (SELECT doc_id, unnest(taken).p AS place FROM last) t
      ON t.doc_id = r.doc_id AND t.place = r.place)"""


def numbered(order: str = "backward") -> str:
    """CTE entries: the vault of each document."""
    way = "max(start) AS first_at" if order == "backward" else "-min(start) AS first_at"
    return f""",
    firsts AS (SELECT doc_id, label, value, {way} FROM kept GROUP BY doc_id, label, value),
    entries AS (
      SELECT doc_id, label, value,
             row_number() OVER (PARTITION BY doc_id, label ORDER BY first_at DESC)::INTEGER AS n,
             row_number() OVER (PARTITION BY doc_id ORDER BY first_at DESC)::INTEGER AS seq
      FROM firsts),
    named AS (SELECT *, '{{{{' || label || '_' || n || '}}}}' AS placeholder FROM entries)"""


def masked(names: str = "named", on: str = "n.doc_id = k.doc_id") -> str:
    """CTE masked: (doc_id, text, masked) of every document of the corpus."""
    return f""",
    cuts AS (
      SELECT k.doc_id, k.start, k.stop, n.placeholder,
             lag(k.stop, 1, 0) OVER (PARTITION BY k.doc_id ORDER BY k.start) AS after,
             row_number() OVER (PARTITION BY k.doc_id ORDER BY k.start DESC) AS back
      FROM kept k JOIN {names} n ON {on} AND n.label = k.label AND n.value = k.value),
    bodies AS (
      SELECT c.doc_id, string_agg(substr(d.text, c.after + 1, c.start - c.after) || c.placeholder, ''
                                  ORDER BY c.start) AS body, max(c.stop) AS stop
      FROM cuts c JOIN corpus d ON d.doc_id = c.doc_id GROUP BY c.doc_id),
    masked AS (
      SELECT d.doc_id, d.text,
             CASE WHEN NOT regexp_matches(d.text, '\\S') THEN ''
                  WHEN b.body IS NULL THEN d.text
                  ELSE b.body || substr(d.text, b.stop + 1) END AS masked
      FROM corpus d LEFT JOIN bodies b ON b.doc_id = d.doc_id)"""


FINDING_SELECT = (
    "doc_id, entity, label, rule, start, stop AS \"end\", (pct / 100.0)::DECIMAL(4,2) AS score, value"
)


def scan_sql(corpus_sql: str, rules, **options) -> str:
    return f"WITH corpus AS ({corpus_sql}) SELECT {FINDING_SELECT} FROM ({span_rows(rules, **options)})"


def line_of(start: str = "start", text: str = "text") -> str:
    return f"(length(regexp_replace(substr({text}, 1, {start}), '[^\\n]', '', 'g')) + 1)::INTEGER"


def vulnerability_rows(rules=VULNERABILITY_RULES, corpus: str = "corpus") -> str:
    """First match per (document, rule, line)."""
    parts = []
    for no, r in enumerate(rules):
        parts.append(
            f"SELECT doc_id, {no} AS rule_no, {lit(r.rule_id)} AS rule_id, {lit(r.title)} AS title, "
            f"{lit(r.description)} AS description, {lit(r.severity)} AS severity, "
            f"{line_of()} AS line_number, {lit(r.cwe)} AS cwe, {lit(r.advice)} AS advice, "
            f"start, text FROM ({match_rows(r.rule_id, r, corpus)})"
        )
    return f"""
      SELECT doc_id, rule_no, rule_id, title, description, severity, line_number,
             {strip("string_split(any_value(text), chr(10))[line_number]")} AS line_text,
             cwe, advice, 'custom' AS source, min(start) AS start
      FROM ({' UNION ALL '.join(parts)})
      GROUP BY doc_id, rule_no, rule_id, title, description, severity, line_number, cwe, advice"""


SEVERITY_RANK_SQL = (
    "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
)


def by_name(rules, *names: str):
    return tuple(r for r in rules if r.rule in names)
