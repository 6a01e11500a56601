"""SQL for those queries of this package that an independent engine can answer."""

from __future__ import annotations

from threatloom.llm import chat, url_filter
from threatloom.llm.queries import CONTROL_TEXT

SPACE = r"[\x20\x09-\x0D]"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(text: str) -> str:
    """A text as a pattern that matches just it."""
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in text)


def _chat() -> str:
    controls = "|".join(escaped(c) for c in (*chat.RESERVED, *chat.FOREIGN))
    markers = " ".join(f"WHEN {literal(r)} THEN {len(m)}" for r, m in chat.ROLE_MARKERS.items())
    marks = f"{len(chat.OTHER_ROLE) + len(chat.HEADER_END)} + length(role)"

    def growth(column: str) -> str:
        return (
            f"2 * len(regexp_extract_all({column}, {literal(controls)}))"
            f" + length({column}) - length(replace({column}, {literal(chat.ESCAPE)}, ''))"
        )

    return f"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', {literal(CONTROL_TEXT)}
          UNION ALL SELECT -1, 1, 'assistant', {literal(CONTROL_TEXT)})
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(CASE role {markers} ELSE {marks} + {growth("role")} END + length(text) + {growth("text")}
                        + {len(chat.TURN_END)}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id"""


def _urls() -> str:
    """Every rule tried on every URL, the first that holds decides."""

    def fits(regex: str) -> str:
        return f"regexp_matches(page, {literal('^(?:' + regex + ')')}, 's')"

    pages = sorted(url_filter.PAGE_RULES, key=lambda r: (r.rank, r.text), reverse=True)
    rules = " ".join(f"WHEN {fits(r.regex.replace(chr(92) + '/', '/'))} THEN {literal(r.text)}" for r in pages)
    verdicts = " ".join(f"WHEN {literal(r.text)} THEN {literal(r.verdict)}" for r in pages)
    patterns = " ".join(f"WHEN {fits(r.regex)} THEN {literal(r.text)}" for r in url_filter.method_rules())
    return rf"""
        WITH cut AS (
          SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut),
        parts AS (
          SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts),
        judged AS (
          SELECT page_id, host, path, CASE {rules} END AS rule, CASE {patterns} END AS pattern
          FROM (SELECT *, host || path AS page FROM parts))
        SELECT page_id, host, path, rule, pattern,
               CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END
                    WHEN pattern IS NOT NULL THEN split_part(pattern, ':', 1) ELSE 'allow' END AS verdict
        FROM judged"""


def _lines() -> str:
    return rf"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
        keyed AS (
          SELECT doc_id, pos, line,
                 translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT k.*, c.key IS NOT NULL AS goes FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
        FROM marked GROUP BY doc_id"""


def _repair() -> str:
    """Every path through the automaton, the least of each state kept turn by turn."""
    bit = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    bytes_ = f"list_transform(string_split({key}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda crc, byte: {bit}), 4294967295)"
    wanted = "CASE WHEN state = 'u' THEN 'a' ELSE 'u' END"
    name = "CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END"

    def line(what: str) -> str:
        return f"CASE WHEN audit = '' OR NOT regexp_matches(audit, '[KRI]') THEN {what} ELSE said || chr(10) || {what} END"

    return rf"""
        WITH RECURSIVE harmed AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS harm
          FROM conversations),
        present AS (
          SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
                 CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM harmed, (VALUES (1), (2)) copies(copy) WHERE harm <> 0 AND (copy = 1 OR harm = 3)),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM present),
        seen AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
        turns AS (
          SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?]{SPACE}*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
        paths AS (
          SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM conversations
          UNION ALL
          SELECT conv_id, pos, state, best.cost, best.audit, best.said FROM (
            SELECT conv_id, pos, state, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM (
              SELECT conv_id, pos, CASE letter WHEN 'D' THEN state WHEN 'K' THEN left(role, 1) ELSE {wanted} END AS state,
                     CAST(cost + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                       + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS BIGINT) AS cost,
                     audit || letter AS audit,
                     CASE letter WHEN 'D' THEN said WHEN 'K' THEN {line("role || ':' || text")}
                       ELSE {line(f"({name}) || ':' || text")} END AS said
              FROM (SELECT p.conv_id, t.pos, t.role, t.text, t.fault, letter,
                           CASE WHEN ins THEN {wanted.replace("state", "p.state")} ELSE p.state END AS state,
                           p.cost + CASE WHEN ins THEN 3 ELSE 0 END AS cost,
                           p.audit || CASE WHEN ins THEN 'I' ELSE '' END AS audit,
                           CASE WHEN ins THEN {line(f"({name.replace('state', 'p.state')}) || ':'").replace("audit", "p.audit")} ELSE said END AS said
                    FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos + 1,
                         (VALUES (false), (true)) i(ins), (VALUES ('D'), ('K'), ('R')) l(letter))
              WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate')
                AND (letter = 'R' OR state || left(role, 1) IN ('s', 'u', 'su', 'ua', 'au'))) steps
            GROUP BY conv_id, pos, state) least),
        counted AS (
          SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM turns GROUP BY conv_id),
        ends AS (
          SELECT p.conv_id, min({{'cost': cost + CASE state WHEN 'u' THEN 3 ELSE 0 END,
                                 'audit': audit || CASE state WHEN 'u' THEN 'I' ELSE '' END,
                                 'said': said || CASE state WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
          FROM paths p LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
          WHERE p.pos = coalesce(c.n, 0) AND state <> 's' GROUP BY p.conv_id)
        SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost,
               best.audit AS audit, sha256(best.said) AS repaired_sha256
        FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def _search() -> str:
    """Every document scored for every item."""

    def terms(column: str) -> str:
        folded = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {terms("text")} AS found FROM documents WHERE text IS NOT NULL),
        sized AS (SELECT r, doc_id, CAST(len(found) AS BIGINT) AS n, found FROM docs WHERE len(found) > 0),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
        postings AS (
          SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(found) AS term FROM sized) GROUP BY r, term),
        items AS (
          SELECT i, item_id, unnest(list_distinct({terms("text")})) AS term
          FROM (SELECT row_number() OVER () AS i, * FROM benchmark WHERE text IS NOT NULL)),
        weights AS (
          SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
          FROM postings, totals GROUP BY term, docs),
        lengths AS (SELECT r, doc_id, 10 + ((90 * n * docs) // terms) AS m FROM sized, totals),
        scores AS (
          SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
          FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r)
          GROUP BY i, item_id, doc_id, r),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""


def _join(wide: int = 4, percent: int = 85) -> str:
    """Every pair of documents that share a shingle compared, and all that links lead to."""
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH RECURSIVE docs AS (
          SELECT row_number() OVER () AS r, doc_id,
                 coalesce(regexp_extract_all({folded}, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
        sets AS (
          SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {wide} THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - {wide - 2}), lambda i: array_to_string(words[i:i + {wide - 1}], ' '))) END AS own
          FROM docs),
        members AS (SELECT r, len(own) AS n, unnest(own) AS shingle FROM sets),
        shared AS (
          SELECT a.r AS x, b.r AS y, a.n + b.n - count(*) AS whole, count(*) AS n
          FROM members a JOIN members b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n),
        links AS (SELECT x, y FROM shared WHERE 100 * n >= {percent} * whole),
        reached AS (
          SELECT r AS x, r AS y FROM sets
          UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y)
        SELECT s.doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, least.component_id
        FROM sets s JOIN (SELECT x, min(doc_id) AS component_id FROM reached JOIN sets ON sets.r = reached.y GROUP BY x) least ON least.x = s.r"""


def oracles() -> dict[str, str]:
    """The SQL by query name; the others rest on trained models, tokenizers or searches, and are tested by brute force."""
    return {
        "op3_chat_format": _chat(),
        "op6_url_filter": _urls(),
        "op7_line_dedup": _lines(),
        "op8_jaccard_join": _join(),
        "op11_conversation_repair": _repair(),
        "op12_lexical_search": _search(),
    }
