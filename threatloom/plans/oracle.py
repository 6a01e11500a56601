"""The registered questions in SQL, for an independent engine.

Written against the same source tables, in relational terms where the Spark
side works on arrays: exploded tokens and grouping instead of array functions,
recursive steps instead of folds, long header rows instead of maps.  Only the
texts that derive the sample tables and the fixed rule values are shared.
"""

from __future__ import annotations

import re

from threatloom.functions import constants as K
from threatloom.operators.fusion import DIGEST_LIMITS
from threatloom.params import DEFAULTS
from threatloom.sources import sample_tables as S

_TABLES = {name: name for name in S.SOURCES}


def lit(value: str) -> str:
    """Text literal; this engine takes backslashes as they are."""
    return "'" + value.replace("'", "''") + "'"


def _derived(text: str) -> str:
    return S.render(text, "ansi", _TABLES)


# The checker's \b and \w are ASCII; letters outside ASCII become an underscore first.
def _masked(expr: str) -> str:
    return rf"regexp_replace({expr}, '[^\P{{L}}\x00-\x7F]', '_', 'g')"


_KEYWORDS = "|".join(f"(?:{p})" for p in K.SPAM_KEYWORD_GROUPS)
_RULES = [
    (category, pattern, description)
    for category, pairs in (
        ("SE", K.SOCIAL_PATTERNS),
        ("UG", K.URGENCY_PATTERNS),
        ("AU", K.AUTHORITY_PATTERNS),
        ("PS", K.PSYCHOLOGICAL_PATTERNS),
    )
    for pattern, description in pairs
]


def _first_match(token: str, patterns: list[str], values: list[str]) -> str:
    arms = " ".join(
        f"WHEN regexp_full_match({token}, {lit(p)}) THEN {v}" for p, v in zip(patterns, values, strict=True)
    )
    return f"CASE {arms} END"


def _scan_cte(rules: list[tuple[str, str, str]], source: str) -> str:
    """Classified tokens, one a row: (message_id, at, token, category, description)."""
    master = lit("|".join(f"(?:{p})" for _, p, _ in rules))
    number = _first_match("token", [p for _, p, _ in rules], [str(i) for i in range(len(rules))])
    names = ", ".join(f"({i}, {lit(c)}, {lit(d)})" for i, (c, _, d) in enumerate(rules))
    parts = " UNION ALL ".join(
        f"SELECT message_id, {k} AS part, regexp_extract_all({_masked(f'lower({c})')}, {master}) AS tokens FROM {source}"
        for k, c in ((0, "subject"), (1, "body_text"))
    )
    return f"""
        SELECT t.message_id, t.place, t.token, r.category, r.description
        FROM (SELECT message_id, place, token, {number} AS k
              FROM (SELECT message_id, part * 10000000 + unnest(range(len(tokens))) AS place, unnest(tokens) AS token
                    FROM ({parts}))) AS t
        JOIN (VALUES {names}) AS r(k, category, description) ON r.k = t.k"""


def _ext_is(name: str, extensions: list[str]) -> str:
    body = "|".join(re.escape(e) for e in extensions)
    return f"regexp_matches({name}, {lit(rf'[.](?:{body})$')})"


def _lines(*pairs: tuple[str, str]) -> str:
    """`` | ``-joined texts of the conditions that hold."""
    items = ", ".join(f"CASE WHEN {flag} THEN {line} END" for flag, line in pairs)
    return f"concat_ws(' | ', {items})"


_AUTH = "coalesce(auth, '')"
_SPACE = r"[\s\x1C-\x1F]"


def _spam_ctes() -> dict[str, str]:
    group_texts = [lit(p) for p in K.SPAM_KEYWORD_GROUPS]
    token_group = _first_match("token", K.SPAM_KEYWORD_GROUPS, group_texts)
    host_pattern = lit("|".join(f"(?:{p})" for p in K.SUSPICIOUS_HOST_PATTERNS))
    url_pattern = lit(K.URL_PATTERN)
    count_kw = "len(regexp_extract_all({}, " + lit(_KEYWORDS) + "))"
    low_text, low_html = _masked("lower(body_text)"), _masked("lower(body_html)")
    free = "|".join(re.escape(d) for d in K.FREEMAIL_DOMAINS)
    required = ", ".join(f"({i}, {lit(h)})" for i, h in enumerate(K.REQUIRED_HEADERS))
    return {
        "subj": f"""
            SELECT message_id, upper(subject) = subject AND lower(subject) <> subject AND length(subject) > 10 AS caps,
                   length(subject) - length(replace(subject, '!', '')) > 2 AS bangs,
                   regexp_matches(lower(subject), {lit(K.MONEY_PATTERN)}) AS money
            FROM mail""",
        "subj_groups": f"""
            SELECT message_id, count(*) AS n,
                   string_agg('Spam keyword in subject: ' || g, ' | ' ORDER BY first_at) AS lines
            FROM (SELECT message_id, g, min(place) AS first_at
                  FROM (SELECT message_id, place, {token_group} AS g
                        FROM (SELECT message_id, unnest(range(len(tokens))) AS place, unnest(tokens) AS token
                              FROM (SELECT message_id,
                                           regexp_extract_all({_masked("lower(subject)")}, {lit(_KEYWORDS)}) AS tokens
                                    FROM mail)))
                  GROUP BY message_id, g)
            GROUP BY message_id""",
        "subj_score": f"""
            SELECT s.message_id,
                   CASE WHEN caps THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN bangs THEN 0.5::DOUBLE ELSE 0 END
                     + coalesce(g.n, 0) * 1.5::DOUBLE + CASE WHEN money THEN 0.5::DOUBLE ELSE 0 END AS score,
                   {_lines(("caps", "'Subject in all caps'"), ("bangs", "'Excessive exclamation marks'"),
                           ("g.n > 0", "g.lines"), ("money", "'Money mentioned in subject'"))} AS lines
            FROM subj s LEFT JOIN subj_groups g USING (message_id)""",
        "kw": f"""
            SELECT message_id, CAST({count_kw.format(low_text)} + {count_kw.format(low_html)} AS BIGINT) AS n
            FROM mail""",
        "url_rows": f"""
            SELECT message_id, unnest(range(len(urls))) AS place, unnest(urls) AS url
            FROM (SELECT message_id, list_concat(regexp_extract_all(lower(body_text), {url_pattern}),
                                                 regexp_extract_all(lower(body_html), {url_pattern})) AS urls
                  FROM mail)""",
        "url_hosts": f"""
            SELECT url, CASE WHEN regexp_matches(net, '[][]')
                              AND NOT regexp_matches(net, '^([^][]*@)?[[][0-9a-f:.]+[]](:[^][]*)?$') THEN false
                             ELSE regexp_matches(
                               CASE WHEN contains(net, '[') THEN regexp_extract(net, '[[]([0-9a-f:.]+)[]]', 1)
                                    ELSE regexp_replace(regexp_replace(net, '^.*@', ''), ':.*$', '') END,
                               {host_pattern}) END AS bad
            FROM (SELECT DISTINCT url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS net FROM url_rows)""",
        "bad_urls": """
            SELECT message_id, sum(n) * 0.5::DOUBLE AS score,
                   string_agg(rtrim(repeat(url || ' | ', CAST(n AS INT)), ' |'), ' | ' ORDER BY first_at) AS urls
            FROM (SELECT message_id, r.url, count(*) AS n, min(r.place) AS first_at
                  FROM url_rows r JOIN url_hosts h ON h.url = r.url AND h.bad
                  GROUP BY message_id, r.url)
            GROUP BY message_id""",
        "body": rf"""
            SELECT m.message_id, kw.n AS matches, coalesce(u.links, 0) AS links,
                   body_html <> '' AND length(regexp_replace(lower(body_text), '^{_SPACE}+|{_SPACE}+$', '', 'g')) < 50
                     AND len(regexp_extract_all(lower(body_html), '<img')) > 2 AS images,
                   regexp_matches(lower(body_html), {lit(K.HIDDEN_TEXT_PATTERN)}) AS hidden
            FROM mail m JOIN kw USING (message_id)
            LEFT JOIN (SELECT message_id, count(*) AS links FROM url_rows GROUP BY 1) u USING (message_id)""",
        "body_score": f"""
            SELECT message_id, matches * 0.5::DOUBLE + CASE WHEN links > 10 THEN 1 ELSE 0 END
                     + CASE WHEN images THEN 1 ELSE 0 END + CASE WHEN hidden THEN 2 ELSE 0 END AS score,
                   {_lines(("matches > 0", "'Found ' || matches || ' spam keyword matches'"),
                           ("links > 10", "'Excessive links (' || links || ')'"),
                           ("images", "'Image-heavy email with little text'"),
                           ("hidden", "'Hidden text detected'"))} AS lines
            FROM body""",
        "hagg": """
            SELECT m.message_id,
              coalesce(bool_or(lower(h.name) = 'received-spf' AND contains(lower(value), 'fail')
                               AND NOT contains(lower(value), 'softfail')), false) AS spf_fail,
              coalesce(bool_or(lower(h.name) = 'received-spf' AND contains(lower(value), 'softfail')), false) AS spf_soft,
              string_agg(lower(value), ' ' ORDER BY pos) FILTER (lower(h.name) = 'authentication-results') AS auth,
              count(*) FILTER (lower(h.name) = 'dkim-signature') AS dkim,
              count(*) FILTER (lower(h.name) = 'received') AS hops,
              count(*) FILTER (lower(h.name) = 'from') AS froms,
              arg_min(value, pos) FILTER (lower(h.name) = 'from') AS from1,
              arg_min(value, pos) FILTER (lower(h.name) = 'return-path') AS ret1
            FROM mail m LEFT JOIN hdr h USING (message_id) GROUP BY m.message_id""",
        "hmiss": f"""
            SELECT m.message_id, count(*) AS n, string_agg('Missing ' || r.name || ' header', ' | ' ORDER BY r.k) AS lines
            FROM mail m CROSS JOIN (VALUES {required}) AS r(k, name)
            ANTI JOIN (SELECT DISTINCT message_id, lower(name) AS lname FROM hdr) h
              ON h.message_id = m.message_id AND h.lname = lower(r.name)
            GROUP BY m.message_id""",
        "hflags": rf"""
            SELECT a.*, regexp_matches({_AUTH}, 'dkim=(fail|permerror|neutral)') AS dkim_bad,
                   regexp_matches({_AUTH}, 'spf=(fail|permerror)') AND NOT spf_fail AS spf_bad,
                   froms > 1 AS several,
                   regexp_extract(lower(from1), '[\w.-]+@[\w.-]+') AS from_addr,
                   regexp_extract(lower(ret1), '[\w.-]+@[\w.-]+') AS ret_addr
            FROM hagg a""",
        "hscore": f"""
            SELECT f.message_id, f.hops,
              CASE WHEN spf_fail THEN 2.0::DOUBLE WHEN spf_soft THEN 1 ELSE 0 END AS spf_score,
              CASE WHEN spf_fail THEN 'SPF check failed' WHEN spf_soft THEN 'SPF soft fail' END AS spf_lines,
              CASE WHEN dkim_bad THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN spf_bad THEN 2.0::DOUBLE ELSE 0 END AS auth_score,
              nullif({_lines(("dkim_bad", "'DKIM verification failed (Authentication-Results)'"),
                             ("spf_bad", "'SPF verification failed (Authentication-Results)'"))}, '') AS auth_lines,
              CASE WHEN dkim = 0 THEN 0.5::DOUBLE ELSE 0 END AS dkim_score,
              CASE WHEN dkim = 0 THEN 'Missing DKIM signature' END AS dkim_lines,
              coalesce(m.n, 0) * 0.5::DOUBLE AS missing_score, m.lines AS missing_lines,
              CASE WHEN hops > 10 THEN 1.0::DOUBLE ELSE 0 END AS hop_score,
              CASE WHEN hops > 10 THEN 'Excessive hops in delivery path' END AS hop_lines,
              CASE WHEN several THEN 2.0::DOUBLE ELSE 0 END
                + CASE WHEN from_addr <> '' AND ret_addr <> '' AND from_addr <> ret_addr THEN 1.5::DOUBLE ELSE 0 END
                AS forged_score,
              nullif({_lines(("several", "'Multiple From headers detected'"),
                             ("from_addr <> '' AND ret_addr <> '' AND from_addr <> ret_addr",
                              "'From and Return-Path mismatch'"))}, '') AS forged_lines
            FROM hflags f LEFT JOIN hmiss m USING (message_id)""",
        "header_total": """
            SELECT message_id, spf_score + auth_score + dkim_score + missing_score + hop_score + forged_score AS score,
                   concat_ws(' | ', spf_lines, auth_lines, dkim_lines, missing_lines, hop_lines, forged_lines) AS lines
            FROM hscore""",
        "snd": rf"""
            SELECT message_id,
                   regexp_matches(lower(sender), 'ceo|president|director|manager')
                     AND regexp_matches(regexp_extract(lower(sender), '[\w.-]+@([\w.-]+)', 1), {lit(rf"(^|[.])({free})$")})
                     AS titled,
                   strpos(sender, '<') > 1 AND regexp_matches(split_part(sender, '<', 1), '[@.]') AS odd
            FROM mail""",
        "spam": f"""
            SELECT b.message_id,
                   s.score + b.score + coalesce(u.score, 0) + h.score + CASE WHEN titled THEN 1.5::DOUBLE ELSE 0 END
                     + CASE WHEN odd THEN 1.0::DOUBLE ELSE 0 END AS score,
                   s.score + b.score + CASE WHEN titled THEN 1.5::DOUBLE ELSE 0 END
                     + CASE WHEN odd THEN 1.0::DOUBLE ELSE 0 END AS plain_score,
                   concat_ws(' | ', nullif(s.lines, ''), nullif(b.lines, ''),
                     CASE WHEN titled THEN 'Corporate title with freemail provider' END,
                     CASE WHEN odd THEN 'Suspicious display name format' END) AS indicators,
                   coalesce(u.urls, '') AS suspicious_urls, h.lines AS header_issues
            FROM subj_score s JOIN body_score b USING (message_id) JOIN header_total h USING (message_id)
            JOIN snd USING (message_id) LEFT JOIN bad_urls u USING (message_id)""",
        "spam_risk": "SELECT *, " + _risk("score", 5, 10) + " AS risk_level FROM spam",
    }


def _risk(score: str, medium: float, high: float) -> str:
    return f"CASE WHEN {score} >= {high} THEN 'high' WHEN {score} >= {medium} THEN 'medium' ELSE 'low' END"


def _nlp_ctes() -> dict[str, str]:
    def counted(category: str, weight: float) -> str:
        return f"""
            SELECT message_id, sum(n) * {weight}::DOUBLE AS score,
                   string_agg(description || ' (' || n || ' occurrences)', ' | ' ORDER BY first_at) AS lines
            FROM by_desc WHERE category = '{category}' GROUP BY message_id"""

    return {
        "tok": _scan_cte(_RULES, "mail"),
        "by_desc": """
            SELECT message_id, category, description, count(*) AS n, min(place) AS first_at
            FROM tok GROUP BY 1, 2, 3""",
        "cnt": rf"""
            SELECT message_id,
                   CAST(length(subject || body_text) - length(replace(subject || body_text, '!', '')) AS BIGINT) AS bangs,
                   CAST(len(regexp_extract_all({_masked("subject || chr(10) || body_text")}, '\b[A-Z]{{4,}}\b')) AS BIGINT)
                     AS caps
            FROM mail""",
        "se": counted("SE", 2.0),
        "ps": counted("PS", 1.0),
        "ug0": counted("UG", 1.5),
        "ug": """
            SELECT c.message_id,
                   coalesce(u.score, 0) + CASE WHEN bangs > 2 THEN bangs * 0.5::DOUBLE ELSE 0 END
                     + CASE WHEN caps > 3 THEN caps * 0.3::DOUBLE ELSE 0 END AS score,
                   concat_ws(' | ', u.lines,
                     CASE WHEN bangs > 2 THEN 'Excessive exclamation marks (' || bangs || ')' END,
                     CASE WHEN caps > 3 THEN 'Excessive caps words (' || caps || ')' END) AS lines
            FROM cnt c LEFT JOIN ug0 u USING (message_id)""",
        "au_desc": r"""
            SELECT t.message_id, t.description, count(*) AS n, min(t.place) AS first_at,
                   bool_or(d.domain = '' OR NOT contains(d.domain, t.token)) AS mismatch
            FROM tok t
            JOIN (SELECT message_id, regexp_extract(lower(sender), '@([\w.-]+)', 1) AS domain FROM mail) d
              USING (message_id)
            WHERE t.category = 'AU' GROUP BY 1, 2""",
        "au": """
            SELECT message_id, sum(n * CASE WHEN mismatch THEN 2.5::DOUBLE ELSE 0.5::DOUBLE END) AS score,
                   string_agg(description || CASE WHEN mismatch THEN ' (domain mismatch)' ELSE '' END, ' | '
                              ORDER BY first_at) AS lines
            FROM au_desc GROUP BY 1""",
        "nlp": """
            SELECT m.message_id, coalesce(se.score, 0) + ug.score + coalesce(au.score, 0) AS score,
                   coalesce(se.score, 0) + coalesce(au.score, 0) + coalesce(ps.score, 0) AS other_score,
                   coalesce(se.lines, '') AS social, ug.lines AS urgency, coalesce(au.lines, '') AS authority,
                   coalesce(ps.lines, '') AS psychological
            FROM mail m JOIN ug USING (message_id) LEFT JOIN se USING (message_id)
            LEFT JOIN au USING (message_id) LEFT JOIN ps USING (message_id)""",
        "nlp_risk": "SELECT *, " + _risk("score", 7, 14) + " AS risk_level FROM nlp",
    }


def _att_ctes() -> dict[str, str]:
    magic = " ".join(f"WHEN starts_with(hx, '{v}') THEN '{n}'" for v, n in K.MAGIC_PREFIXES)
    riff = " ".join(f"WHEN substr(hx, 17, 8) = '{v}' THEN '{n}'" for v, n in K.RIFF_FORMS)
    expected = " OR ".join(f"(kind = '{k}' AND {_ext_is('name', e)})" for k, e in K.EXPECTED_EXTENSIONS.items())
    strict = " ".join(
        f"WHEN {_ext_is('name', [e])} THEN struct_pack(points := "
        f"{5.0 if e in K.MEDIA_EXTENSIONS or e == 'wav' else 2.0}::DOUBLE, line := "
        f"'Invalid file signature for .{e}: expected {d} signature but none found')"
        for e, d in K.STRICT_SIGNATURES
    )
    return {
        "att0": rf"""
            SELECT *, regexp_replace(regexp_replace(lower(filename), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '[.]+$', '')
                     AS name, hex(head) AS hx
            FROM att""",
        "att1": f"""
            SELECT *, CASE WHEN length(hx) < 8 THEN NULL
                        WHEN starts_with(hx, '{K.RIFF_HEX}') THEN
                          CASE WHEN length(hx) < 24 THEN NULL {riff} END
                        {magic}
                        WHEN substr(hx, 9, 8) = '{K.FTYP_HEX}' THEN 'mp4' END AS kind,
                   {_ext_is("name", K.DANGEROUS_EXTENSIONS)} AS dangerous,
                   {_ext_is("name", K.SUSPICIOUS_SUFFIXES)} AS suspicious,
                   len(string_split(name, '.')) > 2 AS several
            FROM att0""",
        "att2": f"""
            SELECT *, CASE WHEN dangerous THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN suspicious THEN 3.0::DOUBLE ELSE 0 END
                     + CASE WHEN several THEN 1.5::DOUBLE ELSE 0 END AS ext_score,
                   {_lines(("dangerous", "'Dangerous file type: ' || filename"),
                           ("suspicious", "'Suspicious file extension: ' || filename"),
                           ("several", "'Multiple extensions detected: ' || filename"))} AS ext_lines,
                   CASE WHEN kind IS NULL THEN CASE {strict} END
                        WHEN kind = 'exe' AND NOT {_ext_is("name", ["exe"])} THEN
                          struct_pack(points := 5.0::DOUBLE, line := 'Executable disguised as another file type')
                        WHEN NOT ({expected}) THEN
                          struct_pack(points := 2.0::DOUBLE,
                                      line := 'File type mismatch: ' || filename || ' (detected ' || kind || ')')
                   END AS typ,
                   CASE WHEN size > 26214400 THEN 1.5::DOUBLE
                        WHEN {_ext_is("lower(filename)", K.MEDIA_EXTENSIONS)} AND size < 1024 THEN 1.0::DOUBLE
                        ELSE 0 END AS size_score,
                   CASE WHEN size > 26214400 THEN 'Unusually large attachment: ' || filename || ' ('
                               || printf('%.1f', size / 1048576.0::DOUBLE) || 'MB)'
                        WHEN {_ext_is("lower(filename)", K.MEDIA_EXTENSIONS)} AND size < 1024 THEN
                          'Suspiciously small media file: ' || filename || ' (' || size || ' bytes)'
                        ELSE '' END AS size_line,
                   {_ext_is("lower(filename)", K.SMALL_VIDEO_EXTENSIONS)} AND least(size, 26214400) < 102400 AS video
            FROM att1""",
        "att3": """
            SELECT *, coalesce(typ.points, 0) AS type_score, coalesce(typ.line, '') AS type_line,
                   ext_score + coalesce(typ.points, 0) + size_score + coalesce(arch_score, 0) AS meta,
                   concat_ws(' | ', filename || ': ' || typ.line, nullif(arch_lines, '')) AS suspicious_attachments,
                   concat_ws(' | ', CASE WHEN truncated THEN 'Attachment truncated for scanning: ' || filename END,
                             nullif(size_line, '')) AS size_anomalies
            FROM att2 LEFT JOIN arch_found USING (message_id, pos)""",
        "arch_found": """
            SELECT message_id, 1 AS pos, total AS arch_score, lines AS arch_lines FROM tot0""",
        # the walk, one attachment a step
        "walk": _walk("att3", 10, 100 * K.MIB),
        "media": """
            SELECT message_id, sum(CASE WHEN taken THEN meta ELSE 0 END)
                     + 0.5::DOUBLE * count(*) FILTER (flagged) AS score,
                   string_agg(suspicious_attachments, ' | ' ORDER BY pos)
                     FILTER (taken AND suspicious_attachments <> '') AS suspicious_attachments,
                   string_agg(ext_lines, ' | ' ORDER BY pos) FILTER (taken AND ext_lines <> '') AS file_type_warnings,
                   string_agg(size_anomalies, ' | ' ORDER BY pos) FILTER (taken AND size_anomalies <> '') AS size_anomalies,
                   string_agg('Suspicious video size: ' || filename, ' | ' ORDER BY pos) FILTER (flagged) AS flagged
            FROM walk JOIN att3 USING (message_id, pos) GROUP BY 1""",
        "media_all": "SELECT m.message_id, coalesce(d.score, 0) AS score, "
        + _risk("coalesce(d.score, 0)", 2, 5)
        + """ AS risk_level, coalesce(d.suspicious_attachments, '') AS suspicious_attachments,
                   coalesce(d.file_type_warnings, '') AS file_type_warnings,
                   coalesce(d.size_anomalies, '') AS size_anomalies, coalesce(d.flagged, '') AS flagged
            FROM mail m LEFT JOIN media d USING (message_id)""",
    }


def _walk(source: str, max_count: int, max_total: int, scored: bool = True) -> str:
    """Recursive admission walk: (message_id, pos, taken, flagged)."""
    meta = "a.meta" if scored else "0::DOUBLE"
    video = "a.video" if scored else "false"

    def step(n: str, total: str, running: str) -> str:
        fits = f"{n} < {max_count} AND {total} + a.size <= {max_total}"
        flagged = f"{fits} AND {video} AND {running} + {meta} < 5"
        return f"""a.message_id, a.pos, {fits} AS taken, {flagged} AS flagged,
               {n} + CASE WHEN {fits} THEN 1 ELSE 0 END AS n,
               {total} + CASE WHEN {fits} THEN a.size ELSE 0 END AS total,
               {running} + CASE WHEN {fits} THEN {meta} ELSE 0 END
                 + CASE WHEN {flagged} THEN 0.5::DOUBLE ELSE 0 END AS running"""

    return f"""
        SELECT {step("0", "0::BIGINT", "0::DOUBLE")} FROM {source} a WHERE a.pos = 1
        UNION ALL
        SELECT {step("w.n", "w.total", "w.running")}
        FROM walk w JOIN {source} a ON a.message_id = w.message_id AND a.pos = w.pos + 1"""


def _member_ctes() -> dict[str, str]:
    escapes = r"regexp_matches({0}, '^([/\\]|\pL:)') OR contains({0}, '..')"
    base = rf"""
        SELECT m.*, lower(safe_name) AS low, coalesce({escapes.format("linkname")}, false) AS link_escapes,
               {escapes.format("name")} AS escapes,
               {_ext_is("lower(safe_name)", K.DANGEROUS_EXTENSIONS)} AS dangerous,
               {_ext_is("lower(safe_name)", K.ARCHIVE_EXTENSIONS)} AS is_archive,
               {_ext_is("lower(safe_name)", K.SUSPICIOUS_SUFFIXES)} AS suspicious
        FROM (SELECT r.*, {_safe_name("name")} AS safe_name, c.member_count
              FROM members r JOIN member_counts c USING (container)) m"""

    def scored(source: str, below: str, below_lines: str) -> str:
        nested = f"CASE nested WHEN 'ok' THEN {below} WHEN 'bomb' THEN 5 WHEN 'unreadable' THEN 3 ELSE 0 END"
        arch = f"(2.0::DOUBLE + {nested})"
        nested_lines = (
            f"CASE nested WHEN 'ok' THEN {below_lines} WHEN 'bomb' THEN 'Zip bomb detected: ' || container_name || '/' || safe_name || ' (' || reason || ')'"
            " WHEN 'unreadable' THEN 'Failed to inspect nested archive ' || safe_name || ': ' || reason END"
        )

        def says(what: str) -> str:
            return f"'Archive ' || container_name || ' contains {what}: ' || safe_name"

        return f"""
            SELECT *,
              CASE WHEN settled THEN 5.0::DOUBLE ELSE
                CASE WHEN kind = 'zip' AND escapes THEN 5.0::DOUBLE ELSE 0 END
                + CASE WHEN dangerous THEN 5.0::DOUBLE ELSE
                    CASE WHEN is_archive THEN {arch} ELSE 0 END
                    + CASE WHEN suspicious AND NOT (is_archive AND {arch} >= 5) THEN 3.0::DOUBLE ELSE 0 END END
              END AS points,
              concat_ws(' | ',
                CASE WHEN kind = 'zip' AND escapes THEN
                  'Zip file ' || container_name || ' contains path traversal attempt: ' || safe_name END,
                CASE WHEN dangerous THEN {says("dangerous file")} END,
                CASE WHEN settled AND escapes THEN
                  'Tar file ' || container_name || ' contains path traversal attempt: ' || safe_name END,
                CASE WHEN settled AND NOT escapes THEN
                  'Tar file ' || container_name || ' contains link with path traversal attempt: ' || safe_name END,
                CASE WHEN is_archive AND NOT dangerous AND NOT settled THEN {says("nested archive")} END,
                CASE WHEN is_archive AND NOT dangerous AND NOT settled THEN nullif({nested_lines}, '') END,
                CASE WHEN suspicious AND NOT dangerous AND NOT settled AND NOT (is_archive AND {arch} >= 5)
                  THEN {says("suspicious file")} END) AS lines
            FROM (SELECT *, kind = 'tar' AND NOT dangerous AND (escapes OR link_escapes) AS settled FROM {source})"""

    def totals(source: str) -> str:
        return f"""
            SELECT message_id, container, any_value(penalty) + sum(points) AS total,
                   concat_ws(' | ',
                     CASE WHEN any_value(penalty) > 0 THEN 'Archive ' || any_value(container_name)
                       || ' contains too many files (' || any_value(member_count) || ')' END,
                     string_agg(lines, ' | ' ORDER BY member_pos) FILTER (lines <> '')) AS lines
            FROM (SELECT *, penalty + coalesce(sum(points) OVER (
                     PARTITION BY container ORDER BY member_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS ahead
                  FROM (SELECT *, CASE WHEN member_count > 1000 THEN 1.0::DOUBLE ELSE 0 END AS penalty FROM {source}))
            WHERE ahead < 5 GROUP BY 1, 2"""

    return {
        "mem": base,
        "mem1": scored("(SELECT * FROM mem WHERE depth = 1)", "0", "''"),
        "tot1": totals("mem1"),
        "mem0": scored(
            "(SELECT m.*, t.total AS t_total, t.lines AS t_lines FROM (SELECT * FROM mem WHERE depth = 0) m"
            " LEFT JOIN tot1 t ON t.container = m.container || '/' || m.member_pos)",
            "coalesce(t_total, 0)",
            "coalesce(t_lines, '')",
        ),
        "tot0": totals("mem0"),
    }


def _safe_name(name: str) -> str:
    last = rf"regexp_replace({name}, '(?s)^.*[/\\]', '')"
    clean = rf"regexp_replace({last}, '[^\pL\pN_\s\x1C-\x1F.\-]', '', 'g')"
    clean = f"trim(regexp_replace({clean}, '[.][.]+', '.', 'g'), '. ')"
    reserved = ", ".join(lit(n) for n in K.RESERVED_FILE_NAMES)
    return (
        f"(SELECT CASE WHEN c = '' THEN '{K.UNNAMED_FILE}' WHEN upper(trim(split_part(c, '.', 1))) IN ({reserved})"
        f" THEN left('_' || c, 255) ELSE left(c, 255) END FROM (SELECT {clean} AS c))"
    )


def _report_ctes() -> dict[str, str]:
    advice = ", ".join(
        f"CASE WHEN {flag} THEN {lit(line)} END"
        for flag, line in (
            ("s.risk_level = 'high'", K.REC_SPAM),
            ("n.social <> ''", K.REC_PHISHING),
            ("d.file_type_warnings <> ''", K.REC_ATTACHMENT),
            ("s.suspicious_urls <> ''", K.REC_URLS),
            ("n.authority <> ''", K.REC_AUTHORITY),
            ("n.urgency <> ''", K.REC_URGENCY),
        )
    )
    return {
        "rep": f"""
            SELECT m.message_id, m.subject, m.sender, m.recipient, m.date,
                   s.score + n.score + d.score AS overall,
                   CASE WHEN 'high' IN (s.risk_level, n.risk_level, d.risk_level) THEN 'high'
                        WHEN 'medium' IN (s.risk_level, n.risk_level, d.risk_level) THEN 'medium' ELSE 'low' END AS risk,
                   s.score AS spam_score, s.risk_level AS spam_risk, n.score AS nlp_score, n.risk_level AS nlp_risk,
                   d.score AS media_score, d.risk_level AS media_risk, s.indicators, s.suspicious_urls, s.header_issues,
                   n.social, n.urgency, n.authority, '' AS psychological, d.file_type_warnings, d.suspicious_attachments,
                   d.size_anomalies, d.flagged,
                   coalesce(nullif(list_filter([{advice}], lambda x: x IS NOT NULL), []), [{lit(K.REC_CLEAN)}]) AS advice
            FROM mail m JOIN spam_risk s USING (message_id) JOIN nlp_risk n USING (message_id)
            JOIN media_all d USING (message_id)""",
        "alerted": "SELECT * FROM rep WHERE risk IN ('medium', 'high') OR overall >= 30",
        "threats": """
            SELECT message_id, CASE WHEN greatest(spam_score, nlp_score, media_score) IN (spam_score, 0) THEN 'spam'
                                    WHEN greatest(spam_score, nlp_score, media_score) = nlp_score THEN 'phishing'
                                    ELSE 'malware' END AS threat_type, risk AS severity
            FROM rep WHERE risk IN ('medium', 'high')""",
    }


def _base_ctes() -> dict[str, str]:
    return {
        "mail_source": _derived(S.MAIL_SOURCE),
        "mail": _derived(S.MAIL),
        "hdr": "SELECT message_id, h.pos AS pos, h.name AS name, h.value AS value FROM (SELECT message_id, unnest("
        + S.header_entries_sql("ansi")
        + ") AS h FROM mail_source) WHERE h.value IS NOT NULL",
        "att": _derived(S.ATTACHMENTS),
        "members": _derived(S.MEMBERS),
        "member_counts": _derived(S.MEMBER_COUNTS),
        "member_names": _derived(S.MEMBER_NAMES_SQL),
        "parts": _derived(S.PARTS),
        "obs": _derived(S.OBSERVATIONS),
        "log_lines": _derived(S.LOG_LINES),
        "url_list": _derived(S.URLS),
        "accounts": _derived(S.ACCOUNTS),
        "processed": S.render(S.PROCESSED, "ansi", {**_TABLES, "mail": "mail"}),
        "rule_rows": _derived(S.RULES),
        "addresses": _derived(S.ADDRESSES),
        "texts": _derived(S.TEXTS),
    }


def _other_ctes() -> dict[str, str]:
    kind = r"""
        CASE WHEN contains(disposition, 'attachment') THEN 'attachment'
             WHEN trim(filename) <> '' THEN 'attachment'
             WHEN content_type = 'text/plain' THEN 'text' WHEN content_type = 'text/html' THEN 'html'
             WHEN is_multipart THEN 'other' ELSE 'attachment' END"""
    printable = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}]"
    ansi = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"

    def clean(expr: str) -> str:
        bare = f"regexp_replace({expr}, {lit(ansi)}, '', 'g')"
        # keep tabs: they are the one control character allowed
        return (
            f"replace(regexp_replace(replace({bare}, chr(9), chr(57344) || 'TAB' || chr(57344)),"
            f" {lit(printable.replace(chr(92) + 'p{Co}', ''))}, '', 'g'), chr(57344) || 'TAB' || chr(57344), chr(9))"
        )

    risky = rf"regexp_matches({{0}}, '^{_SPACE}*[=+\-@%|]') OR regexp_matches({{0}}, '^[\t\r]')"
    guard = "CASE WHEN " + risky + " THEN chr(39) || {0} ELSE {0} END"
    flat = "translate(text, chr(10) || chr(13) || chr(9), '   ')"
    return {
        "part_kinds": f"SELECT *, {kind} AS kind FROM parts",
        "clean_text": f"""
            SELECT conv_id, turn, text,
                   {clean("replace(replace(text, chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')")} AS log_text,
                   {clean(flat)} AS display
            FROM texts""",
        "guarded": f"""
            SELECT *, {guard.format("text")} AS cell, {guard.format("display")} AS display_cell FROM clean_text""",
        "sampled": """
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r
                           FROM obs) WHERE r <= 1000""",
        "logs": """
            SELECT event_id, value AS raw, CASE WHEN ok THEN value END AS js
            FROM (SELECT *, json_valid(value) AS ok FROM log_lines)""",
        "log_rows": """
            SELECT event_id, js ->> 'timestamp' AS stamp, js ->> 'level' AS level, js ->> 'message' AS message,
                   js ->> 'module' AS module, CAST(js ->> 'line' AS BIGINT) AS line, js ->> 'email_id' AS email_id,
                   js ->> 'User_Token' AS user_token, js, js IS NULL AS corrupt
            FROM (SELECT event_id, CAST(js AS JSON) AS js FROM logs)""",
        "counters": """
            SELECT threat_type AS counter, count(*) AS n FROM obs WHERE threat_type IS NOT NULL GROUP BY 1
            UNION ALL
            SELECT threat_type || '_' || severity, count(*) FROM obs WHERE threat_type IS NOT NULL GROUP BY 1""",
        "doc_mail": "SELECT * FROM mail WHERE starts_with(message_id, 'd')",
    }


def _all_ctes() -> dict[str, str]:
    return {
        **_base_ctes(),
        **_spam_ctes(),
        **_nlp_ctes(),
        **_att_ctes(),
        **_member_ctes(),
        **_report_ctes(),
        **_other_ctes(),
    }


class _Book:
    """Assembles a query with just the common table expressions it needs."""

    def __init__(self, overrides: dict[str, str] | None = None) -> None:
        self.ctes = {**_all_ctes(), **(overrides or {})}
        self.names = re.compile(r"\b(" + "|".join(sorted(self.ctes, key=len, reverse=True)) + r")\b")

    def needs(self, sql: str, seen: dict[str, None]) -> None:
        bare = re.sub(r"'(?:[^']|'')*'", "", sql)
        for name in re.findall(r"(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+\(*(\w+)", bare):
            if name in self.ctes and name not in seen:
                self.needs(self.ctes[name], seen) if name not in ("walk",) else self._walk(seen)
                seen[name] = None

    def _walk(self, seen: dict[str, None]) -> None:
        text = self.ctes["walk"].replace("FROM walk", "")
        self.needs(text, seen)

    def sql(self, query: str) -> str:
        seen: dict[str, None] = {}
        self.needs(query, seen)
        recursive = "RECURSIVE " if "walk" in seen else ""
        parts = ",\n".join(f"{name} AS ({self.ctes[name]})" for name in seen)
        return f"WITH {recursive}{parts}\n{query}" if seen else query


def _digest(column: str, k: int) -> str:
    return f"array_to_string(list_slice(string_split({column}, ' | '), 1, {k}), ' | ') AS {column}"


_DIGEST_COLUMNS = {path.split(".")[1]: k for path, k in DIGEST_LIMITS.items()}
_REPORT_NAMES = {
    "indicators": "indicators",
    "header_issues": "header_issues",
    "suspicious_urls": "suspicious_urls",
    "social_engineering_indicators": "social",
    "urgency_markers": "urgency",
    "authority_impersonation": "authority",
    "psychological_triggers": "psychological",
    "file_type_warnings": "file_type_warnings",
    "suspicious_attachments": "suspicious_attachments",
    "size_anomalies": "size_anomalies",
    "potential_deepfakes": "flagged",
}


def _queries() -> dict[str, str]:
    pct = "list_sort(list(processing_ms))"
    stats = f"""count(*) AS sample_count, round(avg(processing_ms), 4) AS avg_ms, min(processing_ms) AS min_ms,
                max(processing_ms) AS max_ms, {pct}[1 + count(*) // 2] AS p50_ms,
                {pct}[1 + CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT)] AS p95_ms,
                {pct}[1 + CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT)] AS p99_ms"""
    check = "SELECT message_id, round({0}_score, 4) AS score, coalesce({0}_lines, '') AS findings FROM hscore"
    unseen = "ANTI JOIN processed p USING (account_email, folder, message_id)"
    active = "SEMI JOIN (SELECT account_email FROM accounts WHERE enabled AND connected) a USING (account_email)"
    digest = ", ".join(
        f"array_to_string(list_slice(string_split({_REPORT_NAMES[c]}, ' | '), 1, {k}), ' | ') AS {c}"
        for c, k in _DIGEST_COLUMNS.items()
    )
    expected_date = r"""
        SELECT message_id, CAST(coalesce(epoch(try_strptime(regexp_replace(value, '^[A-Za-z]{3},\s*', ''),
               '%d %b %Y %H:%M:%S %z')), 0) AS BIGINT) AS sent
        FROM hdr WHERE lower(name) = 'date'"""
    prefixes = "|".join(K.REC_PREFIXES)
    chat_field = "'{{\"title\":\"{}\",\"value\":' || to_json({}) || ',\"short\":{}}}'"
    esc = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    symbol = "CASE {0} WHEN 'high' THEN '\U0001f534' WHEN 'medium' THEN '\U0001f7e1' ELSE '\U0001f7e2' END"

    def first(*columns: tuple[str, str | None]) -> str:
        arms = " ".join(
            f"WHEN {c} <> '' THEN ' - ' || " + (lit(label) if label else f"split_part({c}, ' | ', 1)")
            for c, label in columns
        )
        return f"CASE {arms} ELSE '' END"

    def layer(name: str, finding: str) -> str:
        return (
            f"{symbol.format(name + '_risk')} || ' ' || upper({name}_risk) || ' (' || printf('%.2f', {name}_score)"
            f" || ')' || {finding}"
        )

    fields = " || ',' || ".join(
        chat_field.format(title, value, short)
        for title, value, short in (
            ("Subject", esc.format("subject"), "false"),
            ("From", esc.format("sender"), "true"),
            ("Overall Threat Score", "printf('%.2f', overall)", "true"),
            (
                "\U0001f4e7 Spam Analysis",
                layer("spam", first(("indicators", None), ("suspicious_urls", "Suspicious URLs"))),
                "true",
            ),
            ("\U0001f9e0 NLP Analysis", layer("nlp", first(("social", None), ("authority", None))), "true"),
            (
                "\U0001f4ce Media Analysis",
                layer("media", first(("file_type_warnings", None), ("flagged", "Deepfake Detected"))),
                "true",
            ),
            ("Top Recommendation", "advice[1]", "false"),
        )
    )
    color = "CASE risk WHEN 'high' THEN '#ff0000' WHEN 'medium' THEN '#ff9900' ELSE '#36a64f' END"
    v4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    o1 = f"CAST(regexp_extract(host, '{v4}', 1) AS INT)"
    o2 = f"CAST(regexp_extract(host, '{v4}', 2) AS INT)"
    zip_rows = """
        SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS member_pos,
               count(*) OVER (PARTITION BY doc_id) AS member_count, name, nested
        FROM (SELECT doc_id, text, 1 AS k, 'readme.txt' AS name, NULL AS nested FROM documents
              UNION ALL SELECT doc_id, text, 2, 'inner.zip', 'ok' FROM documents WHERE doc_id % 2 = 0
              UNION ALL SELECT doc_id, text, 3, '../up.txt', NULL FROM documents WHERE doc_id % 3 = 0
              UNION ALL SELECT doc_id, text, 4, 'setup.exe', NULL FROM documents WHERE doc_id % 5 = 0)"""
    return {
        # scans
        "scan_unseen": f"SELECT account_email, folder, message_id FROM mail {unseen}",
        "folder_topn": """
            SELECT account_email, folder, message_id, r AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY account_email, folder ORDER BY seq, message_id) AS r
                  FROM mail) WHERE r <= 5""",
        "size_guard": "SELECT message_id, size FROM mail WHERE size <= 110100480",
        "active_accounts_union": f"SELECT account_email, folder, message_id FROM mail {active}",
        "fetch_cycle": f"""
            SELECT account_email, folder, message_id, size
            FROM (SELECT *, row_number() OVER (PARTITION BY account_email, folder ORDER BY seq, message_id) AS r
                  FROM mail {active} {unseen}) WHERE r <= 50 AND size <= 110100480""",
        # shaping
        "eml_ingest": """
            SELECT message_id, subject, recipient AS sender, 'Team <team@corp.example>' AS recipient,
                   CAST(1704103200 AS BIGINT) AS sent, CAST(length(body_text) AS BIGINT) AS text_chars,
                   md5(body_html) AS html_key, 'a | b' AS received, CAST(1 AS BIGINT) AS n_attachments,
                   'a b.pdf' AS filename, CAST(length(message_id) AS BIGINT) AS size, left(message_id, 12) AS head
            FROM mail WHERE seq % 5 <> 4""",
        "rejects_split": """
            SELECT message_id, account_email, folder, 'ValueError: no message bytes' AS reason
            FROM mail WHERE seq % 5 = 4""",
        "header_multimap": """
            SELECT message_id, string_agg(k || '=' || v, ' | ' ORDER BY k) AS headers
            FROM (SELECT message_id, lower(name) AS k, string_agg(value, ',' ORDER BY pos) AS v FROM hdr GROUP BY 1, 2)
            GROUP BY 1""",
        "subject_cap": "SELECT doc_id, left(text, 1024) AS subject FROM documents",
        "address_format": """
            SELECT c_custkey, CASE WHEN a = '' AND n = '' THEN 'cc@example.com'
                     ELSE (CASE WHEN a = '' THEN n WHEN n = '' THEN a ELSE n || ' <' || a || '>' END)
                       || ', cc@example.com' END AS recipient
            FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS n,
                         CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) || '@example.com' END AS a
                  FROM customer)""",
        "date_fallback": expected_date,
        "mime_part_cap": """
            SELECT message_id, count(*) AS parts, CAST(sum(size) AS BIGINT) AS size FROM parts
            WHERE pos <= 100 GROUP BY 1""",
        "part_classify": "SELECT message_id, CAST(pos AS BIGINT) AS pos, kind FROM part_kinds",
        "body_assemble": """
            SELECT message_id, coalesce(string_agg(text, '' ORDER BY pos) FILTER (kind = 'text'), '') AS body_text,
                   coalesce(string_agg(text, '' ORDER BY pos) FILTER (kind = 'html'), '') AS body_html
            FROM part_kinds GROUP BY 1""",
        "attachment_budget": """
            SELECT message_id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (taken), '') AS admitted
            FROM walk GROUP BY 1""",
        "attachment_truncate": """
            SELECT message_id, CAST(pos AS BIGINT) AS pos, size, least(size, 26214400) AS scanned,
                   size > 26214400 AS truncated FROM att""",
        "filename_sanitize": f"""
            SELECT name, {_safe_name("name")} AS safe_name
            FROM (SELECT name FROM member_names UNION ALL SELECT url FROM pages UNION ALL SELECT text FROM documents
                  UNION ALL SELECT filename FROM att)""",
        "filename_fallback": f"""
            SELECT message_id, CAST(pos AS BIGINT) AS pos,
                   CASE WHEN trim(filename) <> '' THEN filename ELSE '{K.UNNAMED_FILE}_'
                     || left(sha256(message_id || ':' || pos), 8)
                     || CASE content_type WHEN 'text/plain' THEN '.txt' WHEN 'text/html' THEN '.html'
                          WHEN 'application/pdf' THEN '.pdf' ELSE '.bin' END END AS filename
            FROM parts""",
        # layer 1
        "subject_features": """
            SELECT message_id, caps AS all_caps, bangs AS many_exclamations, money FROM subj""",
        "subject_keyword_groups": "SELECT message_id, round(score, 4) AS score, lines AS findings FROM subj_score",
        "body_keyword_count": "SELECT message_id, n AS matches, n * 0.5::DOUBLE AS score FROM kw",
        "url_extract": """
            SELECT m.message_id, coalesce(string_agg(u.url, ' | ' ORDER BY u.place), '') AS urls
            FROM mail m LEFT JOIN url_rows u USING (message_id) GROUP BY 1""",
        "link_count": "SELECT message_id, CAST(links AS BIGINT) AS links, links > 10 AS excessive FROM body",
        "image_heavy": "SELECT message_id, images AS image_heavy FROM body",
        "hidden_text": "SELECT message_id, hidden AS hidden_text FROM body",
        "url_reputation": """
            SELECT m.message_id, coalesce(u.score, 0) AS score, coalesce(u.urls, '') AS urls
            FROM mail m LEFT JOIN bad_urls u USING (message_id)""",
        "spf_check": check.format("spf"),
        "auth_results": check.format("auth"),
        "dkim_presence": check.format("dkim"),
        "missing_headers": check.format("missing"),
        "hop_count": "SELECT message_id, CAST(hops AS BIGINT) AS hops, hop_score AS score FROM hscore",
        "forged_sender": check.format("forged"),
        "freemail_title": "SELECT message_id, titled AS titled_freemail FROM snd",
        "display_name_check": "SELECT message_id, odd AS odd_display_name FROM snd",
        "header_layer": "SELECT message_id, round(score, 4) AS score, lines AS findings FROM header_total",
        "spam_layer": """
            SELECT message_id, round(score, 4) AS score, risk_level, indicators, suspicious_urls, header_issues
            FROM spam_risk""",
        "spam_layer_toggles": f"""
            SELECT message_id, round(plain_score, 4) AS score, {_risk("plain_score", 2, 4)} AS risk_level, indicators,
                   '' AS suspicious_urls, '' AS header_issues FROM spam""",
        # layer 2
        "nlp_pattern_scan": "SELECT message_id, category, description, n FROM by_desc",
        "nlp_counters": "SELECT message_id, bangs AS exclamations, caps AS caps_words FROM cnt",
        **{
            name: f"""
                SELECT m.message_id, round(coalesce(x.score, 0), 4) AS score, coalesce(x.lines, '') AS findings
                FROM mail m LEFT JOIN {cte} x USING (message_id)"""
            for name, cte in (
                ("nlp_social", "se"),
                ("nlp_urgency", "ug"),
                ("nlp_authority", "au"),
                ("nlp_psych", "ps"),
            )
        },
        "nlp_layer": """
            SELECT message_id, round(score, 4) AS score, risk_level, social, urgency, authority, '' AS psychological
            FROM nlp_risk""",
        "nlp_layer_toggles": f"""
            SELECT message_id, round(other_score, 4) AS score, {_risk("other_score", 3, 6)} AS risk_level, social,
                   '' AS urgency, authority, psychological FROM nlp""",
        "model_text": """
            SELECT message_id, md5(t) AS text_key, CAST(length(t) AS BIGINT) AS chars
            FROM (SELECT message_id, subject || ' ' || body_text AS t FROM mail)""",
        "text_hash_dedup": """
            SELECT message_id, sha256(t) AS text_key,
                   round(len(regexp_extract_all(t, '[aeiou]')) / length(t)::DOUBLE, 6) AS probability
            FROM (SELECT message_id, subject || ' ' || body_text AS t FROM mail)""",
        "model_score_map": '''
            SELECT message_id, p AS probability, CASE WHEN p > 0.5 THEN round((p - 0.5::DOUBLE) * 20, 4) ELSE 0 END AS score,
                   CASE WHEN p > 0.5 THEN 'ML Model detected high threat probability: ' || printf('%.2f', p) ELSE ''
                     END AS indicator
            FROM (SELECT message_id, floor(len(regexp_extract_all(t, '[a-s]')) / length(t)::DOUBLE * 100) / 100 AS p
                  FROM (SELECT message_id, subject || ' ' || body_text AS t FROM mail))''',
        # the built-in patterns match no word of the parts, so each word falls to the first user rule that lists it
        "custom_rules": '''
            SELECT r.c AS category, r.d AS description, count(*) AS n
            FROM (SELECT p_partkey AS id, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part) AS w
            JOIN (SELECT word, arg_min({'c': category, 'd': description}, {'rank': rank, 'position': position, 'pattern': pattern}) AS r
                  FROM (SELECT category, description, unnest(string_split(description, ' ')) AS word, pattern, position,
                               CASE category WHEN 'SE' THEN 1 WHEN 'UG' THEN 2 WHEN 'AU' THEN 3 ELSE 4 END AS rank
                        FROM rule_rows
                        WHERE NOT contains(pattern, '+)') AND NOT contains(pattern, '+)*') AND NOT contains(pattern, '+)+')) AS ruled
                  GROUP BY word) AS firsts USING (word)
            GROUP BY 1, 2''',
        # layer 3
        "attachment_extension": """
            SELECT message_id, CAST(pos AS BIGINT) AS pos, ext_score AS score, ext_lines AS findings FROM att2""",
        "magic_type": "SELECT message_id, CAST(pos AS BIGINT) AS pos, kind AS detected_type FROM att1",
        "type_mismatch": """
            SELECT message_id, CAST(pos AS BIGINT) AS pos, kind AS detected_type, type_score AS score,
                   type_line AS finding FROM att3 WHERE kind IS NOT NULL""",
        "missing_signature": """
            SELECT message_id, CAST(pos AS BIGINT) AS pos, type_score AS score, type_line AS finding
            FROM att3 WHERE kind IS NULL""",
        "size_anomaly": """
            SELECT message_id, CAST(pos AS BIGINT) AS pos, size_score AS score, size_line AS finding FROM att2""",
        "attachment_metadata": """
            SELECT message_id, CAST(pos AS BIGINT) AS pos, round(meta, 4) AS score, suspicious_attachments,
                   ext_lines AS file_type_warnings, size_anomalies FROM att3""",
        "media_gated_fold": "SELECT message_id, coalesce(flagged, '') AS flagged FROM media",
        "media_layer": """
            SELECT message_id, round(score, 4) AS score, risk_level, suspicious_attachments, file_type_warnings,
                   size_anomalies FROM media_all""",
        "media_layer_off": """
            SELECT message_id, 0::DOUBLE AS score, 'low' AS risk_level, '' AS suspicious_attachments,
                   '' AS file_type_warnings, '' AS size_anomalies FROM mail""",
        "media_by_mailbox": """
            SELECT k.account_email, k.folder, k.message_id, coalesce(a.warnings, 0) AS warnings,
                   coalesce(a.anomalies, 0) AS anomalies, md5(coalesce(a.lines, '')) AS warnings_key
            FROM (SELECT 'shop' || CAST(1 + o_orderkey % 100 AS STRING) || '@mail.example' AS account_email,
                    CASE o_orderkey % 4 WHEN 0 THEN 'INBOX' WHEN 1 THEN 'Junk' WHEN 2 THEN 'Archive' ELSE 'Sent' END
                      AS folder, CAST(o_orderkey // 100 AS STRING) AS message_id
                  FROM orders) k
            LEFT JOIN (
              SELECT account_email, folder, CAST(n // 100 AS STRING) AS message_id,
                     CAST(sum(CAST(dangerous AS INT) + CAST(suspicious AS INT) + CAST(several AS INT)) AS BIGINT) AS warnings,
                     CAST(sum(CAST(truncated AS INT) + CAST(size_line <> '' AS INT)) AS BIGINT) AS anomalies,
                     string_agg(ext_lines, ' | ' ORDER BY pos) FILTER (ext_lines <> '') AS lines
              FROM (SELECT *, CAST(substr(message_id, 2) AS BIGINT) AS n FROM att3) GROUP BY 1, 2, 3
            ) a USING (account_email, folder, message_id)""",
        "path_traversal": r"""
            SELECT name, regexp_matches(name, '^([/\\]|\pL:)') OR contains(name, '..') AS escapes
            FROM (SELECT name FROM member_names UNION ALL SELECT text FROM documents)""",
        "archive_member_score": """
            SELECT container, CAST(member_pos AS BIGINT) AS member_pos, round(points, 4) AS score, lines AS findings
            FROM mem1
            UNION ALL
            SELECT container, CAST(member_pos AS BIGINT), round(points, 4), lines FROM mem0""",
        "archive_early_stop": "SELECT message_id, round(total, 4) AS score, lines AS findings FROM tot0",
        "archive_members": f"""
            SELECT 'docs@mail.example:INBOX:d' || doc_id || ':1:zip' AS container, CAST(0 AS BIGINT) AS depth, member_pos, member_count, name,
                   CASE name WHEN '../up.txt' THEN 'up.txt' ELSE name END AS safe_name,
                   CASE name WHEN 'readme.txt' THEN strlen(text) WHEN '../up.txt' THEN 1 WHEN 'setup.exe' THEN 2
                     END AS size, nested
            FROM ({zip_rows}) WHERE name <> 'inner.zip'
            UNION ALL
            SELECT 'docs@mail.example:INBOX:d' || doc_id || ':1:zip/2', 1, 1, 2, 'doc' || doc_id || '.txt', 'doc' || doc_id || '.txt', strlen(text),
                   NULL FROM documents WHERE doc_id % 2 = 0
            UNION ALL
            SELECT 'docs@mail.example:INBOX:d' || doc_id || ':1:zip/2', 1, 2, 2, 'form.html', 'form.html', 1, NULL
            FROM documents WHERE doc_id % 2 = 0
            UNION ALL
            SELECT 'docs@mail.example:INBOX:d' || doc_id || ':1:zip', 0, member_pos, member_count, name, name,
                   -- two stored members: local headers, directory entries and the end record around the data
                   strlen(text) + 1 + 2 * (strlen('doc' || doc_id || '.txt') + 9) + 2 * 76 + 22, nested
            FROM ({zip_rows}) WHERE name = 'inner.zip'""",
        "archive_total": """
            SELECT 'd' || doc_id AS message_id,
                   CASE WHEN doc_id % 2 = 0 THEN 5.0::DOUBLE WHEN doc_id % 3 = 0 THEN 5 WHEN doc_id % 5 = 0 THEN 5
                        ELSE 0 END AS score,
                   CASE WHEN doc_id % 2 = 0 THEN 'Archive doc' || doc_id || '.zip contains nested archive: inner.zip'
                               || ' | Archive doc' || doc_id || '.zip/inner.zip contains suspicious file: form.html'
                        WHEN doc_id % 3 = 0 THEN 'Zip file doc' || doc_id || '.zip contains path traversal attempt: up.txt'
                        WHEN doc_id % 5 = 0 THEN 'Archive doc' || doc_id || '.zip contains dangerous file: setup.exe'
                        ELSE '' END AS findings
            FROM documents""",
        # fusion
        "risk_bucket": f"SELECT event_id, {_risk('processing_ms', 5, 10)} AS risk_level FROM obs",
        "threat_report": """
            SELECT message_id, subject, sender, recipient, CAST(epoch(date) AS BIGINT) AS sent,
                   round(overall, 4) AS overall_threat_score, risk AS risk_level, round(spam_score, 4) AS spam_score,
                   spam_risk, round(nlp_score, 4) AS nlp_score, nlp_risk, round(media_score, 4) AS media_score, media_risk,
                   array_to_string(advice, ' | ') AS recommendations FROM rep""",
        "recommendations": """
            SELECT message_id, unnest(range(len(advice))) AS rank, unnest(advice) AS line FROM rep""",
        "alert_route": "SELECT message_id, risk AS risk_level FROM alerted",
        "threat_type": "SELECT message_id, threat_type, severity FROM threats",
        "report_digest": f"SELECT message_id, risk AS risk_level, {digest} FROM rep",
        "clean_budget": """
            SELECT event_id, CAST(floor(least(greatest(processing_ms, 0), 100) / 100 * 40) AS BIGINT) AS meter,
                   round(r, 4) AS ratio,
                   repeat('■', CAST(floor(r * 10) AS INT)) || repeat('·', 10 - CAST(floor(r * 10) AS INT)) AS bar,
                   CASE WHEN r > 0.6::DOUBLE THEN 'YELLOW' ELSE 'GREEN' END AS color
            FROM (SELECT *, least(greatest(processing_ms, 0) / 30, 1) AS r FROM obs)""",
        "recommendation_class": f"""
            SELECT message_id, line, CASE WHEN regexp_matches(upper(line), '{K.REC_RED_PATTERN}') THEN 'RED'
                     WHEN regexp_matches(upper(line), '{K.REC_YELLOW_PATTERN}') THEN 'YELLOW' ELSE 'GREEN' END AS severity,
                   regexp_replace(line, '^({prefixes})+', '') AS bare
            FROM (SELECT message_id, unnest(advice) AS line FROM rep)""",
        "alert_payload_json": """
            SELECT message_id, subject, sender, recipient, CAST(epoch(date) AS BIGINT) AS sent, risk AS risk_level,
                   round(overall, 4) AS overall_threat_score, round(spam_score, 4) AS spam_score,
                   round(nlp_score, 4) AS nlp_score, round(media_score, 4) AS media_score, spam_risk, nlp_risk, media_risk,
                   indicators, header_issues,
                   regexp_replace(suspicious_urls, 'token=s3', 'token=%5BREDACTED%5D', 'g') AS suspicious_urls,
                   social AS social_engineering_indicators, urgency AS urgency_markers,
                   authority AS authority_impersonation, psychological AS psychological_triggers, file_type_warnings,
                   suspicious_attachments, size_anomalies, flagged AS potential_deepfakes,
                   array_to_string(advice, ' | ') AS recommendations
            FROM alerted""",
        "alert_payload_chat": f"""
            SELECT message_id, '{{"text":"New email security threat detected","attachments":[{{"color":"' || {color}
                     || '","title":"\U0001f6a8 Security Alert - ' || upper(risk) || ' Risk","fields":[' || {fields}
                     || '],"footer":"threatloom"}}]}}' AS payload
            FROM alerted""",
        # metrics
        "threat_counters": "SELECT counter, n FROM counters",
        "error_counters": "SELECT error_type, count(*) AS n FROM obs WHERE error_type IS NOT NULL GROUP BY 1",
        "bounded_sample": "SELECT event_type, event_id, processing_ms FROM sampled",
        "latency_percentiles": f"SELECT event_type, {stats} FROM obs GROUP BY 1",
        "metrics_summary": f"""
            SELECT (SELECT count(*) FROM obs) AS emails_processed,
                   (SELECT string_agg(counter || '=' || n, ' | ' ORDER BY counter) FROM counters) AS threats_detected,
                   (SELECT count(*) FROM counters) AS threat_types,
                   (SELECT string_agg(error_type || '=' || n, ' | ' ORDER BY error_type)
                    FROM (SELECT error_type, count(*) AS n FROM obs WHERE error_type IS NOT NULL GROUP BY 1)) AS errors,
                   s.* FROM (SELECT {stats} FROM obs) s""",
        "stream_summary": f"""
            SELECT (SELECT count(*) FROM obs) AS emails_processed,
                   (SELECT string_agg(counter || '=' || n, ' | ' ORDER BY counter) FROM counters) AS threats_detected,
                   (SELECT count(*) FROM counters) AS threat_types,
                   (SELECT string_agg(error_type || '=' || n, ' | ' ORDER BY error_type)
                    FROM (SELECT error_type, count(*) AS n FROM obs WHERE error_type IS NOT NULL GROUP BY 1)) AS errors,
                   s.* FROM (SELECT {stats} FROM obs) s""",
        # functions
        "sanitize_log": """
            SELECT conv_id, turn, log_text AS line,
                   CASE WHEN length(log_text) > 255 THEN left(log_text, 255) || '...' ELSE log_text END AS short
            FROM clean_text""",
        "sanitize_text": "SELECT conv_id, turn, display AS clean, display_cell AS guarded FROM guarded",
        "csv_guard": "SELECT conv_id, turn, cell FROM guarded",
        "redact_email": """
            SELECT c_custkey, shown
            FROM (SELECT c_custkey, CASE WHEN NOT contains(address, '@') THEN address ELSE
                         CASE strpos(address, '@') WHEN 1 THEN '***' WHEN 2 THEN '*'
                           ELSE left(address, 1) || repeat('*', CAST(strpos(address, '@') - 2 AS INT)) END
                         || substr(address, strpos(address, '@')) END AS shown FROM addresses)""",
        "chat_escape": f"SELECT conv_id, turn, {esc.format('display')} AS escaped FROM clean_text",
        "redact_url_params": """
            SELECT page_id, CASE page_id % 13
              WHEN 0 THEN CASE WHEN contains(url, '#') OR NOT contains(url, '?') THEN url
                ELSE regexp_replace(regexp_replace(url, '&token=abc', '&token=%5BREDACTED%5D'), '&Token=x%20y',
                                    '&Token=%5BREDACTED%5D') END
              WHEN 2 THEN 'https://user:s3cr%40t@shop.example/p?x=1&sig=%5BREDACTED%5D#frag'
              WHEN 8 THEN 'https://api.example/v1?a=1&a=2&b=~%2A&API_KEY=%5BREDACTED%5D&c='
              ELSE url END AS shown
            FROM url_list""",
        "redact_url_secrets": """
            SELECT page_id, CASE page_id % 13
              WHEN 0 THEN CASE WHEN contains(url, '#') OR NOT contains(url, '?') THEN url
                ELSE regexp_replace(regexp_replace(url, '&token=abc', '&token=%5BREDACTED%5D'), '&Token=x%20y',
                                    '&Token=%5BREDACTED%5D') END
              WHEN 2 THEN 'https://user:[REDACTED]@shop.example/p?x=1&sig=%5BREDACTED%5D#frag'
              WHEN 3 THEN 'https://hooks.slack.com/services/T000/B000/[REDACTED]'
              WHEN 4 THEN regexp_replace(url, '[^/]*$', '[REDACTED]')
              WHEN 5 THEN regexp_replace(regexp_replace(url, '^HTTPS', 'https'), '[?]$', '')
              WHEN 8 THEN 'https://api.example/v1?a=1&a=2&b=~%2A&API_KEY=%5BREDACTED%5D&c='
              ELSE url END AS shown
            FROM url_list""",
        "url_for_display": """
            SELECT page_id, replace(shown, '%5BREDACTED%5D', '[REDACTED]') AS shown FROM (SELECT page_id, CASE page_id % 13
              WHEN 0 THEN CASE WHEN contains(url, '#') OR NOT contains(url, '?') THEN url
                ELSE regexp_replace(regexp_replace(url, '&token=abc', '&token=%5BREDACTED%5D'), '&Token=x%20y',
                                    '&Token=%5BREDACTED%5D') END
              WHEN 2 THEN 'https://user:[REDACTED]@shop.example/p?x=1&sig=%5BREDACTED%5D#frag'
              WHEN 3 THEN 'https://hooks.slack.com/services/T000/B000/[REDACTED]'
              WHEN 4 THEN regexp_replace(url, '[^/]*$', '[REDACTED]')
              WHEN 5 THEN regexp_replace(regexp_replace(url, '^HTTPS', 'https'), '[?]$', '')
              WHEN 8 THEN 'https://api.example/v1?a=1&a=2&b=~%2A&API_KEY=%5BREDACTED%5D&c='
              ELSE url END AS shown
            FROM url_list)""",
        "redact_urls_in_text": """
            SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 = 4 THEN
                replace(replace(replace(text, 'https://api.example/v1?token=abc', 'https://api.example/v1?token=%5BREDACTED%5D'),
                  'www.x.example/y?key=1', 'www.x.example/y?key=%5BREDACTED%5D'),
                  'https://u:p@h.example/z', 'https://u:[REDACTED]@h.example/z')
              ELSE text END AS shown FROM texts""",
        "email_valid": r"""
            SELECT c_custkey, length(address) <= 254 AND NOT contains(address, '..')
                     AND regexp_matches(address, '^[a-zA-Z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-zA-Z]{2,}$')
                     AND NOT regexp_matches(split_part(address, '@', 1), '^[.-]|[.-]$')
                     AND NOT regexp_matches('.' || split_part(address, '@', 2) || '.', '[.]-|-[.]|[.][.]') AS valid
            FROM addresses""",
        "url_host_audit": f"""
            SELECT page_id, CASE WHEN scheme <> 'https' THEN 'scheme must be https, got: ' || scheme
                     WHEN host = '' THEN 'URL must contain a valid hostname'
                     WHEN host = '::1' THEN 'address is loopback'
                     WHEN host = 'fe80::1' THEN 'address is private IP'
                     WHEN regexp_matches(host, '{v4}') THEN
                       CASE WHEN {o1} > 255 OR {o2} > 255 THEN 'address is invalid IP'
                            WHEN {o1} = 127 THEN 'address is loopback'
                            WHEN {o1} IN (0, 10) OR {o1} >= 240 OR ({o1} = 192 AND {o2} = 168) THEN 'address is private IP'
                            WHEN {o1} >= 224 THEN 'address is multicast' ELSE '' END
                     ELSE '' END AS verdict
            FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme,
                         CASE WHEN contains(url, '[') THEN regexp_extract(url, '[[](.*)[]]', 1)
                              ELSE lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]*)', 1)) END AS host
                  FROM url_list)""",
        "truncate_text": """
            SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS short,
                   CASE WHEN length(text) > 2 THEN '..' ELSE text END AS dots FROM documents""",
        "rule_audit": f"""
            SELECT position, pattern, unsafe_form, unsafe_form IS NULL AS accepted
            FROM (SELECT *, CASE {" ".join(f"WHEN contains(pattern, {lit(f)}) THEN {lit(f)}" for f in K.BACKTRACKING_FORMS)}
                              END AS unsafe_form FROM rule_rows)""",
        # logs
        "log_parse": """
            SELECT event_id, CAST(epoch(strptime(stamp, '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS logged, level, message, module, line,
                   email_id, CAST(CASE WHEN corrupt THEN 0 ELSE 2 END AS BIGINT) AS n_extras, corrupt FROM log_rows""",
        "redact_fields": """
            SELECT event_id, CASE WHEN NOT corrupt THEN '[REDACTED]' END AS user_token, email_id FROM log_rows""",
        "log_by_level": "SELECT event_id, message FROM log_rows WHERE level = 'ERROR'",
        "log_by_module": "SELECT event_id, level, message FROM log_rows WHERE module = 'main'",
        "log_contains": "SELECT event_id, message FROM log_rows WHERE contains(message, 'Analysis complete')",
        "dead_letters": r"""
            SELECT 'log' AS kind, CAST(event_id AS VARCHAR) AS key, 'not JSON' AS reason FROM log_rows WHERE corrupt
            UNION ALL
            SELECT 'date', message_id, 'date does not parse' FROM hdr
            WHERE lower(name) = 'date'
              AND try_strptime(regexp_replace(value, '^[A-Za-z]{3},\s*', ''), '%d %b %Y %H:%M:%S %z') IS NULL
            UNION ALL
            SELECT 'account', account_email, 'not connected' FROM accounts WHERE enabled AND NOT connected""",
        "dead_letters_replayed": """
            SELECT CAST(event_id AS VARCHAR) AS key, 'no level' AS reason FROM log_rows WHERE corrupt""",
        "log_level_counts": "SELECT level, count(*) AS n FROM log_rows WHERE NOT corrupt GROUP BY 1",
        "log_write": """
            SELECT event_id, replace(replace(replace(CAST(js AS VARCHAR), '": ', '":'), ', "', ',"'),
                                     '"User_Token":"' || user_token || '"', '"User_Token":"[REDACTED]"') AS line
            FROM log_rows WHERE NOT corrupt""",
        "log_recent": """
            SELECT event_id, level, message FROM (
              SELECT *, date_trunc('hour', strptime(stamp, '%Y-%m-%d %H:%M:%S')) AS h FROM log_rows WHERE NOT corrupt)
            WHERE h = (SELECT date_trunc('hour', max(strptime(stamp, '%Y-%m-%d %H:%M:%S'))) FROM log_rows)
                      - INTERVAL 1 HOUR""",
        "log_store_recent": """
            SELECT event_id, level, message FROM (
              SELECT *, date_trunc('hour', strptime(stamp, '%Y-%m-%d %H:%M:%S')) AS h FROM log_rows WHERE NOT corrupt)
            WHERE h = (SELECT date_trunc('hour', max(strptime(stamp, '%Y-%m-%d %H:%M:%S'))) FROM log_rows)
                      - INTERVAL 1 HOUR""",
        "log_store_contains": "SELECT event_id, message FROM log_rows WHERE contains(message, 'Analysis complete')",
        "log_store_module": "SELECT event_id, level, message FROM log_rows WHERE module = 'main'",
        # streaming
        "stream_metrics": """
            SELECT threat_type, severity, count(*) AS n FROM obs WHERE threat_type IS NOT NULL GROUP BY 1, 2""",
        "stream_dedup": """
            SELECT event_type AS folder, count(*) AS deliveries, count(*) AS messages FROM events GROUP BY 1""",
    }


def _stream_book(attachments: bool = True) -> _Book:
    """Documents as messages without headers; line items of the same number as attachments, or none."""
    mail = """
        SELECT 'd' || CAST(doc_id AS STRING) AS message_id, doc_id AS seq, split_part(text, chr(10), 1) AS subject,
               source || '@mail.example' AS sender, 'team@corp.example' AS recipient,
               make_timestamp((1704067200 + doc_id) * 1000000) AS date, text AS body_text, '' AS body_html,
               source || '@mail.example' AS account_email, 'INBOX' AS folder
        FROM documents"""
    nothing = "SELECT '' AS message_id, 0 AS pos, '' AS name, '' AS value WHERE false"
    att = _base_ctes()["att"].replace("'o' || CAST(l_orderkey", "'d' || CAST(l_orderkey")
    # archives of order messages, found in the document's message of that number
    found = "SELECT 'd' || substr(message_id, 2) AS message_id, 1 AS pos, total AS arch_score, lines AS arch_lines FROM tot0"
    if not attachments:
        att, found = f"SELECT * FROM ({att}) AS a WHERE false", f"SELECT * FROM ({found}) AS f WHERE false"
    return _Book({"mail": mail, "hdr": nothing, "att": att, "arch_found": found})


def oracles() -> dict[str, str]:
    """SQL text per registered query that has one."""
    book = _Book()
    out = {name: book.sql(sql) for name, sql in _queries().items()}
    budget = _Book({"walk": _walk("att", 4, 60 * K.MIB, scored=False)})
    out["attachment_budget"] = budget.sql(_queries()["attachment_budget"])
    stream = _stream_book()
    out["stream_monitor"] = stream.sql(
        "SELECT message_id, round(overall, 4) AS overall_threat_score, risk AS risk_level FROM rep"
    )
    out["stream_alerts"] = stream.sql("SELECT message_id, risk AS risk_level FROM alerted")
    key = "m.account_email, m.folder, m.message_id"
    out["stream_processed"] = stream.sql(f"SELECT {key} FROM mail m")
    largest = DEFAULTS.max_message_bytes
    out["stream_fetch"] = f"""
        SELECT 'd' || doc_id AS message_id,
               CASE WHEN source = 'src3' THEN 'waiting' WHEN n_chars * 20000 <= {largest} THEN 'reported' ELSE 'too large' END AS state,
               CASE WHEN source <> 'src3' THEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 40 END AS cycle
        FROM documents"""
    out["stream_retry"] = """
        SELECT 'd' || doc_id AS message_id, CASE WHEN doc_id = 5 THEN 'dead' ELSE 'reported' END AS state,
               CASE WHEN doc_id = 5 THEN 3 ELSE 0 END AS failures FROM documents"""
    plain = _stream_book(attachments=False)
    out["stream_outbox"] = plain.sql("""
        SELECT message_id, CASE WHEN n % 7 = 0 THEN 'refused' ELSE 'sent' END AS state,
               CASE WHEN n % 7 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS attempts
        FROM (SELECT message_id, CAST(substr(message_id, 2) AS BIGINT) AS n FROM alerted)""")
    out["stream_alert_channel"] = stream.sql(f"SELECT {key} FROM mail m JOIN alerted USING (message_id)")
    return out
