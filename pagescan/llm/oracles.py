"""Comparison SQL for another engine, for the queries of this subpackage."""

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT row_number() OVER () AS bid, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM (SELECT DISTINCT item_id, text FROM benchmark)),
     bs AS (SELECT DISTINCT bid, item_id, array_to_string(w[i:i + m - 1], ' ') AS s
            FROM (SELECT *, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     bn AS (SELECT bid, count(*) AS n FROM bs GROUP BY bid),
     ds AS (SELECT DISTINCT rid, array_to_string(w[i:i + m - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT least(5, len(w)) AS m FROM b)
            WHERE i + m - 1 <= len(w)),
     hit AS (SELECT rid, bid, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL),
     found AS (SELECT rid, list(item_id ORDER BY item_id) AS item_ids,
                      list(k / n ORDER BY item_id, k / n) AS containments
               FROM hit JOIN bn USING (bid) WHERE k >= 0.8 * n - 1e-9 GROUP BY rid)
SELECT doc_id, coalesce(item_ids, []) AS item_ids, coalesce(containments, []) AS containments
FROM d LEFT JOIN found USING (rid)
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, {_words("t")} AS ws,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
     win AS (SELECT rid, i, array_to_string(ws[i:i + 2], ' ') AS k
             FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
     rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
     covered AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY rid),
     norm AS (SELECT DISTINCT rid, host, t, lower(trim(regexp_replace(l, '{_SPACE}', ' ', 'g'))) AS line
              FROM (SELECT rid, host, t, unnest(ls) AS l FROM w)),
     line AS (SELECT DISTINCT host, t, line, len({_words("line")}) AS n FROM norm),
     freq AS (SELECT host, line FROM line GROUP BY host, line HAVING count(*) > 10),
     judged AS (SELECT host, t, sum(n) AS all_n, coalesce(sum(n) FILTER (f.line IS NOT NULL), 0) AS removed
                FROM line LEFT JOIN freq f USING (host, line) GROUP BY host, t),
     base AS (SELECT rid, doc_id, host, t, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                     len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM w LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(all_n, 0) - coalesce(removed, 0) >= 0.5 * coalesce(all_n, 0) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
FROM base LEFT JOIN judged USING (host, t)
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
           FROM documents),
     s AS (SELECT source, sum(size) AS source_size,
                  [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
           FROM d GROUP BY source),
     c AS (SELECT *, coalesce(sum(3.0 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                  sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
                  sum(source_size) OVER () AS total
           FROM s WINDOW f AS (ORDER BY CAST(3.0 * source_size AS DOUBLE) / w, source NULLS LAST)),
     t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
                  least(CAST(3.0 * source_size AS DOUBLE), max(CAST(total - caps AS DOUBLE) / open) OVER () * w) AS target FROM c),
     p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
     n AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS need FROM p),
     r AS (SELECT d.*, n.source_size, n.target, n.whole, n.need,
                  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h
                                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before,
                  sum(size) OVER (PARTITION BY d.source, h) AS grp, row_number() OVER (PARTITION BY d.source, h) - 1 AS nth
           FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN before >= need THEN 0 WHEN before + grp < need THEN size
                                ELSE greatest(0, least(size, need - before - nth * size)) END AS BIGINT) AS taken
FROM r
"""

OP1 = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
       ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
     u AS (SELECT row_number() OVER () AS rid, page_id,
                  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
     fit AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
             FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (rid)
"""


def _op3() -> str:
    """Offsets come from the pieces between matches; plain forms of the patterns."""
    from pagescan.llm.pii import _ACCOUNT_CHARS, CONTEXT_BONUS, CONTEXT_CHARS, CONTEXT_WORDS, KINDS, SCORES, WANTED
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "local_phone": r"\(?\b[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}\b",
        "private_key": r"-----BEGIN(?:\x20[A-Z]{1,20}){0,3}\x20PRIVATE\x20KEY-----(?:[^-]+-----END[A-Z\x20]{1,60}-----)?",
        "access_key": r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsru]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{9,99}[A-Za-z0-9])\b",
        "secret": r"[A-Za-z0-9_-]{20,}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN d[length({digits}) - i] "
            f"ELSE (2 * d[length({digits}) - i]) // 10 + (2 * d[length({digits}) - i]) % 10 END)) % 10 = 0")
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right(p, 3) AS INT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "local_phone": "true", "private_key": "true", "access_key": "true",
        "secret": "length(m) <= 200 AND length(regexp_replace(m, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 2 "
                  "AND len(list_distinct(string_split(m, ''))) >= 8",
    }
    mod97 = ("list_reduce(list_prepend(0, list_transform(string_split({0}[5:] || {0}[:4], ''), "
             "lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
             "lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1")
    head = "(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}"
    ways = []
    for rank, kind in enumerate(KINDS):
        if kind == "iban":
            ways.append("SELECT * FROM accounts")
            continue
        heard = r"(?i)\b(?:" + "|".join(CONTEXT_WORDS[kind]) + r")\b"
        ways.append(f"""
  SELECT rid, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT rid, m, d, CAST(start AS BIGINT) AS start, {SCORES[kind]} + CASE WHEN regexp_matches(right(gap, {CONTEXT_CHARS}) || ' ' || left(next, {CONTEXT_CHARS}),
             '{heard}') THEN {CONTEXT_BONUS} ELSE 0 END AS score
    FROM (SELECT rid, ms[i] AS m, list_transform(string_split(regexp_replace(ms[i], '[^0-9]', '', 'g'), ''), lambda c: TRY_CAST(c AS INT)) AS d,
                 gs[i] AS gap, gs[i + 1] AS next,
                 coalesce(sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gs[i]) AS start
          FROM (SELECT rid, ms, gs, unnest(range(1, len(ms) + 1)) AS i
                FROM (SELECT rid, regexp_extract_all(t, '{patterns[kind]}') AS ms,
                             regexp_split_to_array(t, '{patterns[kind]}') AS gs FROM d))))
  WHERE {valid[kind]} AND score >= {WANTED}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
     heads AS (SELECT rid, t, CAST(coalesce(sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + length(gs[i]) + length(ms[i]) - 4 AS BIGINT) AS start
               FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
                 SELECT rid, t, regexp_extract_all(t, '{head}') AS ms, regexp_split_to_array(t, '{head}') AS gs FROM d))),
     runs AS (SELECT *, length(regexp_extract(ahead, '^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}')) AS run
              FROM (SELECT rid, start, substr(t, start + 1, {_ACCOUNT_CHARS}) AS ahead FROM heads)),
     ends AS (SELECT rid, start, max(p) AS chars FROM (SELECT *, unnest(range(15, greatest(run, 15) + 1)) AS p, replace(left(ahead, p), ' ', '') AS plain
                FROM runs WHERE run > 0) WHERE substr(ahead, p, 1) <> ' ' AND NOT regexp_matches(substr(ahead, p + 1, 1), '[A-Za-z0-9]')
                AND length(plain) BETWEEN 15 AND 34 AND {mod97.format('plain')} GROUP BY ALL),
     accounts AS (SELECT rid, 4 AS rank, 'iban' AS kind, u.start, u.stop FROM (SELECT rid, unnest(list_reduce(
                    list([{{'start': start, 'stop': start + chars}}] ORDER BY start),
                    lambda a, x: CASE WHEN x[1].start < a[-1].stop THEN a ELSE list_concat(a, x) END)) AS u FROM ends GROUP BY rid)),
     s AS ({" UNION ALL ".join(ways)}),
     base AS (SELECT * FROM s WHERE rank < 4),
     iban AS (SELECT * FROM s WHERE rank = 4 AND NOT EXISTS (FROM base b WHERE b.rid = s.rid AND b.rank <> 2
                AND s.start < b.stop AND b.start < s.stop)),
     firm AS (SELECT * FROM base UNION ALL SELECT * FROM iban),
     keys AS (SELECT * FROM s WHERE rank IN (6, 7) AND NOT EXISTS (FROM firm b WHERE b.rid = s.rid AND b.rank <> 2
                AND s.start < b.stop AND b.start < s.stop)),
     known AS (SELECT * FROM firm UNION ALL SELECT * FROM keys),
     secrets AS (SELECT * FROM s WHERE rank = 8 AND NOT EXISTS (FROM known b WHERE b.rid = s.rid AND b.rank <> 2
                AND s.start < b.stop AND b.start < s.stop)),
     sure AS (SELECT * FROM known UNION ALL SELECT * FROM secrets),
     every AS (SELECT * FROM sure UNION ALL SELECT * FROM s WHERE rank = 5 AND NOT EXISTS (FROM sure f
                WHERE f.rid = s.rid AND s.start < f.stop AND f.start < s.stop)),
     g AS (SELECT rid, count(*) FILTER (rank = 0) AS e, count(*) FILTER (rank = 1) AS i, count(*) FILTER (rank = 2) AS c,
                  count(*) FILTER (rank = 3) AS p,
                  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS b,
                  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS a FROM every GROUP BY rid)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
     raw AS (SELECT rid, doc_id, t, no, ls[no] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS no
               FROM (SELECT *, string_split(t, chr(10)) AS ls FROM d))),
     l AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, t, no) AS ord FROM (
             SELECT *, {_words("lower(line)")} AS w FROM raw) WHERE len(w) > 0),
     u AS (SELECT array_to_string(w, ' ') AS norm, any_value(w) AS w, min(ord) AS first FROM l GROUP BY 1),
     v AS (SELECT norm, first, len(w) AS n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS rest
           FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= 5)),
     x AS (SELECT norm FROM (SELECT norm, first, min(first) OVER (PARTITION BY n, i, rest) AS early FROM v) WHERE early < first),
     y AS (SELECT CASE WHEN v.first > u.first THEN v.norm ELSE u.norm END AS norm
           FROM v JOIN u ON u.norm = v.rest WHERE len(u.w) >= 5),
     near AS (SELECT norm FROM x UNION SELECT norm FROM y),
     flag AS (SELECT rid, no, ord <> first AS exact, near.norm IS NOT NULL AS near
              FROM l JOIN u ON u.norm = array_to_string(l.w, ' ') LEFT JOIN near ON near.norm = u.norm)
SELECT any_value(raw.doc_id) AS doc_id, count(flag.no) AS n_lines, count(*) FILTER (exact) AS n_exact,
       count(*) FILTER (near AND NOT exact) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY raw.no) FILTER (NOT coalesce(exact OR near, false)), '')) AS text_sha256
FROM raw LEFT JOIN flag USING (rid, no) GROUP BY rid
"""

#: The breaks and entities are fixed values of html_text, here for the other engine's patterns.
_BREAKS = ("p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|title|section|article|header|footer|nav|aside|main|"
           "blockquote|pre|hr|dl|dt|dd|form|option")


def _op6() -> str:
    text = r"regexp_replace(html, '<!--.*?(?:-->|\z)', '', 'gs')"
    code = "|".join(rf"<{name}\b[^>]*(?:>.*?(?:</{name}\s*>|\z)|\z)" for name in ("script", "style"))
    text = f"regexp_replace({text}, '{code}', '', 'gsi')"
    text = rf"regexp_replace({text}, '</?(?:{_BREAKS})\b[^>]*(?:>|\z)', chr(10), 'gi')"
    text = rf"regexp_replace({text}, '<[/!?A-Za-z][^>]*(?:>|\z)', '', 'g')"
    from html.entities import html5

    from pagescan.llm.warc import OLD_NUMBERS, REFERENCE
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted('&' + n)}: {quoted(t)}" for n, t in html5.items() if n.endswith(";")) + "}"
    old = "MAP {" + ", ".join(f"{n}: {quoted(c)}" for n, c in OLD_NUMBERS.items()) + "}"
    plain, text = text, "coalesce(joined, raw)"
    text = rf"regexp_replace({text}, '[ \t\r\f\x0B]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    crlf = "chr(13) || chr(10)"

    def urn(*parts):
        h = "sha256(" + " || ' ' || ".join(parts) + ")"
        return f"('<urn:uuid:' || regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}}).*$', '\\1-\\2-\\3-\\4-\\5') || '>')"

    def size(x):
        return f"octet_length(encode({x}))"
    return f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html FROM pages),
     q AS (SELECT *, {plain} AS raw FROM p),
     refs AS (SELECT DISTINCT unnest(regexp_extract_all(raw, '{REFERENCE}')) AS e FROM q),
     numbers AS (SELECT e, CASE WHEN e LIKE '&#x%' OR e LIKE '&#X%' THEN CAST('0x' || e[4:-2] AS BIGINT) WHEN e LIKE '&#%' THEN CAST(e[3:-2] AS BIGINT) END AS n FROM refs),
     meant AS (SELECT e, CASE WHEN n IS NULL THEN coalesce({names}[e], e) WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
                 ELSE coalesce({old}[CAST(n AS INT)], chr(CAST(n AS INT))) END AS t FROM numbers),
     pieces AS (SELECT rid, regexp_split_to_array(raw, '{REFERENCE}') AS gs, regexp_extract_all(raw, '{REFERENCE}') AS es FROM q),
     told AS (SELECT q.*, x.joined FROM q LEFT JOIN (
                SELECT rid, string_agg(g || coalesce(t, ''), '' ORDER BY i) AS joined
                FROM (SELECT rid, i, gs[i] AS g, es[i] AS e FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS i FROM pieces)) LEFT JOIN meant USING (e)
                GROUP BY rid) x USING (rid)),
     r AS (SELECT *, {urn("'response'", "CAST(page_id AS VARCHAR)", "uri")} AS id, 'sha256:' || sha256(html) AS digest,
                  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=UTF-8' || {crlf} || 'Content-Length: '
                  || {size("html")} AS http, {text} AS text FROM told),
     b AS (SELECT *, 'sha256:' || sha256(http || {crlf} || {crlf} || html) AS block_of,
                  {urn("'metadata'", "id")} AS metadata_id, {urn("'conversion'", "id")} AS conversion_id FROM r),
     e AS (SELECT page_id, id, uri, digest, 'metadata' AS record_type, metadata_id AS record_id, conversion_id AS concurrent_to,
                  'application/warc-fields' AS content_type,
                  'source-status: HTTP/1.1 200 OK' || {crlf} || 'source-payload-digest: ' || digest || {crlf} || 'source-block-digest: '
                  || block_of || {crlf} || 'source-header: Content-Type: text/html; charset=UTF-8' || {crlf}
                  || 'source-header: Content-Length: ' || {size("html")} || {crlf} AS block FROM b
           UNION ALL SELECT page_id, id, uri, digest, 'conversion', conversion_id, NULL, 'text/plain; charset=UTF-8', text FROM b)
SELECT page_id, record_type, record_id, id AS refers_to, concurrent_to, nullif(uri, '') AS target_uri, content_type,
       CAST({size("block")} AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, digest AS source_digest,
       sha256('WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
         || 'WARC-Refers-To: ' || id || {crlf} || CASE WHEN concurrent_to IS NULL THEN '' ELSE 'WARC-Concurrent-To: ' || concurrent_to || {crlf} END
         || 'WARC-Date: 2024-01-01T00:00:00Z' || {crlf} || CASE WHEN uri = '' THEN '' ELSE 'WARC-Target-URI: ' || uri || {crlf} END
         || 'WARC-Block-Digest: sha256:' || sha256(block) || {crlf} || 'Content-Type: ' || content_type || {crlf}
         || 'Content-Length: ' || {size("block")} || {crlf} || {crlf} || block || {crlf} || {crlf}) AS record_sha256 FROM e
"""


OP12 = r"""
WITH p AS (SELECT lang, row_number() OVER () AS pid, piece FROM (
             SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
     g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
           FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4)) v(k)
           WHERE i + k - 1 <= len(ws)),
     c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
     words AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
     cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1),
     cut AS (SELECT s.lang, s.phrase, s.a, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * s.a) // (x.f + y.f) AS score,
                    row_number() OVER (PARTITION BY s.lang, s.phrase
                                       ORDER BY (CAST(2000000 AS HUGEINT) * s.a) // (x.f + y.f), s.j) AS nth
             FROM (SELECT *, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest
                   FROM cand, (VALUES (1), (2), (3)) v(j) WHERE j < k) s
             JOIN c x ON x.lang = s.lang AND x.phrase = s.first JOIN c y ON y.lang = s.lang AND y.phrase = s.rest),
     sub AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most
             FROM cand, (VALUES (1), (2), (3)) u(i), (VALUES (2), (3)) v(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
     best AS (SELECT lang, phrase, a, l, r, CAST(score AS BIGINT) AS score,
                     row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
              FROM cut LEFT JOIN sub USING (lang, phrase)
              WHERE nth = 1 AND (most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN words USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op1_url_filters": OP1, "op3_pii": _op3(), "op4_decontamination": OP4, "op7_quality": OP7, "op8_mixing": OP8, "op9_line_dedup": OP9, "op6_warc": _op6(), "op12_collocations": OP12}
