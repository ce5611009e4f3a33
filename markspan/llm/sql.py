"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from markspan.llm.pii import AFTER, BASE, BEFORE, CONTEXT_GAIN, KINDS, OCTET, THRESHOLD

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

EXACT_GROUPS = f"""
WITH n AS (SELECT doc_id, sha256({NORMAL}) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""

# The plain patterns of the base kinds, and how a match is confirmed.
_D = r"regexp_replace(h, '[^0-9]', '', 'g')"
_DOUBLED = "CASE WHEN k % 2 = 0 THEN (2 * CAST(reverse(d)[k] AS BIGINT)) // 10 + (2 * CAST(reverse(d)[k] AS BIGINT)) % 10 ELSE CAST(reverse(d)[k] AS BIGINT) END"
_LUHN = f"list_transform([{_D}], lambda d: length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: {_DOUBLED})) % 10 = 0)[1]"
_MOD97 = (
    "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(p, 5) || substr(p, 1, 4), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
)
_IBAN = f"list_transform([regexp_replace(h, '[^0-9A-Z]', '', 'g')], lambda p: {_MOD97})[1]"
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_matches(h, '^{OCTET}(?:\.{OCTET}){{3}}$')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _IBAN),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(h, '^(?:000|666|9)|-00-|-0000$')"),
}


def _found() -> str:
    parts = []
    for place, kind in enumerate(KINDS, 1):
        pattern, confirm = _PLAIN[kind.name]
        near = f"lower(coalesce(right(g[i], {BEFORE}), '') || ' ' || coalesce(left(g[i + 1], {AFTER}), ''))"
        score = f"{kind.score} + CASE WHEN regexp_matches({near}, '{kind.context}') THEN {CONTEXT_GAIN} ELSE 0 END"
        kept = f"({confirm})" if kind.base else f"({confirm}) AND {score} >= {THRESHOLD}"
        parts.append(
            f"""SELECT doc_id, '{kind.name}' AS kind, {place} AS place, s AS a, s + length(h) AS b FROM (
  SELECT doc_id, x[i] AS h, g, i, CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(x[1:i-1], lambda v: length(v))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS x, string_split_regex(t, '{pattern}') AS g FROM docs) AS cut, unnest(range(1, len(x) + 1)) AS u(i)
) AS placed WHERE {kept}"""
        )
    return " UNION ALL ".join(parts)


def _joined(where: str = "") -> str:
    return f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) {where}, '')"


PII = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({_found()})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in BASE)},
       sha256({_joined(f"FILTER (place <= {len(BASE)})")}) AS base_sha256, {_joined("FILTER (kind IS NOT NULL)")} AS spans
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""

TOP_SCORES = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWERED}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SHINGLES = (
    "CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] "
    "ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END"
)

NEAR_DUPLICATES = f"""
WITH RECURSIVE sets AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
kinds AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, CAST(len(any_value(s)) AS BIGINT) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
each AS (SELECT rep, n, unnest(s) AS g FROM kinds),
shared AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM kinds UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN kinds k ON k.s = list_sort(d.s) LEFT JOIN roots r ON r.rep = k.rep
"""

_PAYLOAD = "encode(coalesce(html, ''))"
_HEX = "0123456789ABCDEF"
# Base32 of 20 bytes: each of 32 digits is five bits of the digest's 160.
_BITS = (
    f"array_to_string(list_transform(range(1, 41), lambda k: lpad(bin(CAST(instr('{_HEX}', upper(sha1({_PAYLOAD})[k])) - 1 AS INTEGER)), 4, '0')), '')"
)
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(bits[k * 5 + j] AS INTEGER) * CAST(2 ** (5 - j) AS INTEGER))) AS INTEGER) + 1]), '')"

WARC = f"""
WITH p AS (SELECT page_id, CAST(octet_length({_PAYLOAD}) AS BIGINT) AS payload_bytes, {_BITS} AS bits FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM g
"""

_PIECES = rf"string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')"

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM runs, unnest([1, 2, 3, 4, 5]) AS u(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
multi AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM multi, unnest([2, 3, 4]) AS u(m), unnest([1, 2, 3, 4]) AS v(i) WHERE m < k AND i + m - 1 <= k),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT s.* FROM multi s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase WHERE coalesce(o.most, 0) < s.a),
cuts AS (
  SELECT p.lang, p.phrase, p.a, t.n, j, l.c AS l, r.c AS r, CAST(1000 AS HUGEINT) * p.a * t.n // (CAST(l.c AS HUGEINT) * r.c) AS score
  FROM kept p, unnest([1, 2, 3, 4]) AS u(j), total t, f l, f r
  WHERE j < p.k AND t.lang = p.lang AND l.lang = p.lang AND l.phrase = array_to_string(p.w[1:j], ' ') AND r.lang = p.lang AND r.phrase = array_to_string(p.w[j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

# crc32 of a short text, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({s}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT))"
)
_DAMAGE = _CRC.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + " % 20"
_AFTER = "CASE {s} WHEN 2 THEN 3 ELSE 2 END"  # the state after one more turn of the role that is due
_ROLE = "CASE {s} WHEN 3 THEN 'assistant' ELSE 'user' END"

DIALOGUE = rf"""
WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_DAMAGE} AS kind FROM conversations),
damaged AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before_, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before_ IS NOT NULL AND before_ || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv),
convs AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM kinds),
ways AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'made': CAST(NULL AS VARCHAR)}} AS best FROM convs
  UNION ALL
  SELECT conv, i, target, min({{'cost': cost, 'audit': audit, 'made': made}}) FROM (
    SELECT conv, i, CASE e WHEN 'D' THEN state WHEN 'R' THEN {_AFTER.format(s='state')} WHEN 'K' THEN CASE WHEN state = 0 AND initial = 's' THEN 1 WHEN state <> 2 AND initial = 'u' THEN 2 WHEN state = 2 AND initial = 'a' THEN 3 END END AS target,
      cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, audit || e AS audit,
      nullif(concat_ws(chr(10), made, CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN {_ROLE.format(s=_AFTER.format(s='state'))} || ':' || text END), '') AS made
    FROM (
      SELECT w.conv, r.i, r.initial, r.role, r.text, r.fault, CASE m WHEN 0 THEN w.state WHEN 1 THEN {_AFTER.format(s='w.state')} ELSE CASE w.state WHEN 2 THEN 2 ELSE 3 END END AS state,
        w.best.cost + 3 * m AS cost, w.best.audit || repeat('I', m) AS audit,
        nullif(concat_ws(chr(10), w.best.made, CASE WHEN m > 0 THEN {_ROLE.format(s=_AFTER.format(s='w.state'))} || ':' END, CASE WHEN m > 1 THEN CASE w.state WHEN 2 THEN 'user' ELSE 'assistant' END || ':' END), '') AS made
      FROM ways w JOIN faults r ON r.conv = w.conv AND r.i = w.i + 1, unnest([0, 1, 2]) AS u(m)) AS inserted, unnest(['D', 'K', 'R']) AS v(e)
    WHERE e = 'D' OR fault IS NULL OR fault = 'truncated') AS options
  WHERE target IS NOT NULL GROUP BY conv, i, target),
ends AS (
  SELECT w.conv, min({{'cost': w.best.cost + 3 * m, 'audit': w.best.audit || repeat('I', m),
    'made': concat_ws(chr(10), w.best.made, CASE WHEN m = 2 THEN 'user:' END, CASE WHEN m > 0 THEN 'assistant:' END)}}) AS best
  FROM (SELECT *, CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS m FROM ways) w LEFT JOIN counted c ON c.conv = w.conv WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv)
SELECT v.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(coalesce(e.best.made, '')) AS repaired_sha256
FROM convs v JOIN ends e ON e.conv = v.conv LEFT JOIN counted c ON c.conv = v.conv
"""
