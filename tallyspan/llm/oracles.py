"""SQL that an independent engine runs to check the queries that it can express."""

from __future__ import annotations

from tallyspan.llm.chat import CONTROL_STRINGS
from tallyspan.llm.url_reputation import DOUBLE_SUFFIXES


def _escaped(text: str) -> str:
    """SQL for the escaped text: the escape character doubled, then put behind the first character of every control string."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL_STRINGS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2_CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE
    WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role IN ('assistant', 'tool')
    WHEN before = 'assistant' THEN role IN ('user', 'tool')
    ELSE role IN ('assistant', 'tool') END AND (NOT last OR role = 'assistant') AS fits
  FROM placed
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length({_escaped('text')}) + length('<|im_end|>'))::BIGINT AS formatted_chars,
  bool_and(fits) AS valid
FROM judged GROUP BY conv_id
"""


OP4_WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), least AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, true AS intact
FROM least
"""

#: Levels of the common target are found by sharing out again, one round for each source at most.
OP5_MIXING = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents
), quality AS (
  SELECT doc_id, avg(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT s.*, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~')), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0::DOUBLE)
    / (CASE WHEN weight > 0 THEN weight ELSE 1.0::DOUBLE END) AS key
  FROM sized s LEFT JOIN quality USING (doc_id)
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS n, source, source_size, weight, 1.5 * (sum(source_size) OVER ()) * weight / (sum(weight) OVER ()) AS target, false AS stopped FROM sources
  UNION ALL
  SELECT n + 1, source, source_size, weight,
    CASE WHEN over_limit OR room = 0 THEN least(target, limit_) ELSE target + excess * weight / room END, over_limit
  FROM (
    SELECT *, sum(target - limit_) FILTER (target > limit_) OVER () AS excess, sum(weight) FILTER (NOT over_limit) OVER () AS room
    FROM (SELECT *, 2 * source_size AS limit_, target >= 2 * source_size AS over_limit FROM rounds)
  ) WHERE excess > 0
), settled AS (
  SELECT source, source_size::BIGINT AS source_size, round(target, 6) AS target FROM rounds WHERE n = (SELECT max(n) FROM rounds)
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM settled
), placed AS (
  SELECT k.*, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""


_TWO = ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES)


def _level(keys: str, parent: str, rate: str) -> str:
    """SQL for one level of shrinkage: groups of hosts, the strength of their prior, their posterior rates."""
    return f"""(
  SELECT g.*, m, (k + m * p) / (n + m) AS rate FROM (SELECT {keys}, n, k, p FROM (SELECT {keys}, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY {keys}) c {parent}) g,
  (SELECT greatest(2.0, least(1000.0, CASE WHEN between_ > 0 THEN noise / between_ - 1 ELSE 1000.0 END)) AS m FROM (
    SELECT noise, (spread - (many - 1) * noise) / nullif(total - squares / nullif(total, 0), 0) AS between_ FROM (
      SELECT sum(n)::DOUBLE AS total, count(*) AS many, sum(n * n)::DOUBLE AS squares, sum(p * (1 - p)) / nullif(count(*), 0) AS noise,
        sum(n * pow(k::DOUBLE / n - p, 2)) AS spread
      FROM (SELECT {keys}, n, k, {rate} AS p FROM (SELECT {keys}, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY {keys}) c {parent}) WHERE n > 0)))
)"""


OP6_URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), outcomes AS (
  SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site
  FROM parts LEFT JOIN outcomes ON doc_id = page_id GROUP BY host
), hosts AS (
  SELECT *, CASE WHEN two IN ({_TWO}) THEN two ELSE split_part(site, '.', -1) END AS suffix,
    CASE WHEN two IN ({_TWO}) THEN regexp_extract(site, '[^.]*\.?[^.]*\.?[^.]*$') ELSE two END AS domain
  FROM (SELECT *, regexp_extract(site, '[^.]*\.?[^.]*$') AS two FROM counted)
), suffixes AS {_level("suffix", "JOIN (SELECT coalesce(sum(k)::DOUBLE / nullif(sum(n), 0), 0) AS p FROM hosts) ON true", "p")},
domains AS {_level("suffix, domain", "JOIN (SELECT suffix, rate AS p FROM suffixes) USING (suffix)", "p")},
named AS {_level("suffix, domain, host", "JOIN (SELECT suffix, domain, rate AS p FROM domains) USING (suffix, domain)", "p")},
bounds AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + m + 1)) AS bound FROM named),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 9) AS bad_rate, round(bound, 9) AS bound
FROM ruled JOIN bounds USING (host)
"""


OP12_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x
    FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS many
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) sizes(k))
  GROUP BY ALL
), totals AS (SELECT lang, sum(many)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.many AS a, j, h.many AS l, t.many AS r, (1000000::HUGEINT * c.many * c.many) // (h.many::HUGEINT * t.many) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM grams WHERE k > 1 AND many >= 10) c
  JOIN grams h ON h.lang = c.lang AND h.phrase = array_to_string(w[:j], ' ')
  JOIN grams t ON t.lang = c.lang AND t.phrase = array_to_string(w[j + 1:], ' ')
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
holders AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(many) AS longer
  FROM (SELECT lang, string_split(phrase, ' ') AS w, many, unnest([1, 2]) AS i FROM grams WHERE k = 3 AND many >= 10) GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest w LEFT JOIN holders h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


_INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT_FROM = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}


def _edits(state: int) -> str:
    """SQL for the cheapest edits of the turns from here on, before an insert: pairs of cost and audit, compared in that order."""
    kept = " ".join(f"WHEN initial = '{i}' THEN {{'c': late + x{t}.c, 'a': 'K' || x{t}.a}}" for i, t in _KEPT_FROM[state])
    next_ = _INSERTED[state]
    return _least(f"{{'c': 2 + x{state}.c, 'a': 'D' || x{state}.a}}", f"CASE WHEN gone THEN NULL {kept} END",
                  f"CASE WHEN NOT gone THEN {{'c': 1 + late + x{next_}.c, 'a': 'R' || x{next_}.a}} END")


def _or_insert(state: int) -> str:
    next_ = _INSERTED[state]
    return f"{_least(f'x{state}', f'''{{'c': 5 + x{next_}.c, 'a': 'I' || x{next_}.a}}''')} AS x{state}"


_ROUND = ", ".join(_or_insert(s) for s in range(4))
#: The checksum of a text of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(id, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda crc, x: xor(xor(crc, x) >> 1, CASE WHEN xor(crc, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

OP13_REPAIR = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32} % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time FROM damaged
), judged AS (
  SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM placed
), turns AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM judged
), back AS (
  SELECT conv_id, max(i) + 1 AS i, {{'c': 0, 'a': ''}} AS x0, {{'c': 10, 'a': 'II'}} AS x1, {{'c': 5, 'a': 'I'}} AS x2, {{'c': 0, 'a': ''}} AS x3
  FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_ROUND} FROM (SELECT conv_id, i, {_ROUND} FROM (SELECT conv_id, i, {_ROUND} FROM (
    SELECT t.conv_id, t.i, {", ".join(f"{_edits(s)} AS x{s}" for s in range(4))}
    FROM back b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1)))
), audits AS (SELECT conv_id, x0.c AS cost, x0.a AS audit FROM back WHERE i = 1
), edits AS (
  SELECT conv_id, j, audit[j] AS edit, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) AS o
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM audits)
), lines AS (
  SELECT e.*, t.role, t.text, bool_or(edit = 'K' AND o = 1 AND t.initial = 's') OVER (PARTITION BY e.conv_id) AS briefed
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i AND edit <> 'I' WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - briefed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS repaired
  FROM lines GROUP BY conv_id
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def llm_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_CHAT_FORMAT, "op4_warc": OP4_WARC, "op5_mixing": OP5_MIXING, "op6_url_filter": OP6_URL_FILTER,
            "op12_collocations": OP12_COLLOCATIONS, "op13_conversation_repair": OP13_REPAIR}
