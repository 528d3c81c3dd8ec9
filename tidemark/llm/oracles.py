"""DuckDB SQL of the corpus queries that SQL can express; each follows the contract plainly, not the operator's method."""

from __future__ import annotations

from tidemark.llm.decontaminate import AGREE, LEAST_ITEM, LEAST_TOKENS, MASKS, WINDOW
from tidemark.llm.quality import LINE_LIMIT, NGRAM_LIMITS
from tidemark.llm.warc import EPOCH

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

OP2_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
covered AS (
  SELECT x.doc_id, x.p, x.word, max(r.s) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS 34 PRECEDING) IS NOT NULL AS gone
  FROM words x LEFT JOIN rep r ON r.doc_id = x.doc_id AND r.s = x.p),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM covered GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _coverage(n: int) -> str:
    """A CTE of each document's words and characters under n-grams that occur twice in it."""
    gram = " || ' ' || ".join(f"lead(word, {i}) OVER o" if i else "word" for i in range(n))
    return f"""g{n} AS (SELECT doc_id, p, word, {gram} AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
d{n} AS (SELECT *, gram IS NOT NULL AND count(gram) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g{n}),
c{n} AS (SELECT doc_id, word, max(CASE WHEN twice THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS {n - 1} PRECEDING) IS NOT NULL AS under FROM d{n}),
s{n} AS (SELECT doc_id, count(*) FILTER (under) AS words_under, coalesce(sum(length(word)) FILTER (under), 0) AS chars_under FROM c{n} GROUP BY doc_id)"""


_NS = [3, *NGRAM_LIMITS]
OP5_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
{", ".join(_coverage(n) for n in _NS)},
chars AS (SELECT doc_id, sum(length(word)) AS n FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
again AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM lines WHERE nth > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(a.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s3.words_under, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(a.chars, 0) AS DOUBLE) / greatest(coalesce(c.n, 0), 1) AS line_share,
    {", ".join(f"CAST(coalesce(s{n}.chars_under, 0) AS DOUBLE) / greatest(coalesce(c.n, 0), 1) AS dup{n}_share" for n in NGRAM_LIMITS)}
  FROM w LEFT JOIN chars c USING (doc_id) LEFT JOIN again a USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in _NS)}),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND line_share <= {LINE_LIMIT} AND {" AND ".join(f"dup{n}_share <= {x}" for n, x in NGRAM_LIMITS.items())} AS kept FROM j
"""

_B32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), '')"""
OP7_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
bitted AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM hashed),
keyed AS (
  SELECT *, regexp_replace(lower(split_part(coalesce(url, ''), '#', 1)), '^[a-z][a-z0-9+.-]*://', '') AS rest FROM bitted),
hosted AS (
  SELECT *, regexp_replace(split_part(rest, '/', 1), '^www\\.', '') AS host, CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM keyed)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path AS url_key,
  strftime(to_timestamp({EPOCH} + page_id) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS ts
FROM hosted
"""

_TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _seeds(source: str) -> str:
    """Seed strings of every position: the tokens under each mask's ones."""
    parts = [f"SELECT id, i - 1 AS pos, '{k}:' || {' || chr(1) || '.join(f't[i + {o}]' for o, bit in enumerate(m) if bit == '1')} AS seed FROM (SELECT id, t, unnest(range(1, len(t) - {len(m)} + 2)) AS i FROM {source} WHERE len(t) >= {len(m)})" for k, m in enumerate(MASKS)]
    return " UNION ALL ".join(parts)


OP8_SQL = f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
b AS (SELECT item_id AS id, t FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark) WHERE len(t) >= {LEAST_ITEM}),
short AS (SELECT id, t FROM b WHERE len(t) < {min(map(len, MASKS))}),
lens AS (SELECT DISTINCT len(t) AS n FROM short),
ds AS ({_seeds("d")} UNION ALL SELECT id, i - 1 AS pos, array_to_string(list_slice(t, i, i + n - 1), chr(1)) AS seed FROM (SELECT id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, lens WHERE len(t) >= n)),
bs AS ({_seeds("b")} UNION ALL SELECT id, 0 AS pos, array_to_string(t, chr(1)) AS seed FROM short),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.pos - bs.pos AS g FROM ds JOIN bs USING (seed)),
same AS (
  SELECT h.doc_id, h.item_id, h.g, x.i, CAST(d.t[x.i + h.g] = b.t[x.i] AS INTEGER) AS eq, count(*) OVER (PARTITION BY h.doc_id, h.item_id, h.g) AS n, len(b.t) AS item_size
  FROM hits h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id JOIN (SELECT unnest(range(1, 10000)) AS i) x ON x.i <= len(b.t) AND x.i + h.g BETWEEN 1 AND len(d.t)),
win AS (
  SELECT *, sum(eq) OVER w AS agree, count(*) OVER w AS span FROM same WINDOW w AS (PARTITION BY doc_id, item_id, g ORDER BY i ROWS {WINDOW - 1} PRECEDING)),
diag AS (
  SELECT doc_id, item_id, g, max(n) AS n, max(item_size) AS item_size, sum(eq) AS total, max(agree) FILTER (span = least({WINDOW}, n)) AS best FROM win GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(max(total) AS BIGINT) AS n_agree, CAST(max(best) AS BIGINT) AS best_window FROM diag
WHERE n >= least({LEAST_TOKENS}, item_size) AND best >= CASE WHEN n >= {WINDOW} THEN {AGREE} ELSE ceil(n * 6 / 7.0) END GROUP BY 1, 2
"""


def _lp(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_lp(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: crc32 of the decimal doc_id, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(0, 8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)


def _climb(name: str, of: str, depth: int) -> str:
    """CTEs that climb `depth` levels: h the digest of the node over each row, fold that of the tampered leaf, proof the siblings met."""
    out = [f"{name}0 AS (SELECT * FROM {of})"]
    for k in range(depth):
        pair = f"{name}{k}p"
        out.append(f"{pair} AS (SELECT *, max(h) FILTER (i % 2 = 0) OVER w AS l, max(h) FILTER (i % 2 = 1) OVER w AS r FROM {name}{k} WINDOW w AS (PARTITION BY grp, i // 2))")
        out.append(
            f"{name}{k + 1} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN m = 1 THEN h ELSE sha256(l || coalesce(r, '')) END AS h, "
            "CASE WHEN m = 1 THEN fold WHEN i % 2 = 0 THEN sha256(fold || coalesce(r, '')) ELSE sha256(l || fold) END AS fold, "
            "CASE WHEN m = 1 THEN proof WHEN i % 2 = 0 THEN proof || coalesce(r, '') ELSE proof || l END AS proof, "
            f"i // 2 AS i, (m + 1) // 2 AS m) FROM {pair})"
        )
    return ", ".join(out)


#: Languages of up to 2^24 documents, up to 2^10 languages.
OP13_SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS bent FROM documents),
base AS (
  SELECT doc_id, grp, leaf, leaf AS h, coalesce(bent, leaf) AS fold, '' AS proof, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS m FROM leaves),
{_climb("d", "base", 24)},
subs AS (SELECT DISTINCT grp AS name, h FROM d24),
sub_base AS (SELECT name, h, h AS fold, '' AS proof, '' AS grp, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS m FROM subs),
{_climb("s", "sub_base", 10)},
top AS (SELECT d.doc_id, d.leaf, d.h AS subroot, d.h, d.fold, d.proof, b.i, b.m, b.name FROM d24 d JOIN sub_base b ON b.name = d.grp),
up AS (
  SELECT t.doc_id, t.leaf, t.subroot, t.proof || s.proof AS proof, s.h AS root, t.fold, t.name FROM top t JOIN s10 s ON s.name = t.name),
-- the way from subroots to the root, level by level, for the folded digest
steps AS ({" UNION ALL ".join(f"SELECT name, {k} AS k, i, m, l, r FROM s{k}p" for k in range(10))}),
path AS (SELECT name, list(struct_pack(i := i, m := m, l := l, r := r) ORDER BY k) AS p FROM steps GROUP BY name),
folded AS (
  SELECT u.*, list_reduce(list_prepend(u.fold, list_transform(p, lambda s: CASE WHEN s.m = 1 THEN '' WHEN s.i % 2 = 0 THEN '>' || coalesce(s.r, '') ELSE '<' || s.l END)),
    lambda a, b: CASE WHEN b = '' THEN a WHEN b[1] = '>' THEN sha256(a || b[2:]) ELSE sha256(b[2:] || a) END) AS folded_root
  FROM up u JOIN path USING (name))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
