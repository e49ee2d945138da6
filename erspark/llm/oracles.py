"""DuckDB SQL of the queries that SQL can express."""

from erspark.llm.decontam import SLOP
from erspark.llm.mixing import BLOCK, N_SHARDS, ROUNDS
from erspark.llm.quality import DELTA, GRID, MAX_FALSE, METRICS

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAM = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, CASE WHEN len(words) < 10 THEN words ELSE words[k:k+9] END AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS k FROM i WHERE len(words) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT rid, k, n, words[k:k+n-1] AS win FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, lens)),
hit AS (SELECT dw.rid, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM hit GROUP BY rid),
terms AS (SELECT term, count(*) AS n FROM (SELECT unnest(words) AS term FROM d) GROUP BY term),
tokens AS (SELECT rid, unnest(words) AS term, unnest(range(0, len(words))) AS pos FROM d),
place AS (SELECT win, off, w.term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), off) AS rk, count(*) OVER (PARTITION BY win) AS size, min(coalesce(n, 0)) OVER (PARTITION BY win) AS least
  FROM (SELECT win, unnest(win) AS term, unnest(range(0, len(win))) AS off FROM (SELECT DISTINCT win FROM iw)) w LEFT JOIN terms USING (term)),
one AS (SELECT rid, win, pos - off AS start FROM place JOIN tokens USING (term) WHERE rk = 1 AND least > 0),
two AS (SELECT rid, win, pos - off AS start FROM place JOIN tokens USING (term) WHERE rk = least(2, size) AND least > 0),
near AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT one.rid, one.win FROM one JOIN two ON one.rid = two.rid AND one.win = two.win AND abs(one.start - two.start) <= {SLOP}) JOIN iw USING (win) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid) LEFT JOIN near USING (rid)
"""

SHARDING = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, n::BIGINT)) AS tb),
r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS text, substr(md5(coalesce(text, '')), 1, 16) AS tk,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS ik FROM documents),
c AS (SELECT DISTINCT text FROM r),
h AS (SELECT text, hex(encode(text)) AS hx FROM c),
s AS (SELECT text, xor(4294967295::BIGINT, list_reduce(list_transform(range(CAST(length(hx) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)),
  lambda x, y: xor(x >> 8, tb[(xor(x, y) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM h, crc),
t AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM r),
b AS (SELECT tk, bytes, row_number() OVER (ORDER BY bytes DESC, tk) AS nr FROM (SELECT tk, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY tk), t WHERE bytes * 8 * 64 > total),
f(nr, room, tk, shard) AS (SELECT CAST(0 AS BIGINT), list_transform(range(8), lambda k: (total + 7) // 8), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM t
  UNION ALL SELECT b.nr, CASE WHEN bytes <= list_max(room) THEN list_transform(room, lambda x, k: CASE WHEN k = list_position(room, list_max(room)) THEN x - bytes ELSE x END) ELSE room END, b.tk,
    CASE WHEN bytes <= list_max(room) THEN CAST(list_position(room, list_max(room)) - 1 AS INTEGER) END FROM f JOIN b ON b.nr = f.nr + 1),
e AS (SELECT list_transform(range(1, 8), lambda k: 2 * list_sum(room[1:k])) AS ends FROM f ORDER BY nr DESC LIMIT 1),
o AS (SELECT r.*, f.tk IS NOT NULL AS big, f.shard AS own_shard, CASE WHEN f.shard IS NULL THEN size ELSE 0 END AS laid FROM r LEFT JOIN f ON f.tk = r.tk),
u AS (SELECT *, sum(laid) OVER (ORDER BY tk, ik, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop FROM o),
g AS (SELECT *, CASE WHEN big THEN 2 * stop - laid ELSE min(stop - laid) OVER (PARTITION BY tk) + max(stop) OVER (PARTITION BY tk) END AS middle FROM u),
p AS (SELECT g.*, coalesce(own_shard, CAST(len(list_filter(ends, lambda x: middle >= x)) AS INTEGER)) AS shard FROM g, e)
SELECT p.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY tk, ik, doc_id NULLS FIRST, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p JOIN s USING (text)
"""


def _mix(x: str) -> str:
    low = f"((({x}) % 2147483647 * 48271 + 11) % 2147483647)"
    mid = f"((xor({low}, {low} >> 15) * 69621 + 7) % 2147483647)"
    return f"xor({mid}, {mid} >> 13)"


def _rounds(source: str) -> str:
    """The swap-or-not rounds over the columns pt, n and key of ``source``, one subquery each."""
    for i in range(ROUNDS):
        first, second, third = (_mix(f"key + {3 * i + k}") for k in range(3))
        other = f"SELECT *, (({first} * 1000003 + {second}) % n - pt + n) % n AS other FROM {source}"
        high = "greatest(pt, other)"
        told = f"(({high} % 2147483647 + ({high} >> 31) * 7919) % 2147483647 * ({third} % 2147483646 + 1) + {first}) % 2147483647"
        source = f"(SELECT * EXCLUDE (pt, other), CASE WHEN (({told}) >> 9) & 1 = 1 THEN other ELSE pt END AS pt FROM ({other}))"
    return source


MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS k FROM documents),
w AS (SELECT *, (source_no - 1) % 3 + 1 AS weight, 3 * source_size AS room FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source)),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(room) OVER b, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY room / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT level FROM l WHERE room > level * weight ORDER BY room / weight, source_no LIMIT 1) AS final FROM l),
t AS (SELECT *, CASE WHEN room > level * weight THEN least(final * weight, CAST(room AS DOUBLE)) ELSE CAST(room AS DOUBLE) END AS target FROM f),
u AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), room) AS wanted, (source_size + {BLOCK - 1}) // {BLOCK} AS n_blocks,
  CAST('0x' || substr(md5(coalesce(source, chr(0))), 1, 7) AS BIGINT) AS skey FROM t),
v AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN wanted % source_size ELSE 0 END AS lack FROM u),
s0 AS (SELECT source_no, source_size, passes, lack, n_blocks AS n, slot // n_blocks AS pass, (slot % n_blocks + slot // n_blocks * 104729) % n_blocks AS pt, slot % n_blocks AS place, skey AS key
  FROM (SELECT *, unnest(range(0, passes * n_blocks + CASE WHEN lack > 0 THEN least(n_blocks, (lack + {BLOCK - 1}) // {BLOCK} + 1) ELSE 0 END)) AS slot FROM v)),
s1 AS (SELECT *, pt AS block, CASE WHEN pt = n - 1 THEN source_size - pt * {BLOCK} ELSE {BLOCK} END AS length FROM {_rounds('s0')}),
s2 AS (SELECT *, max(CASE WHEN pass = passes AND length < {BLOCK} THEN place END) OVER p AS short_at, max(CASE WHEN pass = passes AND length < {BLOCK} THEN length END) OVER p AS short_length
  FROM s1 WINDOW p AS (PARTITION BY source_no)),
s3 AS (SELECT source_no, block, length, pass * n + place AS slot, CASE WHEN pass < passes THEN length ELSE least(length, lack - (place * {BLOCK} - CASE WHEN place > short_at THEN {BLOCK} - short_length ELSE 0 END)) END AS take FROM s2),
o AS (SELECT d.*, row_number() OVER () AS rid, v.source_no, v.source_size, v.target,
  sum(size) OVER (PARTITION BY v.source_no ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
p AS (SELECT rid, source_no, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, unnest(range(CAST(stop - size AS BIGINT) // {BLOCK}, (CAST(stop AS BIGINT) - 1) // {BLOCK} + 1)) AS block FROM o WHERE size > 0),
k0 AS (SELECT *, row_number() OVER (ORDER BY source_no, slot) - 1 AS pt, count(*) OVER () AS n, 15485863::BIGINT AS key FROM s3 WHERE take > 0),
k1 AS (SELECT source_no, row_number() OVER (PARTITION BY source_no ORDER BY pt // ((n + {N_SHARDS - 1}) // {N_SHARDS})) - 1 AS nth, pt // ((n + {N_SHARDS - 1}) // {N_SHARDS}) AS shard FROM {_rounds('k0')}),
q AS (SELECT rid, sum(words) AS taken, count(DISTINCT shard) FILTER (WHERE words > 0) AS n_shards FROM (SELECT rid, shard, greatest(least(stop - block * {BLOCK}, take) - greatest(start - block * {BLOCK}, 0), 0) AS words
  FROM p JOIN s3 USING (source_no, block) JOIN k1 ON k1.source_no = s3.source_no AND k1.nth = s3.slot WHERE take > 0) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(n_shards, 0) AS BIGINT) AS n_shards FROM o LEFT JOIN q USING (rid)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, rid, k, md5(array_to_string(words[k:k+49], ' ')) AS h FROM (SELECT doc_id, rid, words, unnest(range(1, len(words) - 48)) AS k FROM d WHERE len(words) >= 50)),
m AS (SELECT h, min(doc_id) AS lowest FROM w GROUP BY h),
g AS (SELECT DISTINCT rid, unnest(range(k, k + 50)) AS p FROM w JOIN m USING (h) WHERE lowest < doc_id OR (doc_id IS NULL AND lowest IS NOT NULL)),
s AS (SELECT rid, list(p) AS gone FROM g GROUP BY rid),
e AS (SELECT d.doc_id, d.words, coalesce(s.gone, []) AS gone, d.rid FROM d LEFT JOIN s USING (rid)),
x AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
y AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.p = g.p WHERE g.p IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM e LEFT JOIN y USING (rid)
"""

SUFFIXES = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS rid, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT rid, k, hash(substr(hx, 2 * k - 1, 200)) AS h FROM (SELECT rid, hx, unnest(range(1, CAST(length(hx) / 2 AS BIGINT) - 98)) AS k FROM d WHERE length(hx) >= 200)),
r AS (SELECT rid, k, row_number() OVER (PARTITION BY h ORDER BY rid, k) AS n FROM w),
g AS (SELECT DISTINCT rid, unnest(range(k, k + 100)) AS p FROM (SELECT rid, k FROM r WHERE n > 1)),
x AS (SELECT rid, hx, unnest(range(1, CAST(length(hx) / 2 AS BIGINT) + 1)) AS p FROM d),
y AS (SELECT x.rid, string_agg(substr(hx, 2 * x.p - 1, 2), '' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.p = g.p WHERE g.p IS NULL GROUP BY x.rid),
z AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM g) GROUP BY rid)
SELECT doc_id, CAST(length(hx) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN y USING (rid) LEFT JOIN z USING (rid)
"""

_LOG_TERM = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share)"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, k, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
again AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(k, k + 5)) AS p FROM win JOIN again USING (rid, s)) GROUP BY rid),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT d.doc_id, stratum, d.rid, text AS copy, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_caps, len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) AS n_stutters, len(regexp_extract_all(text, '[!?]')) AS n_bangs FROM d LEFT JOIN hit USING (rid) LEFT JOIN li USING (rid)),
m AS (SELECT doc_id, rid, stratum, copy, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN least(1, n_symbols::DOUBLE / n_words) ELSE 0 END AS symbol_share, CASE WHEN n_words > 0 THEN least(1, n_caps::DOUBLE / n_words) ELSE 0 END AS caps_share,
  CASE WHEN n_words > 0 THEN n_stutters::DOUBLE / n_words ELSE 0 END AS stutter_share, CASE WHEN n_words > 0 THEN least(1, n_bangs::DOUBLE / n_words) ELSE 0 END AS bang_share, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
x AS (SELECT stratum, quality, unnest([{", ".join(repr(name) for name in METRICS)}]) AS metric, CAST(ceil(unnest([{", ".join(METRICS)}]) * {GRID}) AS INTEGER) - 1 AS step
  FROM (SELECT stratum, max(quality) AS quality, {", ".join(f"any_value({name}) AS {name}" for name in METRICS)} FROM m JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY stratum, copy)),
size AS (SELECT stratum, count(*) / {len(METRICS)} AS n, CAST({MAX_FALSE} AS DOUBLE) / {len(METRICS)} AS share FROM x WHERE quality = 1 GROUP BY stratum),
g AS (SELECT stratum, metric, s, n, share, (SELECT count(*) FROM x WHERE x.stratum = size.stratum AND x.metric = q.metric AND x.step >= s AND x.step < {GRID} AND quality = 1) AS rejected,
  (SELECT count(*) FROM x WHERE x.stratum = size.stratum AND x.metric = q.metric AND x.step >= s AND x.step < {GRID} AND quality = 0) AS caught FROM size, (SELECT DISTINCT metric FROM x) q, range(1, {GRID}) r(s)),
cdf AS (SELECT *, coalesce(list_sum(list_transform(range(0, rejected + 1), lambda i: exp({_LOG_TERM}))), 1) <= CAST({DELTA} AS DOUBLE) / ((SELECT count(*) FROM size) * {len(METRICS)}) AS certified FROM g),
ok AS (SELECT * FROM cdf WHERE s > coalesce((SELECT max(s) FROM cdf f WHERE f.stratum = cdf.stratum AND f.metric = cdf.metric AND NOT f.certified), 0)),
best AS (SELECT stratum, metric, max(s) AS s FROM ok WHERE caught > 0 AND caught = (SELECT max(caught) FROM ok o WHERE o.stratum = ok.stratum AND o.metric = ok.metric) GROUP BY stratum, metric),
cut AS (SELECT stratum, {", ".join(f"max(s) FILTER (WHERE metric = '{name}') AS cut_{name}" for name in METRICS)} FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(METRICS)}, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({name} <= cut_{name}::DOUBLE / {GRID}, TRUE)" for name in METRICS)} AS kept FROM m LEFT JOIN cut USING (stratum)
"""
