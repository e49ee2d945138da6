"""DuckDB SQL of the registered queries. Patterns follow erspark.functions.patterns in RE2's syntax."""

from __future__ import annotations

from erspark.operators import minhash, sampling

_DOCS = "docs AS (SELECT doc_id AS id, md5(text) AS true_model_id, coalesce(text, '') AS title, coalesce(source, '') AS shop FROM documents)"
_LIKE = "x.id < y.id AND x.brand = y.brand AND x.type = y.type AND x.screen = y.screen"
_PARTS = """parts AS (SELECT p_partkey AS id, concat_ws('|', p_name, p_brand, p_type) AS true_model_id,
  p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_size || ' inch M' || p_partkey || 'X' || p_size || ' ' || p_size || lower(substr(p_type, 1, 2)) AS title,
  'shop' || (p_partkey % 4) AS shop, p_brand AS brand, p_type AS type, p_size || '.5 inches' AS screen, p_size || ':9' AS ratio,
  (1000 + 100 * length(p_type)) || ' x ' || (500 + 100 * length(p_type)) AS res FROM part)"""
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title),
  '(\d+)\s*[- ]?\s*(?:inch(?:es)?|")', '\1inch', 'g'), '(\d+)\s*[- ]?\s*(?:hz|hertz)', '\1hz', 'g'), '(\d+)\s*[- ]?\s*(?:lbs|pounds)', '\1lbs', 'g'),
  '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g'))"""
_SHINGLES = f"""cleaned AS (SELECT id, {_CLEAN} AS c FROM docs),
shingles AS (SELECT DISTINCT id, substr(c, CAST(i AS INTEGER), 4) AS shingle, FALSE AS short FROM (SELECT id, c, unnest(range(1, length(c) - 2)) AS i FROM cleaned WHERE length(c) >= 4)
  UNION ALL SELECT id, c, TRUE FROM cleaned WHERE length(c) < 4)"""
_STOPS = "stops AS (SELECT shingle, count(*) AS df FROM shingles WHERE NOT short GROUP BY shingle HAVING count(*) > (SELECT count(*) FROM docs) * CAST(0.0138 AS DOUBLE))"
_TITLE_WORD = r"regexp_extract_all(title, '([a-zA-Z0-9]*((\d*\.)?\d+[^0-9, ]+)[a-zA-Z0-9]*)', 1)"


def _value_words(value: str) -> str:
    return rf"list_transform(regexp_extract_all({value}, '^\d+\.\d+|\b\d+:\d+\b|(?:^|\s)\d{{3,}}\s*[x]\s*\d{{3,}}(?:\s|$)'), lambda w: lower(trim(w)))"


_VALUES = f"vwords AS (SELECT DISTINCT id, unnest(list_concat(list_concat({_value_words('brand')}, {_value_words('type')}), list_concat({_value_words('screen')}, list_concat({_value_words('ratio')}, {_value_words('res')})))) AS word FROM parts)"
_TITLES = f"twords AS (SELECT DISTINCT id, unnest(list_transform({_TITLE_WORD}, lambda w: lower(w))) AS word FROM parts)"
_CRC = """tb AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, n::BIGINT)) AS t),
hashed AS (SELECT shingle, xor(4294967295::BIGINT, list_reduce(list_transform(range(1, length(shingle) + 1), lambda i: CAST(ascii(substr(shingle, CAST(i AS INTEGER), 1)) AS BIGINT)),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT)) AS x FROM (SELECT DISTINCT shingle FROM shingles), tb)"""
_HASHES = ", ".join(f"({k}, {a}::HUGEINT, {b}::HUGEINT)" for k, (a, b) in enumerate(minhash.coefficients(16)))
_PRUNED = f"{_STOPS}, pruned AS (SELECT id, shingle FROM shingles WHERE short OR shingle NOT IN (SELECT shingle FROM stops))"
_SIGS = f"""coef(position, a, b) AS (VALUES {_HASHES}),
sigs AS (SELECT id, position, CAST(min((a * x + b) % 4294967295) AS BIGINT) AS value FROM shingles JOIN hashed USING (shingle), coef GROUP BY id, position)"""
_CANDIDATES = """bands AS (SELECT id, position // 2 AS band, list(value ORDER BY position) AS bucket FROM sigs GROUP BY id, position // 2),
cands AS (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM bands x JOIN bands y ON x.band = y.band AND x.bucket = y.bucket AND x.id < y.id)"""
_CLASSES = """member AS (SELECT id, min(id) OVER (PARTITION BY sig) AS rep FROM (SELECT id, list(value ORDER BY position) AS sig FROM sigs GROUP BY id)),
reps AS (SELECT id1, id2 FROM cands WHERE id1 IN (SELECT rep FROM member) AND id2 IN (SELECT rep FROM member))"""
_FULL_LSH = f"{_DOCS}, {_SHINGLES}, {_PRUNED}, {_CRC}, {_SIGS.replace('FROM shingles JOIN', 'FROM pruned JOIN')}, {_CANDIDATES}, {_CLASSES}"
_PAIR = "pairs AS (SELECT x.id AS id1, y.id AS id2, x.title AS t1, y.title AS t2 FROM parts x JOIN parts y ON y.id = x.id + 1)"
_NLEV = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0.0 ELSE levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"
_WORD_PAIRS = f"""ow AS (SELECT id, word, regexp_replace(word, '[0-9]', '', 'g') AS a, regexp_replace(word, '[^0-9]', '', 'g') AS n FROM (SELECT DISTINCT id, unnest({_TITLE_WORD}) AS word FROM parts)),
wp AS (SELECT p.id1, p.id2, x.word AS w1, y.word AS w2, {_NLEV.format('x.a', 'y.a')} AS d, x.n = y.n AS same, (length(x.word) + length(y.word))::DOUBLE AS weight,
  1 - {_NLEV.format('x.word', 'y.word')} AS s FROM pairs p JOIN ow x ON x.id = p.id1 JOIN ow y ON y.id = p.id2),
ws AS (SELECT id1, id2, coalesce(sum(s * weight) / nullif(sum(weight), 0), 0) AS lenient,
  coalesce(sum(s * weight) FILTER (WHERE d > 0.5 AND same) / nullif(sum(weight) FILTER (WHERE d > 0.5 AND same), 0), 0) AS strict,
  bool_or(d > 0.528 AND NOT same) AS unlike, bool_or(d > 0.528 AND same) AS alike FROM wp GROUP BY id1, id2)"""
_COSINE = """toks AS (SELECT id1, id2, list_distinct(list_filter(regexp_split_to_array(t1, '\\s+'), lambda t: t <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(t2, '\\s+'), lambda t: t <> '')) AS b FROM pairs),
cosine AS (SELECT id1, id2, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (sqrt(len(a)) * sqrt(len(b))) END AS cos FROM toks)""".replace("\\\\", "\\")


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, CAST(i AS INTEGER), 3)))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


_FEATS = """feats AS (SELECT id, unnest([1, 2, 3, 4, 5]) AS k, unnest(['Brand', 'Type', 'Screen Size', CASE WHEN id % 2 = 1 THEN 'Aspect Ratio' ELSE 'Ratio' END, CASE WHEN id % 2 = 1 THEN 'Native Resolution' ELSE 'Resolution (native)' END]) AS key,
  unnest([brand, type, screen, ratio, res]) AS value FROM parts)"""


def _greedy(on: str, pairs: str = "parts x JOIN parts y") -> str:
    """The greedy matching as a recursion over the attributes of the first side; ``pairs`` and ``on`` say which parts x, y are pairs."""
    words = _value_words("value").replace("lower(trim(w))", "trim(w)")
    return f"""{_FEATS},
fg AS (SELECT id, k, key, {_grams('key')} AS kg, {_grams('value')} AS vg, {words} AS mw FROM feats),
pairs AS (SELECT x.id AS id1, y.id AS id2, x.title AS t1, y.title AS t2 FROM {pairs} ON {on}),
sims AS (SELECT id1, id2, x.k AS k1, x.key AS key1, y.k AS k2, {_jaccard('x.kg', 'y.kg')} AS ks, {_jaccard('x.vg', 'y.vg')} AS vs FROM pairs JOIN fg x ON x.id = id1 JOIN fg y ON y.id = id2),
hits AS (SELECT id1, id2, k1, list({{'k2': k2, 'key1': key1, 'ks': ks, 'vs': vs}} ORDER BY k2) AS found FROM sims WHERE ks > CAST(0.718 AS DOUBLE) GROUP BY id1, id2, k1),
r(id1, id2, k, used, matched, sim, w, m) AS (SELECT id1, id2, 0, CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]), 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT FROM pairs
  UNION ALL SELECT id1, id2, k + 1, CASE WHEN h IS NULL THEN used ELSE list_append(used, h.k2) END, CASE WHEN h IS NULL THEN matched ELSE list_append(matched, h.key1) END,
    sim + coalesce(h.ks * h.vs, 0), w + coalesce(h.ks, 0), m + CASE WHEN h IS NULL THEN 0 ELSE 1 END
  FROM (SELECT r.*, list_filter(found, lambda f: NOT list_contains(used, f.k2))[1] AS h FROM r LEFT JOIN hits ON hits.id1 = r.id1 AND hits.id2 = r.id2 AND hits.k1 = r.k + 1 WHERE r.k < 5)),
greedy AS (SELECT * FROM r WHERE k = 5),
w1 AS (SELECT id1, id2, list_distinct(flatten(list(mw))) AS a FROM greedy JOIN fg ON fg.id = id1 WHERE NOT list_contains(matched, key) GROUP BY id1, id2),
w2 AS (SELECT id1, id2, list_distinct(flatten(list(mw))) AS b FROM greedy JOIN fg ON fg.id = id2 WHERE NOT list_contains(used, fg.k) GROUP BY id1, id2),
blocks AS (SELECT p.id1, p.id2, x.shop = y.shop OR lower(x.brand) <> lower(y.brand) OR x.res <> y.res AS blocked FROM pairs p JOIN parts x ON x.id = p.id1 JOIN parts y ON y.id = p.id2),
ovl AS (SELECT id1, id2, blocked, {_jaccard("coalesce(a, CAST([] AS VARCHAR[]))", "coalesce(b, CAST([] AS VARCHAR[]))")} AS overlap FROM blocks LEFT JOIN w1 USING (id1, id2) LEFT JOIN w2 USING (id1, id2))"""


_TITLE_SIM = """tblend AS (SELECT id1, id2, cos, coalesce(unlike, FALSE) AS unlike, coalesce(alike, FALSE) AS alike, coalesce(strict, 0) AS strict,
  CAST(0.859 AS DOUBLE) * cos + (1 - CAST(0.859 AS DOUBLE)) * coalesce(lenient, 0) AS s FROM cosine LEFT JOIN ws USING (id1, id2)),
tsim AS (SELECT id1, id2, CASE WHEN cos > CAST(0.558 AS DOUBLE) THEN 1.0 WHEN unlike THEN -1.0 WHEN alike THEN CAST(0.19 AS DOUBLE) * strict + (1 - CAST(0.19 AS DOUBLE)) * s ELSE s END AS t FROM tblend)"""


_SCORED = """scored AS (SELECT id1, id2, CASE WHEN blocked THEN 0.0 WHEN t = -1 THEN m / 5.0::DOUBLE * mean + (1 - m / 5.0::DOUBLE) * overlap
  ELSE (1 - mu) * m / 5 * mean + (1 - mu - (1 - mu) * m / 5) * overlap + mu * t END AS sim
  FROM (SELECT g.id1, g.id2, o.blocked, t.t, g.m, CASE WHEN g.w = 0 THEN 0 ELSE g.sim / g.w END AS mean, o.overlap, CAST(0.819 AS DOUBLE) AS mu FROM greedy g JOIN ovl o USING (id1, id2) JOIN tsim t USING (id1, id2)))"""
# average linkage, a merge for each brand and type at a time; unless a pair is given, two clusters are no candidates
_LINKAGE = f"""near AS (SELECT least(x, y) AS n1, greatest(x, y) AS n2 FROM (SELECT p_partkey AS x, unnest([lead(p_partkey, 1) OVER w, lead(p_partkey, 2) OVER w, lead(p_partkey, 3) OVER w]) AS y
  FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey)) WHERE y IS NOT NULL),
{_greedy("y.id = n2", "near JOIN parts x ON x.id = n1 JOIN parts y")}, {_COSINE}, {_WORD_PAIRS}, {_TITLE_SIM}, {_SCORED},
g(step, comp, id, label) AS (SELECT 0, brand || '|' || type, id, id FROM parts WHERE id IN (SELECT id1 FROM scored UNION ALL SELECT id2 FROM scored)
  UNION ALL SELECT g.step + 1, g.comp, g.id, CASE WHEN g.label = best.m.b THEN best.m.a ELSE g.label END FROM g JOIN (
    SELECT comp, min({{'d': d, 'a': a, 'b': b}}) AS m FROM (SELECT e.comp, a, b, round((given + x.n * y.n - e.n) / (x.n * y.n), 12) AS d
      FROM (SELECT x.comp, least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, sum(1 - sim) AS given, count(*) AS n
        FROM scored JOIN g x ON x.id = id1 JOIN g y ON y.id = id2 WHERE x.label <> y.label GROUP BY ALL) e
      JOIN (SELECT label, count(*) AS n FROM g GROUP BY label) x ON x.label = a JOIN (SELECT label, count(*) AS n FROM g GROUP BY label) y ON y.label = b)
    WHERE d < CAST(0.454 AS DOUBLE) GROUP BY comp) best ON best.comp = g.comp),
found AS (SELECT id, label AS cluster_id, n FROM (SELECT id, label, count(*) OVER (PARTITION BY label) AS n FROM (SELECT id, arg_max(label, step) AS label FROM g GROUP BY id)) WHERE n > 1)"""


def _oob() -> str:
    return ", ".join(f"({seed}, {k})" for seed in range(3) for k in sampling.out_of_bag_positions(25, seed))


_METRICS = """SELECT n_comp, round({f1}, 6) AS f1, round(CASE WHEN pq + pc = 0 THEN 0 ELSE 2 * pq * pc / (pq + pc) END, 6) AS f1_star, round(pc, 6) AS pc, round(pq, 6) AS pq, round(frac, 6) AS frac_comp
FROM (SELECT n_comp, CASE WHEN n_comp > 0 THEN hit::DOUBLE / n_comp ELSE 0 END AS pq, CASE WHEN n_true > 0 THEN hit::DOUBLE / n_true ELSE 0 END AS pc, n_comp / (n * (n - 1)::DOUBLE / 2) AS frac
FROM (SELECT (SELECT count(*) FROM cands) AS n_comp, (SELECT count(*) FROM truth) AS n_true, (SELECT count(*) FROM cands JOIN truth USING (id1, id2)) AS hit, (SELECT count(*) FROM docs) AS n))"""
_TRUTH = "truth AS (SELECT x.id AS id1, y.id AS id2 FROM docs x JOIN docs y ON x.true_model_id = y.true_model_id AND x.id < y.id)"

ORACLES: dict[str, str] = {
    "near_duplicate_pairs": f"""WITH {_FULL_LSH}, sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT id1, id2, count(*) AS n FROM reps JOIN shingles x ON x.id = id1 JOIN shingles y ON y.id = id2 AND y.shingle = x.shingle GROUP BY id1, id2)
SELECT c.id1, c.id2, round(coalesce(m.n, 0)::DOUBLE / (x.n + y.n - coalesce(m.n, 0)), 6) AS jaccard FROM reps c JOIN sizes x ON x.id = c.id1 JOIN sizes y ON y.id = c.id2 LEFT JOIN common m ON m.id1 = c.id1 AND m.id2 = c.id2""",
    "clean_text": f"WITH {_DOCS} SELECT id, {_CLEAN} AS cleaned FROM docs",
    "char_shingles": f"WITH {_DOCS}, {_SHINGLES} SELECT id, shingle FROM shingles",
    "shingle_df": f"WITH {_DOCS}, {_SHINGLES} SELECT shingle, count(*) AS df FROM shingles WHERE NOT short GROUP BY shingle",
    "stop_shingles": f"WITH {_DOCS}, {_SHINGLES}, {_STOPS} SELECT shingle, df FROM stops",
    "pruned_shingles": f"WITH {_DOCS}, {_SHINGLES}, {_STOPS} SELECT id, shingle FROM shingles WHERE short OR shingle NOT IN (SELECT shingle FROM stops)",
    "title_model_words": f"WITH {_PARTS}, {_TITLES} SELECT id, word FROM twords",
    "attr_model_words": f"WITH {_PARTS}, {_VALUES} SELECT id, word FROM vwords",
    "brand_words": f"WITH {_PARTS} SELECT id, lower(brand) AS word FROM parts",
    "hybrid_features": f"""WITH {_PARTS}, {_TITLES}, {_VALUES}, words AS (SELECT id, word FROM twords UNION SELECT id, word FROM vwords UNION SELECT id, lower(brand) FROM parts),
docs AS (SELECT id, title FROM parts), {_SHINGLES}, {_STOPS}
SELECT id, shingle AS feature FROM shingles WHERE short OR shingle NOT IN (SELECT shingle FROM stops)
UNION SELECT id, 'MW_' || word || '_' || i FROM words, range(2) r(i) WHERE i = 0 OR (regexp_matches(word, '[a-zA-Z]') AND regexp_matches(word, '[0-9]'))""",
    "feature_hash": f"WITH {_DOCS}, {_SHINGLES}, {_CRC} SELECT shingle, x AS hash FROM hashed",
    "minhash_signature": f"WITH {_DOCS}, {_SHINGLES}, {_CRC}, {_SIGS} SELECT id, CAST(position AS INTEGER) AS position, value FROM sigs",
    "lsh_candidates": f"WITH {_FULL_LSH} SELECT id1, id2 FROM reps",
    "lsh_classes": f"WITH {_FULL_LSH} SELECT id, rep FROM member",
    "lsh_pair_rows": "SELECT 'sweep' AS kind, b AS bands, 200 // b AS rows FROM range(2, 201) r(b) WHERE 200 // b <> 1 UNION ALL SELECT 'tuning', b, 200 // b FROM range(1, 201) r(b) WHERE 200 % b = 0",
    "token_cosine": f"WITH {_PARTS}, {_PAIR}, {_COSINE} SELECT id1, id2, round(cos, 6) AS sim FROM cosine",
    "kgram_jaccard": f"""WITH {_PARTS}, {_PAIR}, g AS (SELECT id1, id2, list_distinct(list_transform(range(1, length(t1) - 1), lambda i: substr(t1, CAST(i AS INTEGER), 3))) AS a,
  list_distinct(list_transform(range(1, length(t2) - 1), lambda i: substr(t2, CAST(i AS INTEGER), 3))) AS b FROM pairs)
SELECT id1, id2, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS sim FROM g""",
    "norm_levenshtein": f"WITH {_PARTS}, {_PAIR} SELECT id1, id2, round({_NLEV.format('t1', 't2')}, 6) AS dist FROM pairs",
    "alnum_split": f"WITH {_PARTS} SELECT id, word, regexp_replace(word, '[0-9]', '', 'g') AS letters, regexp_replace(word, '[^0-9]', '', 'g') AS digits FROM (SELECT DISTINCT id, unnest({_TITLE_WORD}) AS word FROM parts)",
    "weighted_mw": f"WITH {_PARTS}, {_PAIR}, {_WORD_PAIRS} SELECT id1, id2, round(coalesce(lenient, 0), 6) AS lenient, round(coalesce(strict, 0), 6) AS strict FROM pairs LEFT JOIN ws USING (id1, id2)",
    "title_comp": f"""WITH {_PARTS}, {_PAIR}, {_COSINE}, {_WORD_PAIRS}, b AS (SELECT id1, id2, cos, coalesce(unlike, FALSE) AS unlike, coalesce(alike, FALSE) AS alike, coalesce(strict, 0) AS strict,
  CAST(0.859 AS DOUBLE) * cos + (1 - CAST(0.859 AS DOUBLE)) * coalesce(lenient, 0) AS s FROM cosine LEFT JOIN ws USING (id1, id2))
SELECT id1, id2, round(CASE WHEN cos > CAST(0.558 AS DOUBLE) THEN 1.0 WHEN unlike THEN -1.0 WHEN alike THEN CAST(0.19 AS DOUBLE) * strict + (1 - CAST(0.19 AS DOUBLE)) * s ELSE s END, 6) AS sim FROM b""",
    "brands": f"""WITH {_PARTS}, known AS (SELECT DISTINCT lower(p_brand) AS b FROM part)
SELECT id, CASE WHEN id % 2 = 0 THEN lower(brand) ELSE coalesce((SELECT b FROM known WHERE regexp_matches(lower(title), '\\b' || regexp_escape(b) || '\\b') ORDER BY length(b) DESC, b LIMIT 1), 'na') END AS brand FROM parts""".replace("\\\\", "\\"),
    "resolutions": f"WITH {_PARTS} SELECT id, res AS resolution FROM parts",
    "block_checks": f"""WITH {_PARTS}, steps(s) AS (VALUES (4), (1), (25))
SELECT x.id AS id1, y.id AS id2, CASE WHEN x.shop = y.shop THEN 'shop' WHEN lower(x.brand) <> lower(y.brand) THEN 'brand' WHEN x.res <> y.res THEN 'resolution' END AS reason FROM parts x, steps JOIN parts y ON y.id = x.id + s""",
    "components": """WITH RECURSIVE e AS (SELECT p_partkey AS u, min(p_partkey) OVER (PARTITION BY p_name, p_size) AS v FROM part
  UNION ALL SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) FROM part),
g AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
r(node, reached) AS (SELECT u, u FROM g UNION SELECT r.node, g.v FROM r JOIN g ON g.u = r.reached)
SELECT node, min(reached) AS component FROM r GROUP BY node""",
    "true_pairs": f"WITH {_DOCS} SELECT id, min(id) OVER c AS class_id, count(*) OVER c - 1 AS n_links FROM docs WINDOW c AS (PARTITION BY true_model_id)",
    "transitive_pairs": """WITH RECURSIVE e AS (SELECT p_partkey AS u, lag(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS v FROM part),
r(id, reached) AS (SELECT DISTINCT u, u FROM (SELECT u FROM e WHERE v IS NOT NULL UNION ALL SELECT v FROM e WHERE v IS NOT NULL) UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reached AND e.v IS NOT NULL),
c AS (SELECT id, min(reached) AS class_id FROM r GROUP BY id)
SELECT id, class_id, count(*) OVER (PARTITION BY class_id) - 1 AS n_links FROM c""",
    "pair_metrics": f"WITH {_FULL_LSH}, {_TRUTH} " + _METRICS.format(f1="CASE WHEN pq + pc = 0 THEN 0 ELSE 2 * pq * pc / (pq + pc) END"),
    "bootstrap_oob": f"WITH o(seed, id) AS (VALUES {_oob()}) SELECT CAST(seed AS INTEGER) AS seed, CAST(n_nationkey AS BIGINT) AS id FROM o JOIN nation ON n_nationkey = id",
    "grid_configs": """SELECT CAST(row_number() OVER (ORDER BY mw, stop, b) - 1 AS INTEGER) AS config_id, CAST(b AS INTEGER) AS "Bands", CAST(200 // b AS INTEGER) AS "Rows", CAST(b * (200 // b) AS INTEGER) AS "Signatures",
CAST(0.528 AS DOUBLE) AS "Threshold", 4 AS "Shingle_Size", mw AS "MW_Weight", CAST(stop AS DOUBLE) AS "Stop_Freq", CAST(0.718 AS DOUBLE) AS "Gamma", CAST(0.454 AS DOUBLE) AS "Epsilon", CAST(0.819 AS DOUBLE) AS "Mu",
CAST(0.558 AS DOUBLE) AS "Alpha", CAST(0.859 AS DOUBLE) AS "Beta", CAST(0.190 AS DOUBLE) AS "Delta" FROM range(2, 201) r(b), (VALUES (0), (2)) m(mw), (VALUES (0.0138), (1.0)) s(stop) WHERE 200 // b <> 1""",
    "grid_summary": "SELECT p_size AS \"Bands\", CAST(length(p_type) AS INTEGER) AS \"Rows\", " + ", ".join(
        f'round(avg((p_partkey % {n}) / {n}.0::DOUBLE), 6) AS "{name}"' for n, name in ((97, "Mean_F1"), (89, "Mean_F1_star"), (83, "Mean_PQ"), (79, "Mean_PC"), (73, "Frac_Comps"))
    ) + " FROM part GROUP BY p_size, length(p_type)",
    "key_value_match": f"WITH RECURSIVE {_PARTS}, {_greedy('y.id = x.id + 1')} SELECT id1, id2, round(sim, 6) AS sim, round(w, 6) AS w, m, array_to_string(list_sort(matched), '|') AS matched FROM greedy",
    "mw_overlap": f"WITH RECURSIVE {_PARTS}, {_greedy(_LIKE)} SELECT id1, id2, CASE WHEN NOT blocked THEN round(overlap, 6) END AS overlap FROM ovl",
    "pair_similarity": f"""WITH RECURSIVE {_PARTS}, {_greedy(_LIKE)}, {_COSINE}, {_WORD_PAIRS}, {_TITLE_SIM}, {_SCORED}
SELECT id1, id2, round(sim, 6) AS sim, round(1 - sim, 6) AS dist FROM scored""",
    "part_clusters": f"WITH RECURSIVE {_PARTS}, {_LINKAGE} SELECT id, cluster_id FROM found",
    "part_cluster_pairs": f"WITH RECURSIVE {_PARTS}, {_LINKAGE} SELECT id, cluster_id AS class_id, n - 1 AS n_links FROM found",
    "part_cluster_metrics": f"""WITH RECURSIVE {_PARTS}, {_LINKAGE},
cands AS (SELECT id1, id2 FROM scored), predicted AS (SELECT x.id AS id1, y.id AS id2 FROM found x JOIN found y ON x.cluster_id = y.cluster_id AND x.id < y.id), docs AS (SELECT id, true_model_id FROM parts), {_TRUTH},
h AS (SELECT coalesce(count(t.id1)::DOUBLE / nullif(count(*), 0), 0) AS p, coalesce(count(t.id1)::DOUBLE / nullif((SELECT count(*) FROM truth), 0), 0) AS r FROM predicted q LEFT JOIN truth t USING (id1, id2))
""" + _METRICS.format(f1="(SELECT CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END FROM h)"),
    "json_products": f"WITH {_PARTS}, {_FEATS} SELECT dense_rank() OVER (ORDER BY id) - 1 AS id, true_model_id, title, shop, k - 1 AS place, key, value FROM feats JOIN parts USING (id)",
    "model_curves": " UNION ALL ".join(
        f"SELECT '{model}' AS model, " + ", ".join(f'round(avg((p_partkey % {n}) / {n}.0::DOUBLE), 6) AS "{name}"' for n, name in zip(primes, ("Frac_Comps", "Mean_F1", "Mean_F1_star"))) + " FROM part GROUP BY p_size, length(p_type)"
        for model, primes in (("full", (73, 97, 89)), ("restricted", (53, 71, 67)))
    ),
}
