"""DuckDB SQL for the corpus queries that SQL can express, written from what they compute."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _url_levels(i: int) -> str:
    """What merges below the prefixes of one level: shares in order, each against the group before it."""
    keys = ", ".join(["host", *[f"t{k}" for k in range(i)]])
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    pooled = "((gb + r.b) / (gn + r.n)::DOUBLE)"
    z = f"abs(gb / gn::DOUBLE - r.b / r.n::DOUBLE) / sqrt(greatest({pooled} * (1 - {pooled}), 1e-9) * (1.0::DOUBLE / gn + 1.0::DOUBLE / r.n))"
    return f"""
b{i} AS (SELECT {keys}, s{i} AS s, sum(bad) AS b, sum(bad + good) AS n, count(*) OVER (PARTITION BY {keys}) AS kids FROM tree{i} WHERE s{i} <> chr(1) GROUP BY {keys}, s{i}),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY b / n::DOUBLE, s) AS k FROM b{i} WHERE n >= 5 AND kids <= 64),
f{i} AS (SELECT {keys}, k, s, b AS gb, n AS gn, 1 AS g FROM r{i} WHERE k = 1 UNION ALL SELECT {", ".join("r." + k for k in keys.split(", "))}, r.k, r.s, CASE WHEN {z} < 2 THEN gb + r.b ELSE r.b END, CASE WHEN {z} < 2 THEN gn + r.n ELSE r.n END, CASE WHEN {z} < 2 THEN g ELSE g + 1 END FROM f{i} f JOIN r{i} r ON {same("f", "r")} AND r.k = f.k + 1),
g{i} AS (SELECT {keys}, g, count(*) AS members, '{{' || string_agg(s, '|' ORDER BY s) || '}}' AS merged, max(g) OVER (PARTITION BY {keys}) AS groups FROM f{i} GROUP BY {keys}, g),
w{i} AS (SELECT DISTINCT {keys} FROM b{i} WHERE kids > 64 UNION SELECT {keys} FROM g{i} WHERE groups = 1 AND members > 1),
n{i} AS (SELECT f.*, merged FROM f{i} f JOIN g{i} g ON {same("f", "g")} AND f.g = g.g WHERE groups > 1 AND members > 1),
tree{i + 1} AS (SELECT t.*, CASE WHEN t.s{i} <> chr(1) AND w.host IS NOT NULL THEN '*' ELSE coalesce(merged, t.s{i}) END AS t{i} FROM tree{i} t LEFT JOIN w{i} w ON {same("t", "w")} LEFT JOIN n{i} n ON {same("t", "n")} AND t.s{i} = n.s),"""


def urls() -> str:
    rules = [("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"), ("net/", "net", "/", "block")]  # longest first
    pick = lambda k: "CASE " + " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{r[k]}'" for r in rules) + " END"
    shape = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]+([._-][0-9]+)*(\\.[A-Za-z]{{2,5}})?') OR (regexp_matches({x}, '[0-9]') AND (regexp_full_match({x}, '[0-9a-f-]{{8,}}') OR length({x}) >= 16)) THEN '*' ELSE {x} END"
    segments = ", ".join([*[f"CASE WHEN path <> '' AND len(parts) > {i} THEN {shape(f'parts[{i + 1}]')} ELSE chr(1) END AS s{i}" for i in range(4)], "CASE WHEN len(parts) > 4 THEN '*' ELSE chr(1) END AS s4"])
    keys = "host, s0, s1, s2, s3, s4"
    ways = ", ".join(f"concat_ws('/', {', '.join(f't{k}' for k in range(i + 1))})" for i in range(5))
    nodes = "host, t0, t1, t2, t3, t4"
    return rf"""WITH RECURSIVE a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
sp AS (SELECT *, {pick(0)} AS rule, {pick(3)} AS said, string_split(regexp_replace(path, '^/', ''), '/') AS parts, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\.[A-Za-z]{{2,5}})?/?$', 1), '') AS BIGINT) AS document FROM hp),
sg AS (SELECT page_id, host, path, rule, said, document, {segments} FROM sp),
lab AS (SELECT doc_id AS document, max(greatest(1 - quality, toxic)) AS mark FROM labels WHERE doc_id >= 0 GROUP BY 1 HAVING mark IS NOT NULL),
tree0 AS (SELECT {keys}, count(*) FILTER (mark = 1) AS bad, count(*) FILTER (mark = 0) AS good FROM sg LEFT JOIN lab USING (document) GROUP BY ALL),{''.join(_url_levels(i) for i in range(5))}
leaf AS (SELECT {nodes}, sum(bad) AS bad, sum(bad + good) AS n, [{ways}] AS way FROM tree5 GROUP BY ALL),
ways AS (SELECT host, bad, n, way[5] AS leaf, unnest(way) AS node, generate_subscripts(way, 1) AS depth FROM leaf),
node AS (SELECT host, depth, node, sum(bad) AS bad, sum(n) AS n FROM ways GROUP BY ALL HAVING sum(n) >= 5),
best AS (SELECT w.host, w.leaf, arg_max(d.bad, w.depth) AS bad, arg_max(d.n, w.depth) AS n FROM ways w JOIN node d USING (host, depth, node) GROUP BY ALL),
hosts AS (SELECT host, (sum(bad) + 8 * (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) FROM leaf)) / (sum(n) + 8) AS at_host FROM leaf GROUP BY 1),
judged AS (SELECT {nodes}, CASE WHEN best.n IS NULL THEN at_host ELSE (best.bad + 8 * at_host) / (best.n + 8) END AS p, best.n AS own FROM leaf JOIN hosts USING (host) LEFT JOIN best ON best.host = leaf.host AND best.leaf = leaf.way[5])
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN own IS NOT NULL AND p - 1.645::DOUBLE * sqrt(p * (1 - p) / (own + 8)) >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict,
'/' || array_to_string(list_filter([t0, t1, t2, t3, t4], lambda x: x <> chr(1)), '/') AS template, round(p, 6) AS purity
FROM sg JOIN tree5 USING ({keys}) JOIN judged USING ({nodes})"""


KINDS = [  # kind, pattern, least length, group of the counted length
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    ("access", "AKIA[A-Z0-9]+", 16, 0),
    ("hex", "[0-9a-f]+", 32, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,.\\\x20\x09\x0a\x0d]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\x0d?\x0a|\\n)[A-Za-z0-9+/=]{40,})*)", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("forge_token", "gh[oprsu]_[A-Za-z0-9]+", 40, 0),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 15, 0),
    ("url_login", "://[A-Za-z0-9._-]+:[A-Za-z0-9._~-]+@", 0, 0),
]


def secrets() -> str:
    each = []
    for no, (kind, pattern, least, group) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        each.append(f"SELECT doc_id, {no} AS no, '{kind}' AS kind, {least} AS least, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS sizes, list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS counted FROM d")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(each)}),
x AS (SELECT doc_id, no, kind, least, unnest(sizes) AS size, unnest(counted) AS counted, generate_subscripts(sizes, 1) AS i, gaps, sizes FROM m WHERE len(sizes) > 0),
s AS (SELECT doc_id, no, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0))::BIGINT AS a, size FROM x WHERE counted >= least),
w AS (SELECT doc_id, no, a, kind || ':' || a || ':' || (a + size) AS said FROM s),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, coalesce(string_agg(said, ',' ORDER BY a, no) FILTER (no < 3), '') AS base, string_agg(said, ',' ORDER BY a, no) AS spans, count(*) FILTER (no > 2) AS n_extra FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_extra, 0) AS n_extra FROM d LEFT JOIN g USING (doc_id)"""


def archive() -> str:
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> {5 * (7 - j)}) & 31)::INT + 1, 1)" for k in range(4) for j in range(8))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, t, strlen(t)::BIGINT AS n, sha1(t) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM h)
SELECT page_id, n AS payload_bytes, {digits} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""


def near_dup() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
k AS (SELECT g, count(*) AS often FROM e GROUP BY 1),
o AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY often, g) AS pos FROM e JOIN k USING (g) JOIN n USING (doc_id)),
x AS (SELECT doc_id, g, n FROM o WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
l AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 180 * len(list_intersect(sa.s, sb.s)) >= 80 * (len(sa.s) + len(sb.s))),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""


def rules() -> str:
    bin_ = lambda num, den: f"least(63, floor({num}::DOUBLE / greatest({den}, 1) * 64))::INT"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: i)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
often AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS k FROM often) GROUP BY 1),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^!?|]', '', 'g')) AS marks, len(lines) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lang, '-') AS stratum, [{bin_('n_symbols', 'n_words')}, {bin_('upper', 'word_chars')}, {bin_('marks', 'n_words')}, {bin_('n_repeat_words', 'n_words')}, {bin_('n_dup_lines', 'n_lines')}] AS bins FROM m),
lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
known AS (SELECT doc_id, unnest([stratum, 'the pool']) AS s, quality = 1 AS good, bins FROM f JOIN lab USING (doc_id) WHERE NOT base_failed),
cells AS (SELECT s, rule, bins[rule] AS cell, count(*) AS n FROM known CROSS JOIN range(1, 6) r(rule) WHERE NOT good GROUP BY ALL),
worth AS (SELECT s, rule, cell, max(cell * over_) OVER (PARTITION BY s, rule ORDER BY cell) AS worth FROM (SELECT *, sum(n) OVER (PARTITION BY s, rule ORDER BY cell DESC) AS over_ FROM cells)),
steps AS (SELECT s, rule, cell, row_number() OVER (PARTITION BY s ORDER BY worth DESC, cell DESC, rule) AS k FROM worth WHERE cell > 0),
hit AS (SELECT doc_id, known.s, good, min(k) AS k FROM known JOIN steps ON steps.s = known.s AND bins[rule] >= cell GROUP BY ALL),
size AS (SELECT s, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad FROM known GROUP BY 1),
strata AS (SELECT s, n_good, row_number() OVER (ORDER BY n_good DESC, s) AS pos FROM size WHERE s <> 'the pool'),
tested AS (SELECT coalesce(max(pos) FILTER (n_good >= ceil(ln(0.05::DOUBLE / (pos + 1)) / ln(0.98::DOUBLE))), 0) AS n FROM strata),
walk AS (SELECT s, steps.k, rule, cell, n_good, n_bad, (SELECT count(*) FROM hit WHERE hit.s = steps.s AND good AND hit.k <= steps.k) AS lost, (SELECT count(*) FROM hit WHERE hit.s = steps.s AND NOT good AND hit.k <= steps.k) AS won FROM steps JOIN size USING (s)),
tail AS (SELECT s, k, rule, cell, won / greatest(n_bad, 1)::DOUBLE - 10 * (lost / n_good::DOUBLE) AS gain, CASE WHEN lost >= n_good THEN 1 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.02::DOUBLE) + (n_good - i) * ln(0.98::DOUBLE)))) END AS p FROM walk WHERE n_good > 0),
ok AS (SELECT * FROM tail t WHERE NOT EXISTS (SELECT 1 FROM tail b WHERE b.s = t.s AND b.k <= t.k AND b.p > 0.05::DOUBLE / ((SELECT n FROM tested) + 1))),
last AS (SELECT s, arg_max(k, (round(gain, 9), -k)) AS k FROM ok GROUP BY s HAVING max(gain) > 1e-12),
cuts AS (SELECT ok.s, rule, min(cell) AS cut FROM ok JOIN last ON ok.s = last.s AND ok.k <= last.k GROUP BY ALL),
uses AS (SELECT stratum, CASE WHEN pos <= (SELECT n FROM tested) THEN stratum ELSE 'the pool' END AS s FROM (SELECT DISTINCT stratum FROM f) LEFT JOIN strata ON s = stratum),
lost AS (SELECT DISTINCT doc_id FROM f JOIN uses USING (stratum) JOIN cuts ON cuts.s = uses.s AND bins[rule] >= cut)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost.doc_id IS NULL AS kept FROM f LEFT JOIN lost USING (doc_id)"""


def _crc(byte_list: str) -> str:
    """CRC-32 of a list of bytes; the table follows from the polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def resample() -> str:
    words = lambda t, i: f"SELECT {i}, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{ALNUM}') AS w FROM {t}"
    grams = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""WITH d AS ({words('documents', 'doc_id')}), b AS ({words('benchmark', 'item_id')}),
f AS (SELECT doc_id, unnest({grams}) AS g FROM d), m AS (SELECT unnest({grams}) AS g FROM b),
each AS (SELECT DISTINCT g FROM (SELECT g FROM f UNION ALL SELECT g FROM m)),
hashed AS (SELECT g, {_crc("list_transform(range(strlen(g)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)")} % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS h FROM each)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN hashed USING (g) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM m JOIN hashed USING (g) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY 1),
w AS (SELECT d.doc_id, len(w) >= 20 AS enters, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
ranked AS (SELECT *, row_number() OVER (ORDER BY enters DESC, score DESC, doc_id) AS k FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN k <= 25 * (SELECT count(*) FROM scored WHERE enters) // 100 THEN k END AS rank FROM ranked"""


def negatives() -> str:
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS vec_id, a.label = o.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score FROM v a JOIN v o ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""


def decontamination() -> str:
    words = lambda t, i: f"SELECT {i}, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{ALNUM}') AS w FROM {t}"
    return rf"""WITH d AS ({words('documents', 'doc_id')}), b AS ({words('benchmark', 'item_id')}),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM n),
sizes AS (SELECT DISTINCT n FROM x),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d JOIN sizes ON len(w) >= n),
o AS (SELECT doc_id, i, n, item_id FROM p JOIN x USING (g, n)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """By query. The others return learnt scores, token ids, stored bytes or greedy packings, which tests hold against plain versions."""
    return {"op2_secrets": secrets(), "op5_rules": rules(), "op6_warc": archive(), "op8_urls": urls(), "op9_near_dup": near_dup(), "op11_resample": resample(), "op12_negatives": negatives(), "op13_contamination": decontamination()}
