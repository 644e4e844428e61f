"""DuckDB SQL for the operators that SQL can express."""

from parley.llm import quality_rules as rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def substring(documents: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM {documents}),
win AS (SELECT doc_id, s, hash(array_to_string(w[s:s+19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM again, range(0, 20) t(k)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def quality(documents: str = "documents") -> str:
    metrics = list(rules.METRICS)
    stacked = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS metric, {m} AS x FROM m WHERE n_words > 0" for m in metrics)
    value = lambda q: f"({rules.UNIT} * (power({rules.GAMMA}::DOUBLE, {q} + 0.5) - 1))"

    qs = rules.QUANTILES

    def level(name: str, keys: list[str]) -> str:
        k = "".join(f"{c}, " for c in keys)
        part = f"PARTITION BY {k}metric"
        found = ", ".join(f"{value(f'min(CASE WHEN upto >= {p} * total THEN b END)')} AS {q}" for q, p in qs.items())
        return f"""{name}_c AS (SELECT {k}metric, b, count(*) AS n FROM b GROUP BY {k}metric, b),
{name}_r AS (SELECT *, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY b) AS upto FROM {name}_c),
{name} AS (SELECT {k}metric, max(total) AS total, {found} FROM {name}_r GROUP BY {k}metric)"""

    cases = "CASE metric " + " ".join(f"WHEN '{m}' THEN {{}}" for m in metrics) + " END"
    above = cases.format(*[f"{a}::DOUBLE" for a, _ in rules.METRICS.values()])
    below = cases.format(*[f"{b}::DOUBLE" if b else "NULL" for _, b in rules.METRICS.values()])
    each = lambda form: ", ".join(form.format(q=q) for q in qs)
    ladder = ", ".join(f"CASE WHEN {q} > q50 THEN 2 * {q} - q50 END" for q, p in qs.items() if p in rules.LADDER)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {documents}),
win AS (SELECT rid, s, array_to_string(w[s:s+7], ' ') AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS s FROM t WHERE len(w) >= 8)),
rep AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, h) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT s + k) AS n FROM rep, range(0, 8) r(k) GROUP BY rid),
e AS (SELECT t.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN cov USING (rid)),
m AS (SELECT rid, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
  coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word FROM e),
x AS ({stacked}),
b AS (SELECT *, floor(ln(1 + x / {rules.UNIT}) / ln({rules.GAMMA}::DOUBLE))::INT AS b FROM x),
{level("own", ["lang", "source"])},
{level("lng", ["lang"])},
{level("every", [])},
lup AS (SELECT lng.lang, lng.metric, lng.total / (lng.total + {rules.PRIOR}::DOUBLE) AS w, {each("lng.{q} AS l{q}")}, {each("every.{q} AS a{q}")} FROM lng JOIN every ON lng.metric = every.metric),
up AS (SELECT lang, metric, {each("w * l{q} + (1 - w) * a{q} AS {q}")} FROM lup),
ow AS (SELECT *, total / (total + {rules.PRIOR}::DOUBLE) AS w FROM own),
bl AS (SELECT ow.lang, ow.source, ow.metric, {each("w * ow.{q} + (1 - w) * up.{q} AS {q}")} FROM ow JOIN up ON ow.lang IS NOT DISTINCT FROM up.lang AND ow.metric = up.metric),
f AS (SELECT lang, source, metric, greatest(CASE WHEN q75 - q25 > 0 THEN q75 + {rules.FENCE} * (q75 - q25) ELSE coalesce({ladder}, {list(qs)[-1]}) END, q75 + {above}) AS hi,
  CASE WHEN {below} IS NULL THEN -1.0 ELSE least(q25 - {rules.FENCE} * (q75 - q25), q25 - {below}) END AS lo FROM bl),
v AS (SELECT x.rid, bool_and(x.x BETWEEN lo AND hi) AS ok FROM x JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND x.metric = f.metric GROUP BY x.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(ok, true) AS kept FROM m LEFT JOIN v USING (rid)"""


def decontamination(documents: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ITEM_WORDS} AS w FROM {documents}),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {ITEM_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s+12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, s, n, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, s, dw.n, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
pos AS (SELECT rid, count(DISTINCT s + j) AS c FROM (SELECT rid, s, unnest(range(0, n)) AS j FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pos.c, 0)::BIGINT AS n_hit, coalesce(its.c, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(pos.c, 0) > 0 AND 20 * coalesce(pos.c, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


def sharding(documents: str = "documents", shards: int = 40) -> str:
    """Jump hashing as a recursive query; CRC-32 by its table, which the polynomial gives."""
    n = shards
    table, two_64 = crc_table(), 1 << 64
    # a text's bytes are cut into blocks, so that no character is sought from the start of a long text
    return rf"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS rid, doc_id, text, (coalesce(strlen(text), 0) + 16)::BIGINT AS size FROM {documents}),
hx AS (SELECT rid, hex(encode(text)) AS h FROM rows_ WHERE text IS NOT NULL),
blk AS (SELECT rid, i, substr(h, i * 4096 + 1, 4096) AS h FROM (SELECT rid, h, unnest(range(0, greatest((length(h) + 4095) // 4096, 1))) AS i FROM hx)),
byt AS (SELECT rid, list(list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT) ORDER BY i) AS b FROM blk GROUP BY rid),
crc AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(b)), lambda c, x: xor(list_extract({table}::BIGINT[], (xor(c, x) & 255) + 1), c >> 8)), 4294967295) AS crc FROM byt),
k AS (SELECT DISTINCT doc_id, (CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + {two_64} ELSE coalesce(doc_id, 0)::HUGEINT END) AS k FROM {documents}),
j(doc_id, k, b, s) AS (
  SELECT doc_id, k, -1::BIGINT, 0::BIGINT FROM k
  UNION ALL
  SELECT doc_id, ((k::UHUGEINT * 2862933555777941757 + 1) % {two_64})::HUGEINT, nxt, CASE WHEN nxt < {n} THEN nxt ELSE s END
  FROM (SELECT *, floor((b + 1) * (2147483648::DOUBLE / (k // 8589934592 + 1)))::BIGINT AS nxt FROM j) WHERE nxt <= {n}),
last AS (SELECT doc_id, max(b) AS grown, max(s) AS shard FROM j GROUP BY doc_id),
spread AS (SELECT greatest(64, ceil(count(*) / ({n} * 200000.0)))::BIGINT AS spread FROM {documents}),
placed AS (SELECT r.doc_id, size, crc, shard, grown, (k + coalesce(crc, 0)) % spread AS part
  FROM rows_ r LEFT JOIN crc USING (rid) JOIN k ON r.doc_id IS NOT DISTINCT FROM k.doc_id JOIN last ON r.doc_id IS NOT DISTINCT FROM last.doc_id, spread)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, crc NULLS FIRST, size) - 1 AS slot, grown::INT AS grown_shard FROM placed"""


def chat(conversations: str = "conversations") -> str:
    """Digests of turns and assistant texts straight from the rows, and the length that the template's marks and escapes give."""
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t,
  replace(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), chr(10), '\n') AS r FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len("<|im_start|>") + 1 + len("<|im_end|>") + 1} + length(t) + length(r))::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def crc_table() -> list[int]:
    """The byte table of CRC-32, which its polynomial gives."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return table


def resampling(documents: str = "documents", percent: int = 10, buckets: int = 10_000) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ITEM_WORDS} AS w FROM {documents}),
dw AS (SELECT rid, unnest(w) AS f FROM d),
dc AS (SELECT rid, f, count(*) AS n FROM dw GROUP BY rid, f),
ds AS (SELECT f, sum(n)::BIGINT AS s FROM dc GROUP BY f),
bt AS (SELECT f, count(*) AS t FROM (SELECT unnest({ITEM_WORDS}) AS f FROM benchmark) GROUP BY f),
dict AS (SELECT f, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(f)) AS h FROM ds FULL JOIN bt USING (f)),
hashed AS (SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
  lambda c, x: xor(list_extract({crc_table()}::BIGINT[], (xor(c, x) & 255) + 1), c >> 8)), 4294967295) % {buckets} AS bucket FROM dict),
b AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
tot AS (SELECT sum(s) + {buckets} AS s, sum(t) + {buckets} AS t FROM b),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((b.t + 1) * tot.s) / ((b.s + 1) * tot.t)))::BIGINT AS gain FROM b, tot),
wt AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM dc JOIN hashed USING (f) JOIN g USING (bucket) GROUP BY rid),
sc AS (SELECT d.rid, doc_id, coalesce(n, 0)::BIGINT AS n_features, len(w) AS n_words, CASE WHEN n IS NULL THEN 0 ELSE floor(total / n::DOUBLE)::BIGINT END AS weight,
  floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS gumbel FROM d LEFT JOIN wt USING (rid)),
rk AS (SELECT rid, row_number() OVER (ORDER BY weight + gumbel DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS total FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN r <= {percent} * total // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (rid)"""


def periodic(documents: str = "documents") -> str:
    """Runs as islands of equal word triples at one distance: a run's matches are three in a row at least."""
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w, hex(encode(doc_id::VARCHAR)) AS h FROM {documents}),
c AS (SELECT rid, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
  lambda x, y: xor(list_extract({crc_table()}::BIGINT[], (xor(x, y) & 255) + 1), x >> 8)), 4294967295) END AS h FROM t),
g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM c),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w[(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1)::INT] ELSE w[(i + 1)::INT] END) ELSE w END AS w FROM g),
tri AS (SELECT rid, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k FROM (SELECT rid, n, w, unnest(range(0, n - 2)) AS i FROM d WHERE n >= 6)),
pair AS (SELECT x.rid, y.i - x.i AS q, x.i FROM tri x JOIN tri y ON x.rid = y.rid AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT rid, q, min(i) AS s, count(*) + 2 + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM pair) GROUP BY rid, q, grp),
run AS (SELECT rid, s, len, min(q) AS q FROM isl WHERE len >= greatest(6, 4 * q) GROUP BY rid, s, len),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM run),
word AS (SELECT rid, unnest(range(0, n)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY len DESC, s, q) AS r FROM run) WHERE r = 1),
every AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN every USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""
