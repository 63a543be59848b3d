"""SQL of a second engine for the queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from foldspark.llm import mix, quality, rolling, search

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def _quality() -> str:
    q, n = quality, len(quality.RULES)
    first = [f"{q.GOOD}::DOUBLE AS g"] + [f"{x}::DOUBLE AS {c}{i}" for i in range(n) for c, x in (("a", q.RIGHT_ON_GOOD), ("b", q.RIGHT_ON_BAD))]
    steps = [f"m0 AS (SELECT {', '.join(first)})"]

    def posterior(m: str, p: str) -> str:
        each = [f"CASE WHEN {p}.v{i} > 0 THEN ln({m}.a{i} / (1 - {m}.b{i})) WHEN {p}.v{i} < 0 THEN ln((1 - {m}.a{i}) / {m}.b{i}) ELSE 0 END" for i in range(n)]
        return f"1 / (1 + exp(-(ln({m}.g / (1 - {m}.g)) + {' + '.join(each)})))"

    for k in range(q.ITERATIONS):
        share = lambda right, voted, guess: f"(sum({right}) + ({q.STRENGTH} * sum({voted}) + {q.FEW}) * {guess}) / ({1 + q.STRENGTH} * sum({voted}) + {q.FEW})"
        new = [f"(sum(w) + {q.FEW} * {q.GOOD}) / (sum(n) + {q.FEW}) AS g"]
        for i in range(n):
            new.append(share(f"(v{i} > 0)::INT * w", f"abs(v{i}) * w", q.RIGHT_ON_GOOD) + f" AS a{i}")
            new.append(share(f"(v{i} < 0)::INT * (n - w)", f"abs(v{i}) * (n - w)", q.RIGHT_ON_BAD) + f" AS b{i}")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM (SELECT p.*, n * ({posterior(f'm{k}', 'p')}) AS w FROM p, m{k}))")
    last = posterior(f"m{q.ITERATIONS}", "x")
    failed = f"(n < {q.LEAST_WORDS} OR 100 * repeats > {q.MOST_REPEATED} * n)"
    vote = lambda bad, good: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    rules = [
        vote("n < 60", "n >= 120"), vote("10 * chars < 44 * n OR chars > 6 * n", "10 * chars >= 46 * n AND 2 * chars <= 11 * n"), vote("50 * symbols > n", "symbols = 0"),
        vote("10 * upper_ > chars", "20 * upper_ < chars"), vote("20 * bare > n", "100 * bare <= n"), vote("total >= 4 AND 10 * dup > total", "total >= 4 AND 50 * dup <= total"),
        vote("100 * repeats > 15 * n", "n >= 20 AND 100 * repeats <= 5 * n"), vote("n >= 20 AND (100 * stops < 6 * n OR 100 * stops > 40 * n)", "100 * stops >= 9 * n AND 100 * stops <= 25 * n")]
    count = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))::BIGINT"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
l AS (SELECT doc_id, count(*) AS total, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
e AS (SELECT doc_id, count(*) AS bare FROM (SELECT doc_id, unnest(words) AS word FROM d) WHERE NOT regexp_matches(word, '\\p{{L}}') GROUP BY 1),
t AS (SELECT doc_id, i, words[i : i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM t) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n, length(array_to_string(words, ''))::BIGINT AS chars, {count('#*$%&|<>')} AS symbols, {count('A-Z')} AS upper_, {count('.,;:')} AS stops,
  coalesce(l.total, 0)::BIGINT AS total, coalesce(l.dup, 0)::BIGINT AS dup, coalesce(e.bare, 0)::BIGINT AS bare, coalesce(c.n, 0)::BIGINT AS repeats
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
x AS MATERIALIZED (SELECT *, {', '.join(f'{r} AS v{i}' for i, r in enumerate(rules))} FROM m),
p AS MATERIALIZED (SELECT {', '.join(f'v{i}' for i in range(n))}, count(*) AS n FROM x GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, dup AS n_dup_lines, repeats AS n_repeat_words,
  {failed} AS base_failed, NOT {failed} AND {last} >= {q.KEEP} AS kept, round({last}, 6) AS posterior
FROM x, m{q.ITERATIONS}"""


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
t AS (SELECT doc_id, i, words[i : i + 12] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
o AS (SELECT w, min(doc_id) AS owner FROM t GROUP BY 1),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT t.doc_id, t.i FROM t JOIN o USING (w) WHERE owner < doc_id), (SELECT unnest(range(13)) AS k)),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

_WEIGHT = f"[{', '.join(f'{w}.0' for w in mix.WEIGHTS)}][place % {len(mix.WEIGHTS)} + 1]::DOUBLE"
MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, {_WEIGHT} AS weight, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS rank,
  (total * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
h AS (SELECT arg_min(level, rank) AS held FROM o WHERE cap > weight * level),
t AS (SELECT source, source_size, CASE WHEN held IS NULL THEN cap ELSE least(cap, weight * held) END AS target FROM w, h),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / {float(16**12)!r}::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) * size)::BIGINT AS taken FROM r"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, w[i : i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY 1) k ON k.a = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = d.doc_id"""

def _terms(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM {table}"


SEARCH = f"""
WITH d AS MATERIALIZED ({_terms('(SELECT *, row_number() OVER () AS place FROM documents)', 'place, doc_id')}),
q AS (SELECT DISTINCT item_id, t FROM ({_terms('benchmark', 'item_id')})),
n AS (SELECT place, doc_id, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms FROM n),
f AS (SELECT place, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY t),
m AS (SELECT place, doc_id, 100 - 50 + ((50 * n * documents) // terms) AS m FROM n, s),
p AS (SELECT item_id, m.place, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (place) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM p WHERE score > 0 QUALIFY rank <= {search.TOP}"""


def _middles(x: str) -> str:
    return f"({x}[(len({x}) + 1) // 2] + {x}[len({x}) // 2 + 1])"


ROLLING = f"""
WITH r AS (SELECT click_id, kind, epoch_us(ts) AS us, value,
  row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, ts NULLS FIRST, kind NULLS FIRST, value NULLS FIRST) AS place FROM clicks),
c AS (SELECT click_id, kind, us, CASE WHEN isnan(value) OR abs(value * 100) >= {float(1 << 53)!r} THEN NULL ELSE floor(100 * value + 0.5)::BIGINT END AS c FROM r WHERE place = 1),
d AS (SELECT * FROM c WHERE us IS NOT NULL),
w AS (SELECT *, list_sort(list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY us RANGE BETWEEN {rolling.LENGTH - 1} PRECEDING AND CURRENT ROW)) AS x FROM d),
m AS (SELECT *, {_middles('x')} AS m FROM w),
a AS (SELECT *, list_sort(list_transform(x, lambda v: abs(2 * v - m))) AS y FROM m)
SELECT click_id, kind, coalesce(len(x), 0)::BIGINT AS n, m::BIGINT AS median2, {_middles('y')}::BIGINT AS mad4, 2 * abs(2 * c - m) > 2 * {_middles('y')} AS far FROM a"""

_DIGITS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * k} & 31)::INT, 1)" for i in range(8) for k in range(4))
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, payload_bytes, concat({_DIGITS}) AS payload_digest, CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM p"""

ORACLE = {"op2_quality_rules": _quality(), "op3_substring_dedup": SUBSTRINGS, "op5_source_mix": MIX, "op7_ngram_jaccard_join": JACCARD, "op11_ranked_search": SEARCH, "op12_warc": WARC, "op13_rolling_median": ROLLING}
