"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from prefmine.llm import mixing, quality, url_templates

WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


def _double(x: float) -> str:
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def _time(place: str, demand: str) -> str:
    """The inverse of the integrated schedule, as :func:`mixing.training_time`."""
    cases = []
    for i, knots in enumerate(mixing.SCHEDULES):
        inner = []
        for end, start, t0, w0, slope in mixing._segments(knots):
            r = f"greatest({demand} - {_double(start)}, 0e0)"
            t = (f"{_double(t0)} + {r} * 2 / ({_double(w0)} + sqrt(greatest({_double(w0 * w0)} + "
                 f"{_double(slope)} * 2 * {r}, 0e0)))")
            inner.append(f"ELSE {t}" if end == float("inf") else f"WHEN {demand} < {_double(end)} THEN {t}")
        body = " ".join(inner)
        cases.append(f"WHEN {place} % {len(mixing.SCHEDULES)} = {i} THEN " + (f"CASE {body} END" if "WHEN" in body else body[5:]))
    return "CASE " + " ".join(cases) + " END"


MIXING = f"""
WITH d AS (SELECT doc_id, source AS src, {WORDS} AS size,
                  md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
              row_number() OVER (ORDER BY src IS NULL, src) - 1 AS place FROM d GROUP BY src),
s1 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS BIGINT) AS rest,
              CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS free
       FROM s1 WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, rest * weight <= cap * free AS open FROM s2),
lv AS (SELECT CAST(rest AS DOUBLE) / free AS level FROM s3 WHERE open ORDER BY cap / weight, place LIMIT 1),
s4 AS (SELECT src, source_size, place, CASE WHEN open THEN weight * (SELECT level FROM lv) ELSE CAST(cap AS DOUBLE) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS need FROM s5),
p AS (SELECT d.doc_id, d.size, s6.*, CAST(coalesce(sum(d.size) OVER (PARTITION BY s6.place ORDER BY d.ord, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN s6 ON d.src IS NOT DISTINCT FROM s6.src),
f AS (SELECT place, coalesce(sum(size) FILTER (WHERE before + size <= need), 0) AS filled FROM p GROUP BY place),
c AS (SELECT p.place, p.before, abs(p.size - (p.need - f.filled)) AS off, p.need - f.filled AS gap,
             row_number() OVER (PARTITION BY p.place ORDER BY abs(p.size - (p.need - f.filled)), p.before) AS rn
      FROM p JOIN f ON p.place = f.place WHERE p.size > 0 AND p.before + p.size > p.need),
e AS (SELECT place, before AS extra FROM c WHERE rn = 1 AND off < gap),
r AS (SELECT p.*, f.filled, (p.size > 0 AND p.before = e.extra) IS TRUE AS is_extra,
             p.before + p.size <= p.need AND p.need > 0 AS is_last
      FROM p JOIN f ON p.place = f.place LEFT JOIN e ON p.place = e.place),
t AS (SELECT *, whole + CASE WHEN is_last OR is_extra THEN 1 ELSE 0 END AS copies,
             CASE WHEN target > 0 THEN (CASE WHEN whole = 0 AND is_extra THEN filled ELSE before END + size / 2) / target
                  ELSE 0e0 END AS demand FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN round({_time('place', 'demand')}, 9) END AS first_position
FROM t"""

MAXSCORE = """
WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM u WHERE x IS NULL OR NOT isfinite(x)),
c AS (SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS x FROM u WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

def _re(pattern: str) -> str:
    r"""A Python pattern as a SQL string for RE2, whose \w and \W know ASCII alone."""
    return "'" + pattern.replace(r"\W", r"[^\p{L}\p{N}_]").replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''") + "'"


def line_quality(rules: quality.Rules = quality.Rules()) -> str:
    symbols = "len(regexp_extract_all({}, '[#*$%&|<>]'))"
    navigation, boilerplate = (_re("(?i)" + p.pattern) for p in (quality.NAVIGATION, quality.BOILERPLATE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' '
                        || lead(w, 4) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, g FROM g WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1),
cover AS (SELECT g.doc_id, count(DISTINCT g.i + k.k) AS n FROM g JOIN twice USING (doc_id, g), range(0, 5) k(k) GROUP BY g.doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (SELECT doc_id, line, n,
             len(regexp_extract_all(line, {_re(quality.SEPARATORS.pattern)})) > greatest(1, n // 8)
             OR regexp_matches(line, {navigation})
             OR {symbols.format('line')} > {rules.symbols}e0 * n
             OR len(line) - len(replace(line, '!', '')) > 1 + {rules.shouts}e0 * n
             OR (regexp_matches(line, {boilerplate}) AND coalesce(list_sum(list_transform(
                   list_filter(regexp_extract_all(line, {_re(quality.PART.pattern)}), lambda p: regexp_matches(p, {boilerplate})),
                   lambda p: len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')))), 0) >= {rules.boilerplate}e0 * n)
             OR (NOT contains('{quality.TERMINALS}', right(rtrim(rtrim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)),
                                                                 '{quality.CLOSERS.replace("'", "''")}'), 1))
                 AND NOT regexp_matches(line, {_re(quality.SENTENCE.pattern)})) AS fails
      FROM n WHERE n > 0),
x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, CAST(coalesce(sum(n) FILTER (WHERE fails), 0) AS BIGINT) AS lost
      FROM f GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST({symbols.format('t')} AS BIGINT) AS n_symbols, coalesce(x.dup, 0) AS n_dup_lines,
             coalesce(cover.n, 0) AS n_repeat_words, coalesce(x.lost, 0) AS lost_words
      FROM w LEFT JOIN x ON x.doc_id = w.doc_id LEFT JOIN cover ON cover.doc_id = w.doc_id),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_words <= {rules.lost}e0 * n_words AS kept FROM b"""


def url_filter(rules, depth: int = 12, z: float = 2.58, smoothing: float = 8.0, reject: float = 0.5) -> str:
    ending = r"\.[A-Za-z][A-Za-z0-9]{0,4}$"
    name = f"regexp_replace(s, '{ending}', '')"
    tests = ((r"regexp_matches({}, '^\d{{4}}[-_]\d{{2}}([-_]\d{{2}})?$')", "date"), (r"regexp_matches({}, '^\d+$')", "number"),
             (r"regexp_matches({}, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')", "uuid"),
             (r"regexp_matches({0}, '^[0-9a-fA-F]{{8,}}$') AND regexp_matches({0}, '\d')", "hash"),
             (r"regexp_matches({0}, '\d') AND len({0}) >= 12", "mixed"))
    kinds = " ".join(f"WHEN {t.format(name)} THEN '{{{k}}}' || regexp_extract(s, '({ending[:-1]})$', 1)" for t, k in tests)
    fits = lambda r: (f"(host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) "  # noqa: E731
                      f"AND starts_with(path, '{r[r.index('/'):]}')")
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=False)
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in longest) + " END"
    levels = ["t0 AS (SELECT *, '' AS node FROM counts)"]
    for i in range(depth):
        levels.append(f"""
c{i} AS (SELECT host, node, segs[{i + 1}] AS child, sum(n) AS cn, sum(b) AS cb FROM t{i} WHERE len(segs) > {i} GROUP BY 1, 2, 3),
p{i} AS (SELECT host, node, sum(cn) AS pn, sum(cb) AS pb FROM c{i} GROUP BY 1, 2),
o{i} AS (SELECT c.*, CAST(p.pb AS DOUBLE) / p.pn AS p, c.cb - c.cn * (CAST(p.pb AS DOUBLE) / p.pn) AS over
         FROM c{i} c JOIN p{i} p ON p.host = c.host AND p.node = c.node WHERE c.cn > 0 AND p.pb > 0 AND p.pb < p.pn),
a{i} AS (SELECT *, CASE WHEN over > 0 THEN '+' ELSE '-' END AS side, CAST(cb AS DOUBLE) / cn AS share FROM o{i}
         WHERE abs(over) - 0.5e0 > {z}e0 * sqrt(cn * p * (1 - p))),
k{i} AS (SELECT host, node, side, cn, cb, share, count(*) AS kids, min(child) AS name,
                lag(cn) OVER w AS n0, lag(cb) OVER w AS b0 FROM a{i} GROUP BY 1, 2, 3, 4, 5, 6
         WINDOW w AS (PARTITION BY host, node, side ORDER BY share, cn)),
e{i} AS (SELECT *, (CAST(cb AS DOUBLE) + b0) / (cn + n0) AS pool FROM k{i}),
r{i} AS (SELECT *, sum(CASE WHEN share - CAST(b0 AS DOUBLE) / n0 > {z}e0 * sqrt(pool * (1 - pool) * (1e0 / cn + 1e0 / n0)) THEN 1 ELSE 0 END)
                   OVER (PARTITION BY host, node, side ORDER BY share, cn) AS run FROM e{i}),
l{i} AS (SELECT host, node, side, cn, cb, CASE WHEN sum(kids) OVER w = 1 THEN replace(min(name) OVER w, '*', '%2A')
                ELSE '*' || side || CAST(run + 1 AS VARCHAR) END AS branch FROM r{i} WINDOW w AS (PARTITION BY host, node, side, run)),
b{i} AS (SELECT a.host, a.node, a.child, l.branch FROM a{i} a JOIN l{i} l ON l.host = a.host AND l.node = a.node AND l.side = a.side
         AND l.cn = a.cn AND l.cb = a.cb),
t{i + 1} AS (SELECT t.host, t.raw, t.segs, t.n, t.b,
                    t.node || CASE WHEN len(t.segs) <= {i} THEN '' ELSE '/' || coalesce(x.branch, '*') END AS node
             FROM t{i} t LEFT JOIN b{i} x ON x.host = t.host AND x.node = t.node AND x.child = t.segs[{i + 1}])""")
    smooth = f"({{}} + {smoothing}e0 * {{}}) / ({{}} + {smoothing}e0)"
    return f"""
WITH lab AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{url_templates.UPPER}', '{url_templates.LOWER}') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
m AS (SELECT h.*, lab.bad FROM h LEFT JOIN lab ON lab.doc_id =
        TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][A-Za-z]+)?/?$', 1), '') AS BIGINT)),
q AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM m),
e AS (SELECT page_id, host, path, bad, CASE WHEN len(parts) > {depth} THEN error('unroll more levels') ELSE parts END AS parts FROM q),
u AS (SELECT page_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM e),
v AS (SELECT page_id, i, CASE {kinds} ELSE s END AS s FROM u),
y AS (SELECT page_id, list(s ORDER BY i) AS segs, string_agg(s, '/' ORDER BY i) AS raw FROM v GROUP BY page_id),
k AS (SELECT e.page_id, e.host, e.path, e.bad, y.segs, y.raw FROM e JOIN y ON y.page_id = e.page_id),
counts AS (SELECT host, raw, segs, count(bad) AS n, coalesce(sum(CAST(bad AS INTEGER)), 0) AS b FROM k GROUP BY host, raw, segs),
{",".join(levels)},
every AS (SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(b) AS DOUBLE) / sum(n) ELSE 0e0 END AS prior FROM counts),
hosts AS (SELECT host, {smooth.format('sum(b)', '(SELECT prior FROM every)', 'sum(n)')} AS share FROM counts GROUP BY host),
leaf AS (SELECT t.host, t.node, {smooth.format('sum(t.b)', 'any_value(hosts.share)', 'sum(t.n)')} AS share
         FROM t{depth} t JOIN hosts ON hosts.host = t.host GROUP BY t.host, t.node),
z AS (SELECT k.page_id, k.host, k.path, t.node AS template, leaf.share
      FROM k JOIN t{depth} t ON t.host = k.host AND t.raw = k.raw JOIN leaf ON leaf.host = t.host AND leaf.node = t.node)
SELECT page_id, host, path, {case(1)} AS rule,
       coalesce({case(0)}, CASE WHEN share >= {reject}e0 THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(share, 9) AS bad_share FROM z"""


VECTORS = """
WITH RECURSIVE d AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT * FROM d WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                             AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (SELECT a.r AS a, b.r AS b, a.vec_id AS ida, b.vec_id AS idb FROM ok a JOIN ok b
         ON a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.95e0),
reach AS (SELECT DISTINCT a, ida AS id FROM near UNION SELECT near.b, reach.id FROM reach JOIN near ON near.a = reach.a),
least AS (SELECT a, min(id) AS least FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(least, vec_id), vec_id) AS component_id,
       coalesce(vec_id = coalesce(least(least, vec_id), vec_id), false) AS kept
FROM d LEFT JOIN links ON links.a = d.r LEFT JOIN least ON least.a = d.r"""


COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM o CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, 2000000 * k.a // (x.f + y.f) AS score FROM k
      JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
      JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, a, w, size, unnest(range(1, size)) AS i FROM c WHERE size > 2),
h2 AS (SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase, n, size
       FROM h CROSS JOIN (SELECT unnest([2, 3]) AS n) WHERE n < size AND i + n - 1 <= size),
held AS (SELECT lang, phrase, max(a) AS longer FROM h2 GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
e AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN held ON held.lang = b.lang AND held.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT e.lang, CAST(rank AS BIGINT) AS rank, e.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM e JOIN t ON t.lang = e.lang WHERE rank <= 2000"""


# Rules of the registered URL filter: (verdict, host and path).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/"))

ORACLE_SQL = {"op5_line_quality": line_quality(), "op6_mixing": MIXING, "op7_maxscore": MAXSCORE,
              "op10_url_templates": url_filter(URL_RULES), "op11_collocations": COLLOCATIONS,
              "op13_vector_dedup": VECTORS}
