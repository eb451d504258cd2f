"""DuckDB SQL giving the rows of those queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
num AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM sh GROUP BY s HAVING count(*) > 1)),
sn AS (SELECT doc_id, k FROM sh JOIN num USING (s)),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sn a JOIN sn b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN sized USING (doc_id)
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (h)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

PERIODIC = rf"""
WITH h AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws, doc_id::VARCHAR AS d FROM documents),
crc AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295::BIGINT, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(range(1, len(d) + 1), lambda i: ord(d[i])::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS h FROM h),
part AS (SELECT doc_id, ws, n, h % 10 = 0 AND n > 0 AS echo, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS q FROM crc),
w AS (SELECT doc_id, n, CASE WHEN echo THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % q + 1] END) ELSE ws END AS ws FROM part),
word AS (SELECT doc_id, n, unnest(ws) AS x, unnest(range(0, n)) AS i FROM w),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
row AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same),
stretch AS (SELECT doc_id, min(i) AS s, count(*) + p AS l, p FROM row GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
run AS (SELECT doc_id, s, l, min(p) AS p FROM stretch GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / p DESC, s, p) = 1)
SELECT d.doc_id, coalesce(listed.n, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, p::BIGINT AS period, (1000 * l // p)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DIVERGENCE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT doc_id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS nl FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(nl) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.nl FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
n AS (SELECT lang, source, sum(c) AS n FROM every GROUP BY lang, source),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n.n + v.v) AS p, 1 + (1000000000::HUGEINT * (nl + 1)) // (v.n + v.v) AS q
      FROM every JOIN n USING (lang, source) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
num AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM sh GROUP BY s HAVING count(*) > 1)),
sn AS (SELECT doc_id, k FROM sh JOIN num USING (s)),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sn a JOIN sn b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN comp USING (doc_id) LEFT JOIN sized USING (doc_id)
"""


def _base(kinds: list[tuple[str, str, str]]) -> str:
    """Counts and digest of fixed patterns: (kind, pattern, condition on a match ``x``), in the order of the contract.

    A match's place follows from what a split at the same matches leaves between them.
    """
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{kind}' AS kind, unnest(xs) AS x, unnest([list_sum([len(p) for p in ps[1:j]]) + coalesce(list_sum([len(y) for y in xs[1:j - 1]]), 0) for j in range(1, len(xs) + 1)])::BIGINT AS a "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS xs, regexp_split_to_array(text, '{pattern}') AS ps FROM t)"
        for i, (kind, pattern, _) in enumerate(kinds)
    )
    good = " OR ".join(f"(kind = '{kind}' AND {condition})" for kind, _, condition in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    shown = ", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, *_ in kinds)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + len(x)), ',' ORDER BY a, k) AS listed FROM m WHERE {good} GROUP BY doc_id)
SELECT doc_id, {shown}, sha256(coalesce(listed, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)
"""


_KEY = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = rf"""(?:{_KEY})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_BASE = _base([("assign", _ASSIGN, f"len(regexp_extract(x, '{_ASSIGN}', 1)) >= 6"), ("access", "AKIA[A-Z0-9]{16,}", "true"), ("hex", "[0-9a-f]{24,}", "true")])
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN j % 2 = 1 THEN d ELSE 2 * d - CASE WHEN d > 4 THEN 9 ELSE 0 END END for d, j in [ord(c) - 48 for c in list_reverse(string_split({_DIGITS}, ''))]]) % 10 = 0"
PII_BASE = _base(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and([len(ltrim(y, '0')) <= 3 AND coalesce(TRY_CAST(y AS HUGEINT), 0) <= 255 for y in string_split(x, '.')])"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15"),
    ]
)
