"""DuckDB SQL that gives the rows of the queries it is keyed by."""

_WORD = r"'[^\x20\x09-\x0D]+'"

_LEADS = ", ".join(f"lead(h, {k}) OVER place AS h{k}" for k in range(1, 10))


def _grams(n: int) -> str:
    rest = "".join(f", h{k}" for k in range(1, n))
    return f"SELECT rid, pos, word, {n} AS n, pos + {n} - 1 <= size AS whole, hash(h{rest}) AS gram FROM leads"


# Words and windows are compared by a 64-bit hash.
OP1 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_WORD}) AS w
  FROM documents),
places AS (SELECT rid, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
hashed AS (SELECT *, hash(word) AS h FROM places),
leads AS (SELECT *, {_LEADS} FROM hashed WINDOW place AS (PARTITION BY rid ORDER BY pos)),
grams AS ({' UNION ALL '.join(_grams(n) for n in (3, 5, 7, 10))}),
counted_grams AS (
  SELECT *, min(pos) OVER (PARTITION BY rid, n, gram, whole) AS first_at, count(*) OVER (PARTITION BY rid, n, gram, whole) AS times
  FROM grams),
hits AS (
  SELECT rid, n, word,
         max(CASE WHEN whole AND (pos > first_at OR (n = 3 AND times > 1)) THEN pos + n - 1 ELSE 0 END)
           OVER (PARTITION BY rid, n ORDER BY pos) >= pos AS hit
  FROM counted_grams),
cover AS (
  SELECT rid, sum(length(word)) FILTER (WHERE n = 3) AS word_chars,
         count(*) FILTER (WHERE n = 3 AND hit) AS n_repeat_words,
         sum(CASE WHEN n = 5 AND hit THEN length(word) ELSE 0 END) AS repeat_chars_5,
         sum(CASE WHEN n = 7 AND hit THEN length(word) ELSE 0 END) AS repeat_chars_7,
         sum(CASE WHEN n = 10 AND hit THEN length(word) ELSE 0 END) AS repeat_chars_10
  FROM hits GROUP BY rid),
lines AS (
  SELECT rid, sum(k) - count(*) AS n_dup_lines, sum((k - 1) * chars) AS dup_line_chars
  FROM (SELECT rid, line, count(*) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
        FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line)
  GROUP BY rid),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(repeat_chars_5, 0)::BIGINT AS repeat_chars_5, coalesce(repeat_chars_7, 0)::BIGINT AS repeat_chars_7,
         coalesce(repeat_chars_10, 0)::BIGINT AS repeat_chars_10
  FROM texts LEFT JOIN cover USING (rid) LEFT JOIN lines USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 20 * word_chars AND 100 * repeat_chars_5 <= 25 * word_chars
          AND 100 * repeat_chars_7 <= 23 * word_chars AND 100 * repeat_chars_10 <= 20 * word_chars AS kept
FROM judged
"""

def _doubled(before: str, after: str, step: int) -> str:
    return f"""{after} AS (
  SELECT *, hash({before}, lead({before}, {step}) OVER (PARTITION BY rid ORDER BY pos)) AS {after}
  FROM {before})"""


OP8 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
places AS (SELECT rid, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
h1 AS (SELECT *, hash(word) AS h1 FROM places),
{_doubled('h1', 'h2', 1)}, {_doubled('h2', 'h4', 2)}, {_doubled('h4', 'h8', 4)}, {_doubled('h8', 'h16', 8)},
{_doubled('h16', 'h32', 16)},
grams AS (
  SELECT rid, pos, word, pos + 34 <= size AS whole,
         hash(h32, lead(h2, 32) OVER (PARTITION BY rid ORDER BY pos), lead(h1, 34) OVER (PARTITION BY rid ORDER BY pos)) AS gram
  FROM h32),
windows AS (SELECT *, count(*) OVER (PARTITION BY gram, whole) AS times FROM grams),
marked AS (
  SELECT rid, pos, word,
         coalesce(max(CASE WHEN whole AND times > 1 THEN pos END) OVER (PARTITION BY rid ORDER BY pos) + 34 >= pos, false) AS gone
  FROM windows),
kept AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def _shrunk(children: str, parent: str, mean: str, out: str) -> str:
    return f"""
{out}_m AS (
  SELECT greatest(1.0, least(1000.0, coalesce(CASE WHEN t > 0 AND (e - s) / t > 0 THEN 1 / ((e - s) / t) - 1 ELSE 1000.0 END, 1000.0))) AS m
  FROM (SELECT sum(pow(bad / n - {parent}, 2) * n) AS e, sum({parent} * (1 - {parent})) AS s,
               sum({parent} * (1 - {parent}) * (n - 1)) AS t FROM {children})),
{out} AS (SELECT *, (bad + m * {parent}) / (n + m) AS {mean}, n + m AS weight FROM {children}, {out}_m)"""


def _bound(mean: str) -> str:
    return f"{mean} - 1.645 * sqrt({mean} * (1 - {mean}) / (weight + 1)) AS bound"


OP10 = f"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
keys AS (
  SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM urls),
hosts AS (
  SELECT host, domain, suffix, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS bad
  FROM keys JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
everything AS (SELECT coalesce(sum(n), 0) + 2.0 AS weight, (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS mean_all FROM suffixes),
suffixes_1 AS (SELECT suffixes.*, mean_all FROM suffixes, everything),
{_shrunk('suffixes_1', 'mean_all', 'mean_suffix', 'suffixes_2')},
domains_1 AS (SELECT domains.*, mean_suffix FROM domains JOIN suffixes_2 USING (suffix)),
{_shrunk('domains_1', 'mean_suffix', 'mean_domain', 'domains_2')},
hosts_1 AS (SELECT hosts.*, mean_domain FROM hosts JOIN domains_2 USING (domain)),
{_shrunk('hosts_1', 'mean_domain', 'mean_host', 'hosts_2')},
judged AS (
  SELECT page_id, k.host, path, coalesce(h.bound, d.bound, s.bound, e.bound) AS bound
  FROM keys k LEFT JOIN (SELECT host, {_bound('mean_host')} FROM hosts_2) h ON h.host = k.host
  LEFT JOIN (SELECT domain, {_bound('mean_domain')} FROM domains_2) d ON d.domain = k.domain
  LEFT JOIN (SELECT suffix, {_bound('mean_suffix')} FROM suffixes_2) s ON s.suffix = k.suffix
  CROSS JOIN (SELECT {_bound('mean_all')} FROM everything) e),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM judged)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP13 = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, left(text, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

_ROUNDS = 5


def _round(i: int) -> str:
    """The vectors assigned to the centroids of round i, and the centroids of round i + 1."""
    return f"""
near_{i} AS MATERIALIZED (
  SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT p.vec_id, c.k, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM points p, centroids_{i} c) GROUP BY vec_id),
centroids_{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM centroids_{i} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
      SELECT k, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (
        SELECT n.k, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS j FROM near_{i} n JOIN points p USING (vec_id)) GROUP BY k, j)
    GROUP BY k) m USING (k))"""


OP12 = f"""
WITH points AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centroids_0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS k, v FROM points ORDER BY sha256('2:' || vec_id) LIMIT 40),
{','.join(_round(i) for i in range(_ROUNDS + 1))},
named AS (SELECT k, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM centroids_{_ROUNDS})
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near_{_ROUNDS} JOIN named USING (k)
"""

SQL = {
    "op1_repetition": OP1, "op7_segment_top_k": OP7, "op8_substring_dedup": OP8,
    "op10_host_reputation": OP10, "op12_laesa_clusters": OP12, "op13_infill": OP13,
}
