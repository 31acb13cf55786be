"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from cellpulse.llm import resample
from cellpulse.llm import url_filter as u


def _level(name: str, key: str, above: str) -> str:
    """CTEs of one level: its moments, strength and posterior, given ``above`` (the prior mean) per row."""
    return f"""
{name}_s AS (SELECT coalesce(sum(n * (bad / n - {above}) * (bad / n - {above}) / ({above} * (1 - {above}))) FILTER (n > 0), 0) AS s,
  count(*) FILTER (n > 0) AS g, coalesce(sum(n) FILTER (n > 0), 0) AS t FROM {name}_in),
{name}_k AS (SELECT (1 - rho) / rho AS k FROM (SELECT least(greatest(
  CASE WHEN g > 0 AND t > g THEN (s - g) / (t - g) ELSE 0.0 END, {u.LEAST_RHO}), {1 - u.LEAST_RHO}) AS rho FROM {name}_s)),
{name}_p AS (SELECT *, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS deviation
  FROM (SELECT *, k * {above} + bad AS a, k * (1 - {above}) + n - bad AS b FROM {name}_in, {name}_k))"""


def url_filter_sql() -> str:
    parts = u.PARTS
    two = ", ".join(f"'{t}'" for t in u.TWO_LABELS)
    fits = [(h + p, a, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for a, h, p in
            sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, _, c in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for _, a, c in fits) + " END"
    return f"""
WITH parsed AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{u.UPPER}', '{u.LOWER}') AS host,
    coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
judged AS (SELECT CAST(doc_id AS VARCHAR) AS shown,
    max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
split AS (SELECT host, string_split(host, '.') AS l, count(j.bad) AS n, coalesce(sum(j.bad), 0)::DOUBLE AS bad
  FROM (SELECT host, regexp_extract(path, '/([1-9][0-9]{{0,17}}|0)(?:\\.[a-z]+)?/?$', 1) AS shown FROM parsed) p
  LEFT JOIN judged j USING (shown) GROUP BY host),
suffixed AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-2:], '.')
    ELSE l[-1] END AS suffix FROM split),
hosts AS (SELECT host, n, bad, suffix, CASE WHEN contains(suffix, '.') THEN array_to_string(l[-3:], '.')
    ELSE array_to_string(l[-2:], '.') END AS domain FROM suffixed),
everywhere AS (SELECT (coalesce(sum(bad), 0) + {u.PRIOR_BAD}) / (coalesce(sum(n), 0) + {u.PRIOR_BAD + u.PRIOR_GOOD}) AS m FROM hosts),
suffix_in AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, m FROM hosts, everywhere GROUP BY suffix, m),{_level("suffix", "suffix", "m")},
domain_in AS (SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, s.mean AS m
  FROM hosts h JOIN suffix_p s USING (suffix) GROUP BY h.domain, h.suffix, s.mean),{_level("domain", "domain", "m")},
host_in AS (SELECT h.host, h.n, h.bad, d.mean AS m FROM hosts h JOIN domain_p d USING (domain)),{_level("host", "host", "m")}
SELECT page_id, host, path, {rule} AS rule,
  coalesce({action}, CASE WHEN mean - {u.DEVIATIONS} * deviation > {u.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS bad_rate, round(mean - {u.DEVIATIONS} * deviation, 6) AS bound
FROM parsed JOIN host_p USING (host)"""


def resample_sql(percent: int = 10, min_words: int = 20, seed: str = "2024", buckets: int = resample.BUCKETS) -> str:
    """Features of one word. The checksum is computed from its polynomial, once per distinct word."""
    words = (f"string_split_regex(translate(coalesce(text, ''), '{u.UPPER}', '{u.LOWER}'), "
             r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
held AS (SELECT r, word FROM (SELECT r, unnest({words}) AS word FROM rows) WHERE word <> ''),
wanted AS (SELECT word FROM (SELECT unnest({words}) AS word FROM benchmark) WHERE word <> ''),
steps AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i,
  list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i))),
hashed AS (SELECT word, xor(4294967295, list_reduce(
    list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(c[(xor(a, b) & 255) + 1], a >> 8), 4294967295)) % {buckets} AS bucket
  FROM (SELECT word FROM held UNION SELECT word FROM wanted), steps),
corpus AS (SELECT bucket, count(*) AS s FROM held JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(
    CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM held) + {buckets}) AS DOUBLE)
    / CAST((s + 1) * ((SELECT count(*) FROM wanted) + {buckets}) AS DOUBLE))) AS BIGINT) AS g
  FROM corpus LEFT JOIN target USING (bucket)),
weighed AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight
  FROM held JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM rows LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {min_words}
  AND place <= (SELECT count(*) FROM scored WHERE n_features >= {min_words}) * {percent} // 100 THEN place END AS rank
FROM placed"""


ORACLE = {"op4_url_filter": url_filter_sql(), "op11_resample": resample_sql()}
