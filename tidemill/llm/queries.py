"""The registered queries of the text operators, and their SQL where it can be had."""

from __future__ import annotations

from tidemill.llm import decontaminate, divergence, html_main, lattice_lm, line_dedup, ngram_join, packing, pii, quality, secrets, toxicity, vector_codes, wavelet
from tidemill.llm.common import table


def op3_decontamination(spark, sf_dir):
    return decontaminate.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark, sf_dir):
    return packing.op2(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.op4(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark, sf_dir):
    return secrets.op8(table(spark, sf_dir, "documents"))


def op1_html_main(spark, sf_dir):
    return html_main.op1(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.op10(table(spark, sf_dir, "documents"))


def op6_lattice_lm(spark, sf_dir):
    return lattice_lm.op6(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.op9(table(spark, sf_dir, "documents"))


def op11_wavelet(spark, sf_dir):
    return wavelet.op11(table(spark, sf_dir, "documents"))


def op12_divergence(spark, sf_dir):
    return divergence.op12(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_main": op1_html_main,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_pii": op9_pii,
    "op10_ngram_join": op10_ngram_join,
    "op11_wavelet": op11_wavelet,
    "op12_divergence": op12_divergence,
    "op13_vector_codes": op13_vector_codes,
}

def _lloyd_sql(rounds: int = 4) -> str:
    """Full scans in SQL: x holds components as (r, part, pos, x), c<n> the codebook
    after n rounds, a<n> the assignment by it."""
    assigned = """
a{n} AS MATERIALIZED (
  SELECT r, part, min_by(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT r, x.part, entry, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{n} AS c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL)
  GROUP BY r, part)"""
    updated = """
m{n} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS k FROM x JOIN a{b} USING (r, part) GROUP BY ALL),
c{n} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN k IS NULL THEN x ELSE (s - ((s % k) + k) % k) // k END AS x
  FROM c{b} LEFT JOIN m{n} USING (part, entry, pos))"""
    steps = [assigned.format(n=0)]
    for n in range(1, rounds + 1):
        steps += [updated.format(n=n, b=n - 1), assigned.format(n=n)]
    return f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, (i - 1) // (len(embedding) // 4) AS part, (i - 1) % (len(embedding) // 4) AS pos, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM e, unnest(range(1, len(embedding) + 1)) AS t(i)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM x WHERE r <= 256),
{",".join(steps)},
f AS (
  SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN f USING (r)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS3 = rf"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _lloyd_sql(),
    "op12_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n, v, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p FROM f),
l AS (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM f GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM x WHERE part = 'pair' OR rank <= 50""",
    "op4_line_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, text, string_split(text, chr(10)) AS ls
  FROM documents),
l AS (SELECT r, host, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
c AS (SELECT host, trim(line, ' ') AS k, count(DISTINCT r) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
h AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT host, k FROM c JOIN h USING (host) WHERE pages >= 5 AND pages > 0.05 * total),
x AS (SELECT r, i, line, b.k IS NOT NULL AS gone FROM l LEFT JOIN b ON l.host = b.host AND trim(line, ' ') = b.k),
y AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept
  FROM x GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM d LEFT JOIN y USING (r)""",
    "op3_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS3} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_WORDS3} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op10_ngram_join": rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS sh
  FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.r <> b.r GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
m AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
}
