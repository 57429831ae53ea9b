"""Registered queries of the training-data operators, and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from .arc_convert import op6_arc_to_warc
from .fingerprints import op2_syncmer_fingerprints
from .language_id import op5_language_id
from .mixing import op4_mix_sources
from .near_dup import op8_near_dedup
from .packing import op3_pattern_packing
from .pii import op1_personal_data
from .quality_fm import op10_quality_fm
from .quality_rules import op9_host_rules
from .spelling import op11_spelling_variants
from .token_counts import op13_token_counts
from .toxicity import op7_toxicity
from .vector_codes import op12_vector_codes

QUERIES = {f.__name__: f for f in (
    op1_personal_data, op2_syncmer_fingerprints, op3_pattern_packing, op4_mix_sources, op5_language_id,
    op6_arc_to_warc, op7_toxicity, op8_near_dedup, op9_host_rules, op10_quality_fm,
    op11_spelling_variants, op12_vector_codes, op13_token_counts)}

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

def _mix_sql() -> str:
    """Targets by water filling over sources ordered by cap per weight; then prefix sums in key order, pass by pass."""
    from .mixing import NOISE, PASSES, SEED

    head = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len({WORDS.format("text")})::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)
        / greatest(0.05::DOUBLE, (1 - least(1::DOUBLE, (length(text) - length(translate(text, '{NOISE}', '')))::DOUBLE / greatest(size, 1)))
                           * least(1::DOUBLE, (size + 5) / 25::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM k GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 2::DOUBLE END AS weight,
             source_size * 2::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, r) AS pos,
             sum(cap) OVER (ORDER BY cap / weight, r) - cap AS full_before,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, r) + weight AS open_weight FROM w),
v AS (SELECT arg_min(level, pos) AS level FROM (
        SELECT (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM w) - full_before) / open_weight AS level, cap / weight AS c, pos
        FROM o) WHERE level <= c),
t0 AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, v),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM t0),
b0 AS (SELECT source, target - epochs * source_size AS budget FROM t),
c0 AS (SELECT doc_id, source, size FROM k WHERE false)"""
    for i in range(1, PASSES + 1):
        head += f""",
l{i} AS (SELECT k.* FROM k JOIN b{i - 1} b ON b.source IS NOT DISTINCT FROM k.source
         WHERE k.size > 0 {"AND k.size <= b.budget" if i > 1 else ""} AND k.doc_id NOT IN (SELECT doc_id FROM c{i - 1})),
c{i} AS (SELECT * FROM c{i - 1} UNION ALL
         SELECT x.doc_id, x.source, x.size FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM l{i}) x
         JOIN b{i - 1} b ON b.source IS NOT DISTINCT FROM x.source WHERE x.upto <= b.budget),
b{i} AS (SELECT b.source, b.budget - coalesce(u.n, 0) AS budget FROM b0 b
         LEFT JOIN (SELECT source, sum(size)::BIGINT AS n FROM c{i} GROUP BY 1) u ON u.source IS NOT DISTINCT FROM b.source)"""
    return head + f"""
SELECT k.doc_id, k.size, t.source_size, t.target,
       (k.size * (t.epochs + CASE WHEN c.doc_id IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source LEFT JOIN c{PASSES} c ON c.doc_id = k.doc_id"""


def _codes_sql() -> str:
    """Codebooks by unrolled rounds; squared distances are exact in DOUBLE for components of this size."""
    from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

    def nearest(book: str) -> str:
        return f"""SELECT vec_id, r, label, k, min(dist)::BIGINT AS dist, arg_min(i, dist * {ENTRIES} + i) AS i FROM (
    SELECT p.vec_id, p.r, p.label, p.k, b.i, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS dist
    FROM p JOIN {book} b ON b.k = p.k) GROUP BY vec_id, r, label, k"""

    sql = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e,
             row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, r, label, k::INT AS k, e[k * (len(e) // {PARTS}) + 1:(k + 1) * (len(e) // {PARTS})] AS x
                   FROM v, range({PARTS}) t(k)),
b0 AS MATERIALIZED (SELECT k, (r - 1)::INT AS i, x FROM p WHERE r <= {ENTRIES})"""
    for n in range(1, ROUNDS + 1):
        sql += f""",
a{n} AS MATERIALIZED ({nearest(f"b{n - 1}")}),
m{n} AS (SELECT k, i, list(c ORDER BY pos) AS x FROM (
    SELECT a.k, a.i, pos, floor(sum(p.x[pos]) / count(*)) AS c FROM a{n} a JOIN p ON p.r = a.r AND p.k = a.k, range(1, len(p.x) + 1) t(pos)
    GROUP BY a.k, a.i, pos) GROUP BY k, i),
b{n} AS MATERIALIZED (SELECT b.k, b.i, coalesce(m.x, b.x) AS x FROM b{n - 1} b LEFT JOIN m{n} m ON m.k = b.k AND m.i = b.i)"""
    return sql + f""",
f AS MATERIALIZED ({nearest(f"b{ROUNDS}")}),
c AS (SELECT vec_id, r, label, string_agg(lower(format('{{:02x}}', i)), '' ORDER BY k) AS code, sum(dist)::BIGINT AS error FROM f
      GROUP BY vec_id, r, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda c: c::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY k, i))
        FROM b{ROUNDS}) AS codebooks_sha256
FROM c"""


def _spelling_sql() -> str:
    """CRC-32 byte by byte from its table; near pairs by the words left when one code point is deleted."""
    from .spelling import DELETE_EVERY, FORM_RATIO, LEAST_CHARS, LEAST_COUNT, LOWER, UPPER

    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run
         FROM documents),
own AS (SELECT d, run, count(*) AS n FROM runs GROUP BY d, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(d || ':' || run)),
      lambda i: ('0x' || substr(hex(encode(d || ':' || run)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM own, crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM hashed) WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM w, range(length(word)) t(i)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON b.word = a.rest
          UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON b.word = a.rest),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {FORM_RATIO} * w.n THEN near END AS form,
             CASE WHEN near_n >= {FORM_RATIO} * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS at FROM f UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN up ON up.word = f.word JOIN f last ON last.word = up.at AND last.form IS NULL"""


ORACLES = {
    "op11_spelling_variants": _spelling_sql(),
    "op12_vector_codes": _codes_sql(),
    "op4_mix_sources": _mix_sql(),
    "op6_arc_to_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
g AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""",
    "op8_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS sh FROM d),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS v FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(c.v, d.doc_id), d.doc_id) AS component_id,
       coalesce(least(c.v, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id""",
    "op9_host_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY 1),
e AS (SELECT sum(f)::DOUBLE / sum(n) AS m, sum(n)::DOUBLE AS t, count(*) AS hosts, sum(n::DOUBLE * n) AS q FROM h),
x AS (SELECT any_value(m) AS m, CASE WHEN any_value(t - q / t) > 0 THEN (sum(n * pow(f / n - m, 2)) - (any_value(hosts) - 1) * any_value(m * (1 - m)))
        / any_value(t - q / t) ELSE 0 END AS excess FROM h, e),
k AS (SELECT m, CASE WHEN excess > 0 THEN least(1e6, greatest(1, m * (1 - m) / excess - 1)) ELSE 1e6 END AS k FROM x),
p AS (SELECT source, m, f + k * m AS a, n - f + k * (1 - m) AS b FROM h, k),
r AS (SELECT source, a / (a + b) - 2.33 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > least(2 * m, (1 + m) / 2) AS bad FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source""",
}
