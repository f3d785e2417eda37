"""The dealt operators with production parameters on their whole tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, centroids, decontaminate, divergence, embeddings, html, language, neighbours, pii, quality, sharding, simhash, token_counts
from tracewright.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Bytes of text a shard may hold: small files, so that also the small tables are split.
SHARD_BYTES = 256 << 10


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark, sf_dir):
    return simhash.report(read(spark, sf_dir, "documents"))


@query
def op2_sharding(spark, sf_dir):
    return sharding.assign(read(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def vocabulary() -> str:
    """The public byte-level vocabulary of the check; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_bpe(spark, sf_dir):
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


@query
def op4_language(spark, sf_dir):
    return language.report(read(spark, sf_dir, "documents"))


@query
def op5_html(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


@query
def op6_quality(spark, sf_dir):
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.by_section(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op8_embeddings(spark, sf_dir):
    return embeddings.near_copies(read(spark, sf_dir, "embeddings"))


@query
def op9_pii(spark, sf_dir):
    return pii.digests(pii.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op10_decontamination(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op10_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM n)),
dg AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM n) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, p, win.n FROM dg JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLE["op8_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""



def sharding_sql(limit: int) -> str:
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(bin(('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT), 60, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, bits, unnest(range(0, 61)) AS d FROM r),
b AS (SELECT bits[1:d] AS bucket, sum(n_bytes)::BIGINT AS bytes, count(*) AS n FROM p GROUP BY bucket),
fit AS (SELECT p.doc_id, p.n_bytes, p.d, b.bucket, b.bytes, b.n FROM p JOIN b ON b.bucket = p.bits[1:p.d] WHERE b.bytes <= {limit} OR b.n = 1)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, min_by(bucket, d) AS shard, min(d)::INT AS depth, min_by(bytes, d) AS shard_bytes, min_by(n, d)::BIGINT AS shard_rows
FROM fit GROUP BY doc_id, n_bytes"""


ORACLE["op2_sharding"] = sharding_sql(SHARD_BYTES)


@query
def op13_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


ORACLE["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.*, (1 + (1000000000::HUGEINT * (s.n + 1)) // (s.total + l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 1)) // (l.total + l.v))::BIGINT AS q FROM s JOIN l USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term)
WHERE rank <= 200"""


@query
def op11_centroids(spark, sf_dir):
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out one after the other; components are integers throughout."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
e{r} AS MATERIALIZED (SELECT r, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance, c.c FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT r, min(distance) AS distance, min_by(c, (distance, c)) AS c FROM e{r} GROUP BY r)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT a{r}.c, j, sum(v.x[j])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (r), range(1, 65) t(j) GROUP BY a{r}.c, j),
n{r} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS x FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id::VARCHAR), x LIMIT {k}),{",".join(steps)}
SELECT vec_id, a.c::INT AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} f ON f.c = a.c"""


ORACLE["op11_centroids"] = centroids_sql()


@query
def op12_neighbours(spark, sf_dir):
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))
