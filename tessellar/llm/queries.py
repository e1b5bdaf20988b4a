"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, html_extract, licenses, media, mixing, negatives, pieces, quality, secrets, toxicity
from .exactdup import exact_duplicates
from .mixing import mix
from .neardup import near_duplicates
from .packing import pack
from .store import table


def op1_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.telephony(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), decoded=True))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.usable(table(spark, sf_dir, "embeddings"))
    return negatives.mine(rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_extract_pages,
        op2_quality,
        op3_mix_sources,
        op4_pack_windows,
        op5_near_duplicates,
        op6_toxicity,
        op7_exact_duplicates,
        op8_secrets,
        op9_telephony,
        op10_licenses,
        op11_sentencepiece,
        op12_hard_negatives,
        op13_centroids,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_words(text: str) -> str:
    return f"[x FOR x IN string_split_regex({_LOWER.format(text)}, '{licenses.BETWEEN}') IF x <> '']"


def _shingles(words: str) -> str:
    return f"[array_to_string({words}[k:k + {licenses.SHINGLE - 1}], ' ') FOR k IN range(1, len({words}) - {licenses.SHINGLE - 2})]"



_TEMPLATES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in sorted(licenses.TEMPLATES.items()))
_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _clusters() -> str:
    """Rounds of assigning and moving, one after another; distances over all components."""
    k = f"range(1, {centroids.DIMS + 1})"
    near = f"SELECT v.row, v.vec_id, v.x, c.k, list_sum([(v.x[p] - c.c[p]) * (v.x[p] - c.c[p]) FOR p IN {k}])::BIGINT AS d FROM v, {{c}} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY d, c.k) = 1"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor({centroids.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) = {centroids.DIMS} AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < {centroids.CENTROIDS})",
    ]
    for n in range(centroids.ROUNDS):
        parts += [
            f"a{n} AS MATERIALIZED ({near.format(c=f'c{n}')})",
            f"s{n} AS MATERIALIZED (SELECT k, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM a{n}) GROUP BY k, p)",
            f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT k, list((s - (s % n + n) % n) // n ORDER BY p) AS c FROM s{n} GROUP BY k) m USING (k))",
        ]
    last = centroids.ROUNDS
    return f"""
        WITH {", ".join(parts)}, a AS MATERIALIZED ({near.format(c=f"c{last}")})
        SELECT vec_id, a.k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a JOIN c{last} c USING (k)
    """


ORACLES = {
    "op3_mix_sources": f"""
        WITH RECURSIVE d AS (SELECT doc_id AS id, source, len({_WORDS.format("coalesce(text, '')")}) AS size,
                   ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS draw FROM documents),
        n AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, (k - 1) % 3 + 1 AS w FROM n),
        -- by the least size per weight: those before have stopped at three times their size, the others share what is left
        a AS (SELECT *, sum(source_size) OVER ()::DOUBLE - 3 * coalesce(sum(source_size) OVER (level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest_of,
              (sum(w) OVER (level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight FROM w WINDOW level AS (ORDER BY source_size / w, k)),
        f AS (SELECT rest_of, weight FROM a WHERE 3 * source_size * weight > rest_of * w ORDER BY source_size / w, k LIMIT 1),
        t AS (SELECT a.k, a.source, a.source_size, a.docs, CASE WHEN 3 * a.source_size * a.weight <= a.rest_of * a.w THEN 3.0::DOUBLE * a.source_size ELSE f.rest_of * a.w / f.weight END AS target FROM a LEFT JOIN f ON true),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, target - whole * source_size AS rest FROM t),
        -- the draw's odds over the inclusion odds, within 0 and 1
        o AS (SELECT p.k, d.id, d.size, (d.draw + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u, rest / source_size::DOUBLE AS p, source_size, docs FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE rest > 0 AND d.size > 0),
        q AS (SELECT k, id, size, u / (1.0::DOUBLE - u) / (p / (1.0::DOUBLE - p) * (size * docs)::DOUBLE / source_size::DOUBLE) AS q FROM o),
        c AS (SELECT k, id, size, floor(q / (1.0::DOUBLE + q) * 281474976710656.0::DOUBLE)::BIGINT AS rank, sum(size)::BIGINT AS words FROM q GROUP BY ALL),
        l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, id NULLS FIRST, size) AS place FROM c),
        -- one document after another: taken if it fits in what is left
        g(k, place, gap, id, size, taken) AS (
            SELECT k, 0::BIGINT, rest, NULL::BIGINT, NULL::BIGINT, false FROM p WHERE rest > 0
            UNION ALL SELECT l.k, l.place, CASE WHEN l.words <= g.gap THEN g.gap - l.words ELSE g.gap END, l.id, l.size, l.words <= g.gap FROM g JOIN l ON l.k = g.k AND l.place = g.place + 1),
        z AS (SELECT k, min(gap) AS gap FROM g GROUP BY k),
        -- one more if that comes nearer
        x AS (SELECT l.k, l.id, l.size FROM l JOIN z USING (k) JOIN g ON g.k = l.k AND g.place = l.place WHERE NOT g.taken AND l.words < 2 * z.gap
              QUALIFY row_number() OVER (PARTITION BY l.k ORDER BY abs(l.words - z.gap), l.rank, l.id NULLS FIRST, l.size) = 1),
        e AS (SELECT k, id, size FROM g WHERE taken UNION ALL SELECT k, id, size FROM x)
        SELECT d.id AS doc_id, d.size::BIGINT AS size, source_size, target, (d.size * (whole + CASE WHEN e.k IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON e.k = p.k AND e.id IS NOT DISTINCT FROM d.id AND e.size = d.size AND d.size > 0
    """,
    "op5_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        -- a text of one to four words is one shingle
        s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, greatest(len(w) - 3, least(len(w), 1) + 1))]) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 85 * (u.n + v.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(node, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT node, b FROM r JOIN e ON e.a = other),
        m AS (SELECT node, min(other) AS least_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least_id, doc_id) AS component_id, doc_id = coalesce(least_id, doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON node = doc_id
    """,
    "op7_exact_duplicates": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op10_licenses": f"""
        WITH t AS (SELECT license, list_distinct({_shingles("w")}) AS wanted FROM (
               SELECT license, {_license_words("text")} AS w FROM (VALUES {_TEMPLATES}) v(license, text))),
        need AS (SELECT license, len(wanted) AS m, unnest(wanted) AS shingle FROM t),
        d AS (SELECT doc_id, {_license_words("coalesce(text, '')")} AS w FROM documents),
        s AS (SELECT doc_id, unnest({_shingles("w")}) AS shingle, unnest(range(0, len(w) - {licenses.SHINGLE - 1})) AS place FROM d WHERE len(w) >= {licenses.SHINGLE}),
        hit AS (SELECT doc_id, license, m, shingle, place FROM s JOIN need USING (shingle)),
        step AS (SELECT *, greatest(1, m // {licenses.STEPS}) AS step FROM hit),
        win AS (SELECT doc_id, license, m, shingle, place, unnest(range(greatest(0, ((place - 2 * m + step) // step) * step), place - place % step + 1, step)) AS start FROM step),
        best AS (SELECT doc_id, license, m, start, count(DISTINCT shingle) AS shared, min(place) AS first_word, max(place) + {licenses.SHINGLE} AS end_word
                 FROM win GROUP BY ALL HAVING 5 * count(DISTINCT shingle) >= 4 * m)
        SELECT doc_id, license, shared, m AS shingles, first_word, end_word FROM best
        QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY shared DESC, start) = 1
    """,
    "op12_hard_negatives": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
               FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
        s AS MATERIALIZED (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                     coalesce(list_sum([a.x[k] * b.x[k] FOR k IN range(1, least(len(a.x), len(b.x)) + 1)]), 0)::BIGINT AS score FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE same QUALIFY place <= {negatives.POSITIVES})
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 100 * s.score BETWEEN {negatives.LOW} * positive_score AND {negatives.HIGH} * positive_score
        QUALIFY rank <= {negatives.NEGATIVES}
    """,
    "op13_centroids": _clusters(),
}
