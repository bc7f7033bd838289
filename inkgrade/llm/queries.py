"""The registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkgrade.llm import (
    audit, classifier, html, licenses, mixing, ngram_join, packing, pii, quality, sharding, spelling, topk, urls,
)
from inkgrade.llm.common import read


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.tokenized(read(spark, sf_dir, "documents"), tokenizer=path)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_text(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(read(spark, sf_dir, "documents")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, is_query=F.col("vec_id") % 50 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed_copies(docs, keep=("doc_id",)).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.copies") * F.col("mix.size")).alias("taken"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = sharding.shard_groups(
        read(spark, sf_dir, "documents"), shards=16, size=F.octet_length(text) + 1, group=text,
        keep={"text_crc32": F.crc32(F.encode(text, "UTF-8"))},
    )
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = classifier.score_quality(read(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii, op2_packing, op3_html, op4_licenses, op5_topk, op6_ngram_join, op7_mixing, op8_sharding, op9_quality,
        op10_urls, op11_spelling, op12_audit, op13_classifier, pipeline,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rules(rules: list[urls.Rule]) -> str:
    return ", ".join("('{}', '{}', '{}', '/{}')".format(v, t, *t.split("/", 1)) for v, t in rules)


def _longest(rules: str) -> str:
    return f"""
        SELECT page_id, host, path, arg_max(rule, (length(rhost), length(rpath))) AS rule,
               arg_max(verdict, (length(rhost), length(rpath))) AS verdict
        FROM parts JOIN (VALUES {rules}) AS r(verdict, rule, rhost, rpath)
          ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY ALL"""


ORACLES: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
          SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        ), s AS (
          SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(
            generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id AND len(a.q) = len(b.q)
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank
          FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_mixing": rf"""
        WITH d AS (
          SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0)::BIGINT AS size,
                 md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS hash FROM documents
        ), p AS (
          SELECT *, CASE WHEN size < 100 THEN size ELSE (len(size::VARCHAR) - 2) * 100
            + left(size::VARCHAR, 2)::INTEGER END AS class FROM d
        ), n AS (
          SELECT source, sum(size)::BIGINT AS source_size,
                 row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source
        ), w AS (
          SELECT source, source_size, [5, 2, 1][(turn % 3 + 1)::INTEGER] AS weight, 3 * source_size AS top FROM n
        ), o AS (
          SELECT *, sum(source_size) OVER () AS everything,
                 coalesce(sum(top) OVER before, 0) AS before, sum(weight) OVER after AS open FROM w
          WINDOW before AS (ORDER BY source_size * (10 // weight), source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 after AS (ORDER BY source_size * (10 // weight), source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), c AS (
          SELECT *, (everything - before) * weight >= top * open AS stops FROM o
        ), t AS (
          SELECT source, source_size, CASE WHEN stops THEN top::DOUBLE ELSE
            ((everything - coalesce(sum(CASE WHEN stops THEN top END) OVER (), 0)) * weight)::DOUBLE
              / (sum(CASE WHEN NOT stops THEN weight END) OVER ())::DOUBLE END AS target FROM c
        ), r AS (
          SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
                 ('0x' || left(md5('mix:' || coalesce('=' || source, '-')), 5))::BIGINT::DOUBLE / 1048576 AS shift
          FROM t
        ), x AS (
          SELECT doc_id, size, source_size, target, rate, shift, row_number() OVER (
            PARTITION BY p.source ORDER BY class, hash, size, doc_id) AS place
          FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
        )
        SELECT doc_id, size, source_size, target, (least(
          floor(shift + rate * place::DOUBLE) - floor(shift + rate * (place - 1)::DOUBLE), ceil(rate)
        )::BIGINT * size)::BIGINT AS taken FROM x""",
    "op10_urls": rf"""
        WITH parts AS (
          SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
        ), given AS ({_longest(_rules(urls.BASE_RULES))}
        ), own AS ({_longest(_rules(urls.OWN_RULES))}
        )
        SELECT p.page_id, p.host, p.path, g.rule, coalesce(g.verdict, o.verdict, 'allow') AS verdict,
               CASE WHEN g.rule IS NULL THEN o.rule END AS own_rule
        FROM parts p LEFT JOIN given g ON p.page_id = g.page_id AND p.host = g.host AND p.path = g.path
        LEFT JOIN own o ON p.page_id = o.page_id AND p.host = o.host AND p.path = o.path""",
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [w]
            ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: w[i:i + 4])) END AS s FROM w
        ), f AS (
          SELECT doc_id, len(s) AS n, unnest(s) AS f FROM s
        ), c AS (
          SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
          FROM f a JOIN f b ON a.f = b.f AND a.doc_id < b.doc_id
            AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY ALL
        ), e AS (
          SELECT a, b FROM c WHERE 100 * shared >= 80 * (na + nb - shared)
        ), sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), reach(id, seen) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.seen
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id
        FROM s JOIN (SELECT id, min(seen) AS c FROM reach GROUP BY id) m ON m.id = s.doc_id""",
    "op11_spelling": rf"""
        WITH RECURSIVE crc AS (
          SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
        ), runs AS (
          SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zA-Z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run
            FROM documents) GROUP BY ALL
        ), hashed AS (
          SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs
        ), marked AS (
          SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
            lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)),
            lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h
          FROM hashed, crc
        ), words AS (
          SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::BIGINT)
                     || substr(run, (h % len(run) + 2)::BIGINT) ELSE run END AS word, n FROM marked)
          WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), cuts AS (
          SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
          FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)
        ), less AS (
          SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cuts c JOIN words w ON c.cut = w.word
        ), near AS (
          SELECT a.word AS a, b.word AS b, b.n AS bn FROM cuts a JOIN cuts b
            ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
          UNION SELECT a, b, bn FROM less UNION SELECT b, a, an FROM less
        ), best AS (
          SELECT a, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS b, max(bn) AS bn FROM near GROUP BY a
        ), formed AS (
          SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form,
                 CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM words LEFT JOIN best ON a = word
        ), walk AS (
          SELECT word, word AS root FROM formed
          UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = root WHERE form IS NOT NULL
        )
        SELECT formed.*, walk.root FROM formed JOIN walk ON walk.word = formed.word
        JOIN formed f ON f.word = walk.root AND f.form IS NULL""",
    "op12_audit": rf"""
        WITH d AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
        ), least AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t
        ), w AS (
          SELECT doc_id, part, t, low, {_WORDS.format('t')} AS w FROM d JOIN least USING (t)
        ), marks AS (
          SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY 1
        ), flags AS (
          SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
                 (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
                 + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 4 ELSE 0 END)
                 + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                 + (CASE WHEN coalesce(low < doc_id, FALSE) THEN 16 ELSE 0 END) AS bits
          FROM w LEFT JOIN marks USING (doc_id)
        ), sets AS (
          SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
          FROM flags GROUP BY ALL
        ), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)
        ), orders AS (
          SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
                 [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a JOIN f b ON b.name <> a.name JOIN f c ON c.name NOT IN (a.name, b.name)
          JOIN f d ON d.name NOT IN (a.name, b.name, c.name) JOIN f e ON e.name NOT IN (a.name, b.name, c.name, d.name)
        ), steps AS (
          SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS before
          FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
        ), counted AS (
          SELECT part, filter_order, step, own,
                 coalesce(sum(n) FILTER (bits & (own | before) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before <> 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (bits & own <> 0 AND bits & before = 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (bits & own <> 0 AND bits & before = 0), 0)::BIGINT AS toxic_lost
          FROM sets, steps GROUP BY ALL
        )
        SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted""",
}
