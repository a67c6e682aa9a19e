"""The registered queries of the operators, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid.llm import (
    decontaminate, kneser_ney, langid, lines, lm_score, mixing, neardup, negatives, pieces, pii, quality_rules, warc, whitening,
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = Query(fn.__name__, fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The public BPE vocabulary of this box; any other path may be given to the operator."""
    import public_tokenizers

    return pieces.load_blob(public_tokenizers.path("piece_bpe_32k.model"))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), found AS (
  SELECT doc_id, p, m, item_id FROM dw JOIN bw USING (m, g)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM found) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""


@query(OP9_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), q AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p
), r AS (
  SELECT page_id, n, d, min(page_id) OVER (PARTITION BY d) AS first FROM q
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM r
"""


@query(OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    # a record that is not whole must not pass for one: its digest comes back null
    return warc.read_archive(archive).select(
        F.col("record_id").alias("page_id"), "payload_bytes",
        F.when(F.col("whole"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d WHERE len(w) > 0
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a, min(b) AS first FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.first, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(c.first, d.doc_id) AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


@query(OP1_SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2).drop("text_key")


OP2_SQL = r"""
WITH x AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), y AS (
  SELECT rid, source, i, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT rid, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM x)
), t AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), over AS (
  SELECT y.source, line FROM y JOIN t ON y.source IS NOT DISTINCT FROM t.source WHERE line <> ''
  GROUP BY y.source, line, total HAVING count(DISTINCT rid) > (total + 20) * 0.1
), kept AS (
  SELECT rid, string_agg(raw, chr(10) ORDER BY i) FILTER (over.line IS NULL) AS text, count(over.line) AS n_dropped
  FROM y LEFT JOIN over ON y.source IS NOT DISTINCT FROM over.source AND y.line = over.line GROUP BY rid
)
SELECT x.doc_id, x.source, CASE WHEN x.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM x LEFT JOIN kept USING (rid)
"""


@query(OP2_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM w)
), r AS (
  SELECT rid, count(DISTINCT q) AS n FROM (
    SELECT rid, unnest(range(p, p + 8)) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1
  ) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.rid = w.rid
), f AS (
  SELECT source, rule, count(*) AS n, sum(CAST(bad AS BIGINT)) AS fails FROM (
    SELECT source, unnest(['few_words', 'repeated', 'symbols', 'dup_lines', 'word_length']) AS rule,
      unnest([n_words < 20, n_repeat_words * 100 > n_words * 30, n_symbols * 10 > n_words, n_dup_lines * 10 > n_lines * 3,
        word_chars < n_words * 2 OR word_chars > n_words * 15]) AS bad FROM m
  ) GROUP BY source, rule
), p AS (
  SELECT rule, m, CASE WHEN v <= 1e-12 THEN 1000 ELSE least(1000, greatest(1, m * (1 - m) / v - 1)) END AS s
  FROM (SELECT rule, avg(fails / n) AS m, var_pop(fails / n) AS v FROM f GROUP BY rule)
), h AS (
  SELECT source, bool_or((fails + m * s) / (n + s) > 0.5) AS rejected FROM f JOIN p USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected AS host_rejected,
  NOT base_failed AND NOT rejected AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m) m
JOIN h ON m.source IS NOT DISTINCT FROM h.source
"""


@query(OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("host", "n_lines")


@query()
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.redactions(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
    )


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    # learned from remainders 0 and 1, temperature from 3; 2 is held out
    model = langid.train(docs.select("doc_id", "text", "lang").where(rest != 2), rest < 2)
    return langid.predicted(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model)


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query()
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    numbered = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return numbered.select(
        "vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, "component").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""


@query(OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
    CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ' ' || coalesce(text, ''))[1:13] AS BIGINT) AS h FROM documents
), l AS (
  SELECT source, length(bin(size)) AS g, sum(size) AS w FROM d WHERE size > 0 GROUP BY 1, 2
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS words,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source
), f AS (
  SELECT *, (1.5 * sum(words) OVER () - 2 * coalesce(sum(words) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, words, least(2 * words, weight * (SELECT arg_min(level, words / weight) FROM f WHERE 2 * words >= weight * level)) AS target FROM s
), k AS (
  SELECT source, g, (target - 2.0 * coalesce(sum(w) OVER b, 0)) / (sum(g * w) OVER (PARTITION BY l.source) - coalesce(sum(g * w) OVER b, 0)) AS k
  FROM l JOIN t USING (source) WINDOW b AS (PARTITION BY l.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT t.source, words, target, coalesce(rate, 2.0) AS rate
  FROM t LEFT JOIN (SELECT source, arg_max(k, g) AS rate FROM k WHERE k * g <= 2 GROUP BY source) q ON q.source = t.source
), e AS (
  SELECT doc_id, d.source, size, h, words, target, least(2.0, rate * length(bin(size))) AS e, (h + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), c AS (
  SELECT source, target - sum(floor(e) * size) AS owed FROM e GROUP BY source, target
), o AS (
  SELECT *, (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) AS o FROM e WHERE e > floor(e) AND size > 0
), q AS (
  SELECT o.doc_id, o.source, size, o / (1 + o) AS t, h, owed,
    sum(size) OVER (PARTITION BY o.source ORDER BY o / (1 + o), h ROWS UNBOUNDED PRECEDING) AS upto
  FROM o JOIN c ON o.source IS NOT DISTINCT FROM c.source
), m AS (
  SELECT doc_id, source, size, t, h, owed - max(CASE WHEN upto <= owed THEN upto ELSE 0 END) OVER (PARTITION BY source) AS left_,
    bool_or(upto > owed) OVER (PARTITION BY source ORDER BY t, h ROWS UNBOUNDED PRECEDING) AS out FROM q
), q2 AS (
  SELECT doc_id, bool_or(upto2 > left_) OVER (PARTITION BY source ORDER BY t, h ROWS UNBOUNDED PRECEDING) AS out2
  FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY t, h ROWS UNBOUNDED PRECEDING) AS upto2 FROM m WHERE out AND size <= left_)
), n AS (
  SELECT m.*, NOT out OR coalesce(NOT out2, false) AS had FROM m LEFT JOIN q2 ON q2.doc_id = m.doc_id
), g AS (
  SELECT *, left_ - sum(CASE WHEN out AND had THEN size ELSE 0 END) OVER (PARTITION BY source) AS room FROM n
), f1 AS (
  SELECT doc_id, source, size FROM g WHERE NOT had AND abs(size - room) < room
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - room), t, h) = 1
), m2 AS (
  SELECT g.*, had OR f1.doc_id IS NOT NULL AS taken, room - coalesce(max(f1.size) OVER (PARTITION BY g.source), 0) AS rest
  FROM g LEFT JOIN f1 ON f1.doc_id = g.doc_id
), f2 AS (
  SELECT doc_id FROM m2 WHERE taken = (rest < 0) AND abs(size - abs(rest)) < abs(rest)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - abs(rest)), t, h) = 1
), x AS (
  SELECT m2.doc_id FROM m2 LEFT JOIN f2 ON f2.doc_id = m2.doc_id WHERE taken <> (f2.doc_id IS NOT NULL)
)
SELECT e.doc_id, size, CAST(words AS BIGINT) AS source_size, target,
  CAST((floor(e) + (x.doc_id IS NOT NULL)::INT) * size AS BIGINT) AS taken, CAST(floor(e) + (x.doc_id IS NOT NULL)::INT AS BIGINT) AS copies
FROM e LEFT JOIN x ON x.doc_id = e.doc_id
"""


@query(OP13_SQL)
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
