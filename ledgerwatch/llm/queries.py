"""One query per operator over its whole table, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm.blockjoin import nearest
from ledgerwatch.llm.common import table
from ledgerwatch.llm.crf import personal_data
from ledgerwatch.llm.decontam import contamination
from ledgerwatch.llm.langid import held_out, identify_languages
from ledgerwatch.llm.linespread import remove_shared_lines
from ledgerwatch.llm.linkrank import Rule, judge_pages
from ledgerwatch.llm.minhash import near_duplicates
from ledgerwatch.llm.mixing import mix_sources
from ledgerwatch.llm.orchard import centroid_digest, cluster
from ledgerwatch.llm.runs import find_runs
from ledgerwatch.llm.secrets import find_secrets
from ledgerwatch.llm.setjoin import jaccard_groups
from ledgerwatch.llm.tokenstore import token_store

QueryFn = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def joined_spans(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def spans_of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang")
    return identify_languages(docs, labelled).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "gap", "ambiguous"
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store(docs, public_tokenizers.path(TOKENIZER), END_ID)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans_of_kind("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        hex_sha256(joined_spans("base")).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans_of_kind("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        hex_sha256(joined_spans("base")).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_shared_lines(table(spark, sf_dir, "documents"))
    kept = F.coalesce("kept_text", F.lit(""))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length(kept).cast("long").alias("kept_chars"),
        hex_sha256(kept).alias("kept_sha256"),
    )


def tiled_texts(docs: DataFrame) -> DataFrame:
    """Documents, one in ten of them made periodic from some word on: with h the crc32 of the
    id and g = h / 10, if 10 divides h, word i >= a = g % n becomes word a + (i - a) % p with
    p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = F.when(h % 10 == 0, split)
    docs = docs.withColumn("__words", words).withColumn("__n", F.size("__words"))
    docs = docs.withColumn("__g", F.expr("crc32(cast(doc_id AS string)) div 10"))
    docs = docs.withColumn("__a", F.expr("CASE WHEN __n > 0 THEN cast(__g % __n AS int) END"))
    docs = docs.withColumn("__p", F.expr("cast(1 + (__n - __a) div (3 + __g % 8) AS int)"))
    tiled = F.expr(
        "array_join(transform(__words, (w, i) -> "
        "if(i >= __a, __words[__a + (i - __a) % __p], w)), ' ')"
    )
    text = F.when(F.col("__n") > 0, tiled).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(tiled_texts(table(spark, sf_dir, "documents")))
    # The run of greatest length / period, compared as fractions.
    best = F.expr(
        "get(array_sort(runs, (a, b) -> CASE "
        "WHEN a.length * b.period > b.length * a.period THEN -1 "
        "WHEN a.length * b.period < b.length * a.period THEN 1 "
        "WHEN a.start <> b.start THEN if(a.start < b.start, -1, 1) "
        "WHEN a.period <> b.period THEN if(a.period < b.period, -1, 1) ELSE 0 END), 0)"
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        hex_sha256(F.array_join(lines, "")).alias("runs_sha256"),
        hex_sha256(F.col("kept_text")).alias("collapsed_sha256"),
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"), 8, 10, 64, 3)
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        centroid_digest().alias("centroid_sha256"),
    )


def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of exact whole-number clustering, written out one after another."""
    assigned = """
        a{0} AS MATERIALIZED (
            SELECT r, arg_min(num, (d, num)) AS num, min(d) AS d FROM (
                SELECT v.r, c.num, sum((v.x - c.x) * (v.x - c.x)) AS d
                FROM v JOIN c{0} c USING (i) GROUP BY v.r, c.num) GROUP BY r)"""
    moved = """
        c{1} AS MATERIALIZED (
            SELECT c.num, c.i, CASE WHEN m.n IS NULL THEN c.x
                   ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
            FROM c{0} c LEFT JOIN (
                SELECT a.num, v.i, sum(v.x) AS s, count(*) AS n
                FROM v JOIN a{0} a USING (r) GROUP BY a.num, v.i) m USING (num, i))"""
    steps = [
        f"""WITH k AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding::DOUBLE[] AS e
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding,
                lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        v AS MATERIALIZED (
            SELECT r, i, CAST(floor(1024 * e[i]) AS HUGEINT) AS x
            FROM (SELECT r, e, unnest(range(1, 65)) AS i FROM k)),
        c0 AS MATERIALIZED (
            SELECT num, i, x FROM v JOIN (
                SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS num
                FROM k WHERE vec_id IS NOT NULL
                ORDER BY num LIMIT {k}) USING (r))"""
    ]
    for j in range(rounds):
        steps += [assigned.format(j), moved.format(j, j + 1)]
    steps.append(assigned.format(rounds))
    steps.append(
        f"""
        digest AS (
            SELECT num, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h
            FROM c{rounds} GROUP BY num)
        SELECT vec_id, CAST(num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN k USING (r) JOIN digest USING (num)"""
    )
    return ",".join(steps[:-1]) + "," + steps[-1]


QUERIES: dict[str, QueryFn] = {
    "op1_language_id": op1_language_id,
    "op2_token_store": op2_token_store,
    "op3_nearest": op3_nearest,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_url_verdicts": op5_url_verdicts,
    "op6_contamination": op6_contamination,
    "op7_secrets": op7_secrets,
    "op8_mix": op8_mix,
    "op9_personal_data": op9_personal_data,
    "op10_line_spread": op10_line_spread,
    "op11_word_runs": op11_word_runs,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_clusters": op13_clusters,
}

SQL: dict[str, str] = {
    # Cosines of all query and candidate pairs, in double precision.
    "op3_nearest": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_cosine_similarity(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0),
        r AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM r WHERE rank <= 5""",
    # Windows of 13 words, or whole shorter items, as joined words.
    "op6_contamination": r"""
        WITH b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL),
        wins AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n,
                   array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
                  FROM b WHERE len(w) > 0)),
        d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM wins),
        places AS (
            SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, sizes WHERE len(w) >= n)),
        hits AS (
            SELECT doc_id, item_id, i, p.n FROM places p JOIN wins USING (n, win)),
        words AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits)
            GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # Exact distinct counts of sites for every line.
    "op10_line_spread": """
        WITH l AS (
            SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13))
                AS line
            FROM documents WHERE text IS NOT NULL),
        shared AS (
            SELECT list(line) AS lines FROM (
                SELECT line FROM l WHERE line <> ''
                GROUP BY line HAVING count(DISTINCT source) >= 10)),
        d AS (
            SELECT doc_id, string_split(text, chr(10)) AS own,
                   list_transform(string_split(text, chr(10)),
                       lambda x: trim(x, ' ' || chr(9) || chr(13))) AS t
            FROM documents),
        k AS (
            SELECT doc_id, coalesce(len(list_filter(t, lambda x: x <> '')), 0) AS n_lines,
                   coalesce(len(list_filter(t, lambda x: list_contains(lines, x))), 0)
                       AS n_removed,
                   coalesce(array_to_string(list_filter(own, lambda x: NOT coalesce(
                       list_contains(lines, trim(x, ' ' || chr(9) || chr(13))), FALSE)),
                       chr(10)), '') AS kept
            FROM d, shared)
        SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
               CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
        FROM k""",
    "op13_clusters": clusters_sql(),
}
