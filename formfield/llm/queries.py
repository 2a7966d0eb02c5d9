"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield.llm import (
    decontaminate, fingerprints, lexical, licenses, line_spread, mixing, negatives, quality, simhash, token_counts, topk,
    toxicity, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


#: Words as the contracts of decontamination and license scans define them.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
    WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
    known AS (
        SELECT DISTINCT item, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS win, least(13, len(w)) AS n
        FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(s) WHERE len(w) > 0),
    doc AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    place AS (
        SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
        FROM doc, (SELECT DISTINCT n FROM known), unnest(range(1, len(w) - n + 2)) AS t(s)),
    hit AS (SELECT doc_id, s, place.n, item FROM place JOIN known USING (win)),
    word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
    own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN own USING (doc_id)""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit and items found in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    documents = _table(spark, sf_dir, "documents")
    return quality.score_documents(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


@query(f"""
    WITH line AS (
        SELECT *, length(ln) > {2 * line_spread.PASSAGE_WORDS}
               AND len(regexp_extract_all(ln, '[^\\x20\\x09-\\x0D]+')) > {line_spread.PASSAGE_WORDS} AS passage
        FROM (
            SELECT doc_id, site, own, trim(raw) AS ln, raw, pos FROM (
                SELECT doc_id, coalesce('=' || source, '') AS site, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS own,
                       unnest(string_split(text, chr(10))) AS raw,
                       generate_subscripts(string_split(text, chr(10)), 1) AS pos
                FROM documents))),
    wide AS (SELECT ln, min(own) AS first FROM line WHERE ln <> '' GROUP BY ln, passage
             HAVING CASE WHEN passage THEN count(DISTINCT site) >= {line_spread.PASSAGE_SITES} AND count(DISTINCT own) > 1
                         ELSE count(DISTINCT site) >= {line_spread.MIN_SITES} END),
    marked AS (SELECT line.*, wide.ln IS NOT NULL AND NOT passage AS furniture, coalesce(passage AND own <> first, false) AS quoted
               FROM line LEFT JOIN wide USING (ln)),
    copy AS (SELECT doc_id, 2 * coalesce(sum(length(raw)) FILTER (WHERE quoted), 0) >= sum(length(raw)) FILTER (WHERE ln <> '') AS copied
             FROM marked GROUP BY doc_id),
    cut AS (
        SELECT doc_id, count(*) FILTER (WHERE ln <> '') AS n_lines, count(*) FILTER (WHERE furniture OR quoted AND NOT copied) AS n_wide,
               string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT (furniture OR quoted AND NOT copied)) AS remaining
        FROM marked JOIN copy USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_wide < n_lines THEN n_wide ELSE 0 END AS n_removed,
           CASE WHEN n_wide > 0 AND n_wide < n_lines THEN remaining ELSE text END AS text
    FROM documents LEFT JOIN cut USING (doc_id)""")
def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites carry."""
    return line_spread.remove_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix to target weights takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(f"""
    WITH rules(r_host, r_path, verdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
    part AS (
        SELECT page_id, row_number() OVER () AS n,
               CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    site AS (
        SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part),
    best AS (
        SELECT n, arg_max({{'rule': r_host || r_path, 'verdict': verdict}}, length(r_host || r_path)) AS b
        FROM site JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
    SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM site LEFT JOIN best USING (n)""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest fitting rule for every page's url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).drop("url")


def _license_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, label, CAST(s - 1 AS BIGINT) AS start FROM (SELECT doc_id, w, '{label}' AS label FROM doc WHERE len(w) >= {len(parts)}), "
        f"unnest(range(1, len(w) - {len(parts) - 1} + 1)) AS t(s) WHERE " + " AND ".join(f"w[s + {k}] = '{p}'" for k, p in enumerate(parts))
        for label, parts in ((label, phrase.split()) for phrase, label in licenses.PHRASES)
    )
    known = ", ".join(
        f"({n}, '{label}', '{token}', {len(tokens)})"
        for n, (label, tokens) in enumerate(licenses.template_tokens(licenses.TEMPLATES)) for token in tokens
    )
    return f"""
    WITH doc AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    base AS ({phrases}),
    based AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM base GROUP BY doc_id),
    known(template, label, token, n) AS (VALUES {known}),
    line AS (SELECT doc_id, pos, {_WORDS.format('ln')} AS w FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
    token AS (SELECT DISTINCT doc_id, pos, u.token FROM line, unnest(w) AS u(token)),
    fit AS (
        SELECT doc_id, pos, label, count(*) / any_value(n) AS c FROM token JOIN known USING (token)
        GROUP BY doc_id, pos, template, label HAVING count(*) >= {licenses.THRESHOLD} * any_value(n) - 1e-9),
    best AS (SELECT doc_id, max(c) AS c FROM fit GROUP BY doc_id),
    names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (
        SELECT doc_id, label FROM fit UNION SELECT doc_id, label FROM base) GROUP BY doc_id),
    base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_names.labels, '') AS base_labels, coalesce(names.labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
    FROM doc LEFT JOIN based USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN names USING (doc_id)
    LEFT JOIN base_names USING (doc_id)"""


@query(_license_sql())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score",
    )


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after a replacement, an insertion and a deletion."""
    documents = _table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    part = lambda share: F.floor(n / share).cast("long")
    edits = F.array(
        F.struct(part(2).alias("start"), (part(2) + part(20)).alias("end"), F.substr("text", F.lit(1), part(25).cast("int")).alias("new")),
        F.struct(part(4).alias("start"), part(4).alias("end"), F.concat(F.lit("\n\nEdited: "), F.coalesce("source", F.lit("")), F.lit("'s  ")).alias("new")),
        F.struct((part(4) * 3).alias("start"), (part(4) * 3 + part(50)).alias("end"), F.lit("").alias("new")),
    )
    return token_counts.count_with_edits(documents.select("doc_id", "text", edits.alias("edits")), "edits")


#: Usable vectors in whole numbers.
_VECTORS = """SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(f"""
    WITH v AS ({_VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", scale=256)} AND label IS NOT NULL),
    pair AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS friend,
                    CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
             FROM v AS a, v AS c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    friend AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE friend
               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score,
           score AS negative_score
    FROM friend JOIN (SELECT * FROM pair WHERE NOT friend) USING (anchor_id)
    WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives below each of an anchor's five positives."""
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label=negatives.mined_label("vec_id", "label"))


@query(f"""
    WITH v AS ({_VECTORS.format(label="label", scale=64)})
    SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id AS vec_id,
           CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v AS q, v AS c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 20""")
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows of every twentieth one."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


@query(f"""
    WITH doc AS (SELECT * FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 0),
    norm AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc) GROUP BY doc_id, term),
    weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
               FROM tf, norm GROUP BY term),
    length AS (SELECT doc_id, 25 + (75 * len(doc.w) * n_docs) // n_terms AS m FROM doc, norm),
    item AS (SELECT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
    score AS (SELECT item_id, doc_id, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
              FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN length USING (doc_id) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
    WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
