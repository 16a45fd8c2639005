"""The contract queries of the corpus operators, and SQL for those that SQL can express.

Each query is thin: it applies an operator of this subpackage, with
production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.llm import alignment, licenses, packing, piece_codec, secrets, simhash, spelling, spotsigs, token_counts, topk, toxicity, urls, warc
from nearloom.llm.runtime import stored

#: The tokenizer files; their folder is a parameter of the operators.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: ``doc_id, n_tokens``."""
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL).select("doc_id", "n_tokens")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under RULES: ``page_id, host, path, rule, verdict``."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs of every document and of its edited text, with their likeness."""
    return spotsigs.compare_neighbours(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: ``doc_id, fingerprint, component_id``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: ``doc_id, n_tokens, ids, round_trip``."""
    rows = piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), PIECE_MODEL)
    rows = piece_codec.decode(rows, PIECE_MODEL)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as a WARC archive and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and verdict: ``doc_id, p_quality, p_toxic, is_toxic``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, chain).select("doc_id", "p_quality", "p_toxic", "is_toxic")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the tokens of two tokenizers."""
    return alignment.cross_counts(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_MODEL)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its form and root: ``word, form, root, n, n_near, form_n``."""
    return spelling.variants(stored(spelling.words(table(spark, sf_dir, "documents")), "words"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or holds a notice of."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_url_filters,
        op3_document_fingerprints,
        op4_simhash_near_dedup,
        op5_secret_scans,
        op6_sentencepiece,
        op7_best_fit_packing,
        op8_warc,
        op9_toxicity,
        op10_exact_top_k,
        op11_cross_tokenizer_alignment,
        op12_spelling_variants,
        op13_license_scans,
    )
}


def _attribute(name: str) -> str:
    """SQL for the value of a tag's attribute, without its quotes; the empty string if it has none."""
    value = rf"""regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 1)"""
    return f"""CASE WHEN substr({value}, 1, 1) IN ('"', '''') THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"""


ORACLES: dict[str, str] = {
    "op2_url_filters": f"""
WITH RECURSIVE raw AS (
  SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM raw
), hrefs AS (
  SELECT DISTINCT host, path, a, trim(replace(named, '&amp;', '&')) AS href FROM (
    SELECT host, path, a, CASE
      WHEN lower(substr(tag, 2, 4)) = 'link' THEN CASE WHEN list_contains(regexp_split_to_array(lower({_attribute("rel")}), '\\s+'), 'canonical') THEN {_attribute("href")} END
      WHEN lower(trim({_attribute("http-equiv")})) = 'refresh' THEN regexp_replace(trim(regexp_extract({_attribute("content")}, '(?is)url\\s*=\\s*(.*)$', 1)), '^(?:"([^"]*).*|''([^'']*).*)$', '\\1\\2') END AS named
    FROM (SELECT host, path, host || tail AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b(?:[^>=]|=\\s*(?:"[^"]*"|''[^'']*'')?)*>')) AS tag FROM p)
  ) WHERE named IS NOT NULL
), resolved AS (
  SELECT a, CASE
    WHEN href = '' OR href LIKE '#%' THEN NULL
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(href, instr(href, '://') + 3)
    WHEN href LIKE '//%' THEN substr(href, 3)
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN href LIKE '/%' THEN host || href
    WHEN href LIKE '?%' THEN host || path || href
    ELSE host || CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END || href END AS rest
  FROM hrefs
), edges AS (
  SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM resolved WHERE rest IS NOT NULL
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> '' AND b <> '' UNION SELECT b, a FROM edges WHERE a <> '' AND b <> ''
), named AS (
  SELECT page_id AS id, host || tail AS node, host, path FROM p
  UNION ALL
  SELECT NULL, a, regexp_extract(a, '^([^/?#]*)', 1), regexp_extract(a, '^[^/?#]*([^?#]*)', 1) FROM both_ways
), rules(action, host, path) AS (
  VALUES {", ".join(str(tuple(r)) for r in RULES)}
), judged AS (
  SELECT n.id, n.node, n.host, n.path, first(r.host || r.path ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) FILTER (r.host IS NOT NULL) AS rule,
    first(r.action ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) FILTER (r.host IS NOT NULL) AS action
  FROM named n LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY ALL
), bad(node) AS (
  SELECT node FROM judged WHERE action = 'block' AND node IN (SELECT a FROM both_ways)
  UNION
  SELECT e.b FROM bad JOIN both_ways e ON e.a = bad.node
)
SELECT id AS page_id, host, path, rule, coalesce(action, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged WHERE id IS NOT NULL
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM r
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * b.c[i]))::BIGINT AS score
  FROM v q JOIN v b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
    "op12_spelling_variants": spelling.oracle(),
    "op13_license_scans": licenses.oracle(),
}
