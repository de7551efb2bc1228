"""Contract queries of the operators in this subpackage: thin projections of their general outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .boilerplate import extract

    out = extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the model learned from nine tenths of them."""
    from .hpylm import score
    from .langid import remainder

    held = remainder("doc_id", 10) == 0
    out = score(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held)
    return out.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The contract's rules: verdict, host, path. The operator's own default differs in one word (it blocks net/de/).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rule or else by its host's trust and distrust."""
    from .urlfilter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix with 150% of all words takes of every document."""
    from .mixing import mix, small

    out = mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.array("source"))
    totals = small(out.sources.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target"))
    return out.taken.join(totals, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a 20-word window starting earlier covers are removed."""
    from .substrings import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector among all others."""
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint and the component it belongs to."""
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with the public byte-level vocabulary, and decoded again."""
    import public_tokenizers

    from .bpe import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the two thirds that aren't held out."""
    from .langid import fit, identify, remainder

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 3)
    model = fit(docs.filter(fold != 1))
    out = identify(docs.select("doc_id", "text", (fold == 1).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every 100th vector."""
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_simhash_dedup, op3_language_id, op4_html_extraction, op5_lm_scoring, op6_url_filter, op7_mixing, op8_substring_dedup, op9_bpe, op10_neighbours)}

_OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i, len(e) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM u q JOIN u c ON q.i = c.i AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS s FROM d, unnest(range(len(w) - 19)) AS u(i) WHERE len(w) >= 20),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS at FROM seen, unnest(range(20)) AS u(j) WHERE later),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at FROM d),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.at) AS t FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at WHERE g.at IS NULL GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_topk_search": _OP1, "op8_substring_dedup": _OP8}
