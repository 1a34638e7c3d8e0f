"""The registered queries of this subpackage: ``LLM_QUERIES`` name -> (spark,
sf_dir) -> DataFrame, and ``LLM_SQL`` with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .decision_list import base_failed, learn_from, text_statistics
from .html_text import extract
from .hyper_lang import held_out, identify, learn_from_documents
from .line_dedup import SQL as LINE_SQL
from .line_dedup import dedup_lines
from .link_graph import SQL as LINK_SQL
from .link_graph import judge
from .mixing import mixing_plan, with_copies
from .near_dups import near_duplicate_classes
from .packing import pack
from .perspectives import SQL as CHAT_SQL
from .perspectives import mask_text, perspectives
from .prefix_trie import SQL as TRIE_SQL
from .prefix_trie import prefix_trie, rebuilt
from .segment_search import top_k
from .strassen_negatives import SQL as NEGATIVES_SQL
from .strassen_negatives import mine
from .wordpiece_count import from_byte_level, token_counts

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def registered(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@registered
def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: doc_id, class_id."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@registered
def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated three-line windows: doc_id, text, n_lines, n_removed."""
    return dedup_lines(table(spark, sf_dir, "documents"))


LLM_SQL["op6_line_windows"] = LINE_SQL


@registered
def op8_hyper_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    return (identify(docs, learn_from_documents(docs), keep=["doc_id"])
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


@registered
def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents under token targets by source: doc_id, size, source_size, target, taken, rate, copies."""
    docs = table(spark, sf_dir, "documents")
    return with_copies(docs, mixing_plan(docs)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@registered
def op5_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, one row a piece."""
    return pack(table(spark, sf_dir, "documents"))


@registered
def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; rules learned from ``labels.quality``."""
    stats = materialize(text_statistics(table(spark, sf_dir, "documents"), keep=["doc_id"]), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = learn_from(stats.join(labels, "doc_id"), "doc_id", "quality")
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~base_failed() & rules.verdict()).alias("kept"))


@registered
def op4_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners by integer inner product of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


LLM_SQL["op4_segment_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@registered
def op3_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@registered
def op9_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of all documents: doc_id, n_words, n_tokens."""
    return token_counts(table(spark, sf_dir, "documents"), from_byte_level(), keep=["doc_id"])


@registered
def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side, with the mask as text."""
    out = perspectives(table(spark, sf_dir, "conversations"))
    mask = mask_text()
    return out.select("conv_id", "speaker", "block", "n_turns", "text", F.when(mask != "", mask).alias("mask"))


LLM_SQL["op2_perspectives"] = CHAT_SQL


@registered
def op11_veb_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, one row a node."""
    return prefix_trie(table(spark, sf_dir, "conversations"), sequences=rebuilt)


LLM_SQL["op11_veb_trie"] = TRIE_SQL


@registered
def op12_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five best positives of every vector whose id is divisible by 100."""
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label)


LLM_SQL["op12_strassen_negatives"] = NEGATIVES_SQL


@registered
def op13_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls: page_id, host, path, rule, verdict."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


LLM_SQL["op13_link_graph"] = LINK_SQL
