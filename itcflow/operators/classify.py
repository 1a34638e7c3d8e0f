"""Purchase classification over description columns.

Layer 1 is the ordered keyword rule list as JVM expressions. Layers 2/3 (a
zero-shot model and a fine-tuned model in the application, both remote)
are *score tables* ``(doc_id, label, score)`` joined in: whoever produces
scores (a batch inference job, or the ``with_scorer`` pandas hook) writes
a table, and the classifier stays a join + coalesce.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..functions import keywords as K


def category_dim(spark) -> DataFrame:
    """The 8-row category dimension (name, blocked, reason)."""
    return spark.createDataFrame(fixed.CATEGORY_MAP, "category string, blocked boolean, reason string")


def label_dim(spark) -> DataFrame:
    """13 zero-shot labels, k = 1..13 in list order, mapped to categories."""
    rows = [(i + 1, lab, cat) for i, (lab, cat) in enumerate(fixed.ZERO_SHOT_LABELS)]
    return spark.createDataFrame(rows, "k int, label string, category string")


def with_category(df: DataFrame, cat: str = "category") -> DataFrame:
    """Blocked flag and reason of a category; unknown -> Other's.
    The dimension is a fixed 8-row literal: a broadcast of proven size."""
    d = F.broadcast(category_dim(df.sparkSession).withColumnRenamed("category", "_c"))
    other = dict((c, (b, r)) for c, b, r in fixed.CATEGORY_MAP)["Other"]
    j = df.join(d, df[cat] == d["_c"], "left").drop("_c")
    return (j.withColumn("blocked", F.coalesce("blocked", F.lit(other[0])))
             .withColumn("reason", F.coalesce("reason", F.lit(other[1]))))


def classify_keywords(df: DataFrame, col: str = "description", match: str = "substring",
                      matched: bool = True) -> DataFrame:
    """F8: keyword layer: category, 0.85 (hit) / 0.60 (no hit), blocked, reason
    and, with ``matched``, the matched keywords of the winning group."""
    out = df.withColumn("_low", F.lower(F.col(col)))
    out = out.withColumn("category", K.first_group(F.col("_low"), fixed.KEYWORD_RULES, "Other", match))
    if matched:
        out = out.withColumn("matched_keywords", K.matched_words(F.col("_low"), F.col("category"), fixed.KEYWORD_RULES))
    out = with_category(out.drop("_low"), "category")
    out = out.select(*df.columns, "category", *["matched_keywords"] * matched, "blocked", "reason")
    hit = F.col("category") != "Other"
    return (out.withColumn("confidence", F.when(hit, F.lit(fixed.KEYWORD_CONFIDENCE))
                                          .otherwise(F.lit(fixed.NO_KEYWORD_CONFIDENCE)))
               .withColumn("reason", F.when(hit, F.concat(F.col("reason"), F.lit(" (keyword match)")))
                                      .otherwise(F.lit(fixed.UNCLASSIFIED_REASON))))


def top_label(scores: DataFrame, key: str = "doc_id", label: str = "label", k_col: str | None = "k") -> DataFrame:
    """top label and score per key (ties -> smaller k), plus the top-3
    (label -> score rounded to 3) map. At most one row per label per key, so
    the per-key list is bounded by the label set."""
    order = F.struct(F.col("score"), (-F.col(k_col)) if k_col else F.lit(0))
    top3 = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("ns"),
                                                        (F.col(k_col) if k_col else F.lit(0)).alias("kk"),
                                                        F.col(label).alias("lab"), F.col("score").alias("s"))), True), 1, 3)
    g = scores.groupBy(key).agg(F.max_by(F.col(label), order).alias("top_label"),
                                F.max(F.col("score")).alias("top_score"), top3.alias("_t3"))
    return g.select(key, "top_label", "top_score",
                    F.map_from_entries(F.transform("_t3", lambda x: F.struct(x["lab"], F.round(x["s"], 3))))
                     .alias("all_scores"),
                    F.array_join(F.transform("_t3", lambda x: F.concat(x["lab"], F.lit("="),
                                                                       F.round(x["s"], 3).cast("string"))), ";")
                     .alias("top3"))


def map_label(df: DataFrame, label: str = "top_label") -> DataFrame:
    """Zero-shot label -> category (13-row broadcast literal), default Other."""
    d = F.broadcast(label_dim(df.sparkSession).select(F.col("label").alias("_l"), F.col("category").alias("zs_category")))
    j = df.join(d, df[label] == d["_l"], "left").drop("_l")
    return j.withColumn("zs_category", F.coalesce("zs_category", F.lit("Other")))


def zero_shot_top(zs: DataFrame, spark) -> DataFrame:
    """Zero-shot score rows (doc_id, k, score) -> top label per doc -> category."""
    lab = F.broadcast(label_dim(spark).select("k", "label"))
    t = top_label(zs.join(lab, "k"))
    return map_label(t)


def classify_layered(df: DataFrame, col: str, zs: DataFrame | None = None, ft: DataFrame | None = None,
                     key: str = "doc_id") -> DataFrame:
    """keyword layer; else the zero-shot layer when it names a non-Other
    category; else the fine-tuned layer; else Other at 0.5. Fewer than 3
    non-blank characters -> Other at 0 ('No description')."""
    spark = df.sparkSession
    # the text ends here: the joins below carry the category and its words only
    short = F.col(col).isNull() | (F.length(F.trim(F.col(col))) < 3)
    x = classify_keywords(df, col).select(key, short.alias("_short"), F.col("category").alias("kw_cat"), "matched_keywords")
    if zs is not None:
        z = zero_shot_top(zs, spark).select(key, F.col("zs_category"), F.round("top_score", 3).alias("zs_conf"))
        x = x.join(z, key, "left")
    else:
        x = x.withColumn("zs_category", F.lit(None).cast("string")).withColumn("zs_conf", F.lit(None).cast("double"))
    if ft is not None:
        f = top_label(ft, key, "label", "k").select(key, F.col("top_label").alias("ft_cat"),
                                                     F.round("top_score", 3).alias("ft_conf"))
        x = x.join(f, key, "left")
    else:
        x = x.withColumn("ft_cat", F.lit(None).cast("string")).withColumn("ft_conf", F.lit(None).cast("double"))
    short = F.col("_short")
    use_kw = F.col("kw_cat") != "Other"
    use_zs = F.col("zs_category").isNotNull() & (F.col("zs_category") != "Other")
    use_ft = F.col("ft_cat").isNotNull()
    layer = (F.when(short, "none").when(use_kw, "keyword").when(use_zs, "zero_shot")
              .when(use_ft, "fine_tuned").otherwise("fallback"))
    cat = (F.when(short, "Other").when(use_kw, F.col("kw_cat")).when(use_zs, F.col("zs_category"))
            .when(use_ft, F.col("ft_cat")).otherwise("Other"))
    conf = (F.when(short, F.lit(0.0)).when(use_kw, F.lit(fixed.KEYWORD_CONFIDENCE)).when(use_zs, F.col("zs_conf"))
             .when(use_ft, F.col("ft_conf")).otherwise(F.lit(fixed.FALLBACK_CONFIDENCE)))
    y = x.select(key, layer.alias("layer"), cat.alias("category"), conf.alias("confidence"),
                 F.when(use_kw & ~short, F.col("matched_keywords")).otherwise(F.array().cast("array<string>"))
                  .alias("matched_keywords"))
    y = with_category(y, "category")
    reason = (F.when(F.col("layer") == "none", F.lit(fixed.NO_DESCRIPTION_REASON))
               .when(F.col("layer") == "keyword", F.concat(F.col("reason"), F.lit(" (keyword match)")))
               .when(F.col("layer") == "fallback", F.lit(fixed.UNCLASSIFIED_REASON))
               .otherwise(F.col("reason")))
    blocked = F.when(F.col("layer").isin("none", "fallback"), F.lit(False)).otherwise(F.col("blocked"))
    return y.withColumn("reason", reason).withColumn("blocked", blocked)


def description_of(df: DataFrame) -> F.Column:
    """description -> item_name -> product -> default text ('' = missing)."""
    cols = [c for c in ("description", "item_name", "product") if c in df.columns]
    return F.coalesce(*[C.blank_to_null(c) for c in cols], F.lit(fixed.DEFAULT_DESCRIPTION))


def classify_invoices(inv: DataFrame, zs: DataFrame | None = None, ft: DataFrame | None = None) -> DataFrame:
    """F11 (+F1): classify each invoice's description and split its ITC
    (igst if positive else cgst+sgst) into eligible and blocked amounts."""
    src = inv.select(F.col("id").alias("doc_id"), description_of(inv).alias("text"), "cgst", "sgst", "igst")
    if zs is None and ft is None:  # descriptions repeat: each distinct one is classified once
        j = src.join(classify_layered(src.select("text").distinct(), "text", key="text"), "text")
    else:
        j = src.join(classify_layered(src.select("doc_id", "text"), "text", zs, ft), "doc_id")
    tax = C.itc_exclusive()
    zero = F.lit(0).cast(C.MONEY)
    return j.select(F.col("doc_id").alias("id"), "category", "confidence", "layer", "blocked", "reason",
                    "matched_keywords", C.to_double(F.round(tax, 2)).alias("total_tax"),
                    C.to_double(F.when(F.col("blocked"), zero).otherwise(tax)).alias("itc_eligible"),
                    C.to_double(F.when(F.col("blocked"), tax).otherwise(zero)).alias("itc_blocked"))


def rule_coverage(classified: DataFrame) -> DataFrame:
    """How often each keyword of the winning group fired."""
    return (classified.select("category", F.explode("matched_keywords").alias("keyword"))
                      .groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("n")))


def with_scorer(df: DataFrame, scorer, key: str = "doc_id", col: str = "text") -> DataFrame:
    """L3: run a user scorer (a pandas_udf returning struct<label,score>) over a
    text column and return the score table (key, label, score) for layer 3.
    Arrow batches, one vectorised call per batch; no per-row Python loop here."""
    s = df.select(key, scorer(F.col(col)).alias("_s"))
    return s.select(key, F.col("_s.label").alias("label"), F.col("_s.score").alias("score"))


def demo_scorer():
    """A stand-in layer-3 model for L3: the vowel share of the text picks a
    category. Vectorised pandas over Arrow batches, as a real model would be."""
    cats = [c for c, _, _ in fixed.CATEGORY_MAP]

    @F.pandas_udf("struct<label:string,score:double>")
    def scorer(s: pd.Series) -> pd.DataFrame:
        low = s.fillna("").str.lower()
        n = low.str.len().clip(lower=1)
        v = low.str.count("[aeiou]") / n
        idx = (v * 1000).astype(int) % len(cats)
        return pd.DataFrame({"label": [cats[i] for i in idx], "score": (v * 100).round() / 100})

    return scorer
