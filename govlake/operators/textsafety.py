"""Text safety in bulk (SAF-1 .. SAF-4, PRJ-5, PRJ-6).

The reference calls pretrained text models one text at a time.  Here the
models are learned from the labelled documents with Spark: a discriminative
lexicon (SAF-1, scored in SAF-2) and a logistic regression (SAF-4, used by
SAF-3).  Words are split on anything that is not a letter, in any language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.joins import join_null_safe
from ..functions.text import mask_card_numbers

WORD_SPLIT = "[^\\p{L}]+"

# The layer-1 result messages (the score is printed with two
# decimals between the two parts).
L1_FAILED = "⚠️ Layer 1 (ML) Safety Check FAILED. Toxicity: "
L1_PASSED = "✅ Layer 1 (ML) Safety Check PASSED. Toxicity: "
LEXICON_MIN_TOXIC_DOCS = 2
LEXICON_MIN_LOG_ODDS = 2.0
SMOOTHING = 0.5


def words(text: str | Column) -> Column:
    """Distinct lower-case words of a text (letters only, any script)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.array_remove(F.split(F.lower(t), WORD_SPLIT), ""))


def toxicity_lexicon(docs: DataFrame, labels: DataFrame,
                     min_toxic_docs: int = LEXICON_MIN_TOXIC_DOCS,
                     min_log_odds: float = LEXICON_MIN_LOG_ODDS) -> DataFrame:
    """SAF-1: words whose document frequency separates toxic from clean
    labelled documents, by smoothed log-odds.

    Each document's words are made distinct before the explode, so the
    shuffle carries one row per (document, word); word counts use partial
    aggregation, so a very common word is not one task's burden.  Every word
    that reaches both thresholds is kept."""
    lab = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    n_toxic = lab.agg(F.count_if(F.col("toxic") == 1)).scalar()
    n_clean = lab.agg(F.count_if(F.col("toxic") == 0)).scalar()
    per_word = lab.select("toxic", F.explode(words("text")).alias("word")) \
        .groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic_docs"),
                             F.count_if(F.col("toxic") == 0).alias("clean_docs"))
    a = SMOOTHING
    # the two totals are scalar subqueries, computed once
    lo = (F.log((F.col("toxic_docs") + a) / (n_toxic + 2 * a))
          - F.log((F.col("clean_docs") + a) / (n_clean + 2 * a)))
    scored = per_word
    return scored.withColumn("log_odds", F.round(lo, 6)) \
        .filter((F.col("toxic_docs") >= min_toxic_docs) & (F.col("log_odds") >= min_log_odds)) \
        .select("word", "toxic_docs", "clean_docs", "log_odds")


def layer1_scores(texts: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    """SAF-2: score every text by the distinct lexicon words it contains.

    hits -> toxicity = 1 - 0.5^hits and severe = 1 - 0.5^(hits-1) (0 for no
    hit), so one word gives 0.5 / 0.0, two 0.75 / 0.5, three 0.875 / 0.75.
    Fails as the reference does: toxicity > 0.7 or severe > 0.5.

    The lexicon grows with the data: the texts' distinct words meet it in an
    equi-join (Spark broadcasts it only if its size statistics allow), and the
    matches are counted per key with partial aggregation.  ``keys`` identify a
    text; a null key is a key of its own."""
    found = texts.select(*keys, F.explode(words(text_col)).alias("word")) \
        .join(lexicon.select("word"), "word").groupBy(*keys).agg(F.count("*").alias("_found"))
    texts = join_null_safe(texts.select(*keys), found, keys, "left")
    hits = F.coalesce(F.col("_found"), F.lit(0)).cast("bigint")
    h = F.col("hits")
    tox = F.round(1 - F.pow(F.lit(0.5), h), 6)
    sev = F.round(F.when(h > 0, 1 - F.pow(F.lit(0.5), h - 1)).otherwise(F.lit(0.0)), 6)
    failed = (tox > S.TOXICITY_MAX) | (sev > S.SEVERE_TOXICITY_MAX)
    return texts.select(*keys, hits.alias("hits")).select(
        *keys, "hits", tox.alias("toxicity"), sev.alias("severe_toxicity"),
        (~failed).alias("passed"),
        F.concat(F.when(failed, F.lit(L1_FAILED)).otherwise(F.lit(L1_PASSED)),
                 F.format_number(tox, 2),
                 F.when(failed, F.lit(". Request blocked."))
                 .otherwise(F.lit(". Proceeding to Layer 2."))).alias("message"))


#: Weight of the squared standardised coefficients in the model's loss.
REG_PARAM = 0.01


def toxicity_model(docs: DataFrame, labels: DataFrame, seed: int = 42,
                   num_features: int = 1 << 16, train_fraction: float = 0.8):
    """SAF-4: logistic regression on hashed word counts of labelled documents.

    Returns (fitted pipeline model, train frame, test frame)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    lab = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id") \
        .withColumn("label", F.col("toxic").cast("double"))
    # split by the hash of the id: the same rows whatever the partitioning
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1000)) / 1000
    train, test = lab.filter(share < train_fraction), lab.filter(share >= train_fraction)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=WORD_SPLIT, toLowercase=True),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features, binary=True),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=200, tol=1e-9, regParam=REG_PARAM,
                           elasticNetParam=0.0),
    ])
    return pipe.fit(train), train, test


def model_optimality(model, train: DataFrame, test: DataFrame) -> DataFrame:
    """SAF-4's fit, checked from outside: one row with the sizes and toxic rows of
    both sides of the split, ``expected_toxic`` (the sum of the probabilities
    over the training rows: with a free intercept it equals the toxic rows), and
    ``max_gradient``, the largest partial derivative of the regularised loss.

    At the optimum mean((p - y) x_j) + REG_PARAM s_j^2 b_j is 0 for every feature j
    (s_j: its standard deviation).  The three sums are weighted summaries of the
    feature vectors, partially aggregated; a vector of ``num_features`` numbers
    comes to the driver, whatever the number of documents."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    lr = model.stages[-1]
    scored = model.transform(train).select("features", "label", vector_to_array("probability")[1].alias("p"))
    # the weighted sums of the vectors: mean times the sum of weights
    row = scored.agg(
        F.count("*").alias("n"), F.sum("label").alias("y"), F.sum("p").alias("p"),
        Summarizer.mean(F.col("features"), F.col("label")).alias("toxic_mean"),
        Summarizer.mean(F.col("features"), F.col("p")).alias("p_mean"),
        Summarizer.std(F.col("features")).alias("std")).first()
    gradient = (row.p_mean.toArray() * row.p - row.toxic_mean.toArray() * row.y) / row.n \
        + REG_PARAM * row.std.toArray() ** 2 * lr.coefficients.toArray()
    out = test.agg(F.count("*").alias("n_test"), F.count_if(F.col("label") == 1).alias("test_toxic"))
    return out.select(F.lit(row.n).cast("bigint").alias("n_train"), F.lit(int(row.y)).cast("bigint").alias("train_toxic"),
                      "n_test", "test_toxic", F.lit(float(row.p)).alias("expected_toxic"),
                      F.lit(float(abs(gradient).max())).alias("max_gradient"))


def text_safety_check(scored: DataFrame, threshold: float = S.OFFENSIVE_SCORE_MIN) -> DataFrame:
    """SAF-3: is_safe, risk_category, confidence from SAF-4 probabilities.

    The label is offensive when its probability is the larger one; a text is
    blocked only if that probability exceeds ``threshold``.  A missing score
    gives category Error and counts as safe (as the reference, flagged)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    # vectors cannot be taken apart where they are null, so those get a stand-in first
    p = vector_to_array(F.coalesce("probability", array_to_vector(F.array(F.lit(1.0), F.lit(0.0)))))
    p = F.when(F.col("probability").isNotNull(), p)
    p_off = p[1]
    offensive = p_off >= p[0]
    score = F.greatest(p[0], p[1])
    blocked = offensive & (p_off > threshold)
    return scored.select(
        "doc_id", F.when(F.col("probability").isNull(), True).otherwise(~blocked).alias("is_safe"),
        F.when(F.col("probability").isNull(), "Error").when(blocked, "Offensive")
         .otherwise("None").alias("risk_category"),
        F.coalesce(F.round(score, 6), F.lit(0.0)).alias("confidence"),
        F.when(offensive, "offensive").otherwise("non-offensive").alias("label"))


def mask_account_numbers(texts: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ-5: show only the last four digits of long digit runs (COMP-001):
    any run of 13 or more digits, and 16 or 15 digits in groups (4-4-4-4 and
    4-6-5) split by spaces or dashes."""
    return texts.withColumns({c: mask_card_numbers(c) for c in cols})


def sensitive_text_scan(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """PRJ-6: counts of e-mail addresses, card numbers, phone numbers, IPv4
    addresses and secret tokens in every text (SAFETY-004)."""
    t = F.col(text_col)
    # a byte search first where a pattern needs a fixed character
    guard = {"email": "@", "phone": "(", "token": "token"}
    counts = [(F.when(t.contains(guard[k]), F.regexp_count(t, F.lit(p))).otherwise(F.lit(0))
               if k in guard else F.regexp_count(t, F.lit(p))).cast("bigint").alias(f"n_{k}")
              for k, p in S.SENSITIVE_PATTERNS.items()]
    out = texts.select(*keys, *counts)
    any_hit = None
    for k in S.SENSITIVE_PATTERNS:
        c = F.col(f"n_{k}") > 0
        any_hit = c if any_hit is None else (any_hit | c)
    return out.withColumn("has_sensitive", any_hit)
