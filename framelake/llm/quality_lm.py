"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

classify() scores with the sharded subword model of sharded_lm: n-grams of code points
as they are, trained on all trusted text (quality 1) but a tenth, whose tables grow with
the corpus and are joined, never gathered.

A document is kept if its perplexity is at most its language's limit: a high quantile
of the trusted documents of that language that were left out of training, with some
slack. Copies of a text are left out together. Text that says the same over and over can be
as likely as any, so a document must also have as much variety for its length as all but a
few of those trusted documents: different n-grams over a power of all, from the same join.

Defined cases: null, empty texts have no perplexity (null) and are not kept; a null
lang is a language of its own; languages without left-out trusted documents take the
limits of all; with fewer than two different trusted texts nothing can be left out, so
limits and verdicts are null and false. Where the hash leaves out none or all of the trusted
texts, those of the least hash are left out. Repeated rows are all returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sharded_lm
from .common import stored

#: Quantile of trusted perplexities, and the slack on it; variety has the opposite quantile and a slack of its own.
QUANTILE, SLACK, VARIETY_SLACK = 0.995, 1.1, 2.0
#: Different n-grams grow about as this power of a text's length.
GROWTH = 0.8
#: One in so many trusted texts is left out of training.
LEFT_OUT = 10
#: Characters of average text added to every text, so that very short ones say little.
PRIOR_CHARS = 40
#: Trusted ids (8 bytes each) that are broadcast to pick out trusted texts; more are joined by shuffle.
MAX_BROADCAST_IDS = 4_000_000


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_units, perplexity, threshold, variety, least_variety, kept) of each row of docs."""
    trusted = stored(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "quality-trusted")
    few = trusted.count() <= MAX_BROADCAST_IDS
    good = trusted.withColumn("good", F.lit(True))
    marked = docs.select("doc_id", "lang", "text").join(F.broadcast(good) if few else good, "doc_id", "left").withColumn("mark", F.when(F.col("good") & (F.length("text") > 0), F.xxhash64("text")))
    out_by_hash = F.pmod("mark", F.lit(LEFT_OUT)) == 0
    n, every, low, high = marked.agg(F.count_if(out_by_hash), F.count("mark"), F.min("mark"), F.max("mark")).first()
    # On small tables none or all may have such a hash: then that of the least hash is left out.
    left_out = out_by_hash if 0 < n < every else F.col("mark") == F.lit(low) if low is not None and low < high else F.lit(False)
    marked = marked.withColumn("left_out", F.coalesce(left_out, F.lit(False)))
    shards = sharded_lm.model(sharded_lm.gram_counts(marked.select("text", (F.col("mark").isNotNull() & ~F.col("left_out")).alias("train"))))
    scored = stored(sharded_lm.scores(marked, shards, ("doc_id", "lang", "left_out")), "quality-scores")
    mean = scored.agg(F.sum("log_sum") / F.sum("n_units")).first()[0] or 0.0
    shrunk = F.exp(-(F.col("log_sum") + PRIOR_CHARS * mean) / (F.col("n_units") + PRIOR_CHARS))
    variety = (F.col("n_distinct") + PRIOR_CHARS) / F.pow(F.col("n_units") + PRIOR_CHARS, GROWTH)
    scored = scored.withColumns({"perplexity": F.when(F.col("n_units") > 0, shrunk), "variety": F.when(F.col("n_units") > 0, variety)})
    good = scored.where("left_out and perplexity is not null")
    most, least = F.percentile_approx("perplexity", QUANTILE, 10_000) * SLACK, F.percentile_approx("variety", 1 - QUANTILE, 10_000) / VARIETY_SLACK
    # One row for each language: bounded by the number of languages, joined by value.
    b = good.groupBy(F.col("lang").alias("_lang")).agg(most.alias("t"), least.alias("v"))
    rest = good.agg(most.alias("t"), least.alias("v")).first()
    out = scored.join(b, scored["lang"].eqNullSafe(b["_lang"]), "left")
    out = out.withColumns({"threshold": F.coalesce("t", F.lit(rest["t"]).cast("double")), "least_variety": F.coalesce("v", F.lit(rest["v"]).cast("double"))})
    kept = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("variety") >= F.col("least_variety")), F.lit(False))
    return out.select("doc_id", "lang", "n_units", "perplexity", "threshold", "variety", "least_variety", kept.alias("kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
