"""Text metrics of pairs of texts and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import editdist
from quillspark.functions import text as T


SCORES = ("token_jaccard", "token_precision", "token_recall", "token_f1")


def with_token_scores(df: DataFrame, ref: str, hyp: str, names: tuple[str, ...] = SCORES) -> DataFrame:
    """Adds Jaccard, precision, recall and F1 of the sets of word tokens; ``ref`` is the reference side.

    In steps, so that each text is tokenised once and not once per use. The reference's distinct tokens are taken
    from a column named ``ref``_tokens where there is one.
    """
    known = F.col(f"{ref}_tokens") if f"{ref}_tokens" in df.columns else F.array_distinct(T.tokens(T.text(ref)))
    out = df.withColumns({"_r": known, "_h": F.array_distinct(T.tokens(T.text(hyp)))})
    out = out.withColumns({"_both": F.size(F.array_intersect("_r", "_h")).cast("double"), "_nr": F.size("_r").cast("double"), "_nh": F.size("_h").cast("double")})
    both, r, h = F.col("_both"), F.col("_nr"), F.col("_nh")
    p, q = T.safe_div(both, h), T.safe_div(both, r)
    scores = {"token_jaccard": T.safe_div(both, r + h - both), "token_precision": p, "token_recall": q, "token_f1": T.safe_div(2 * p * q, p + q)}
    return out.withColumns({n: scores[s] for n, s in zip(names, SCORES)}).drop("_r", "_h", "_both", "_nr", "_nh")


def comparison(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Adds delta_char, delta_word and the token scores; ``theirs`` is the reference side."""
    out = df.withColumns({"delta_char": editdist.normalised(F.col(ours), F.col(theirs)), "delta_word": editdist.normalised(F.col(ours), F.col(theirs), "tokens")})
    return with_token_scores(out, theirs, ours)


def against_reference(df: DataFrame, reference: str, hypothesis: str, rates: bool = True) -> DataFrame:
    """Adds cer, wer (with ``rates``) and the token scores; all null where the reference is blank."""
    some = T.strip(T.text(reference)) != ""
    out = with_token_scores(df.withColumn("_some", some), reference, hypothesis)
    if rates:
        out = out.withColumns({"cer": editdist.cer(F.col(reference), F.col(hypothesis)), "wer": editdist.wer(F.col(reference), F.col(hypothesis))})
    return out.withColumns({k: F.when(F.col("_some"), F.col(k)) for k in (*SCORES, *(("cer", "wer") if rates else ()))}).drop("_some")


def average_confidence(words: Column) -> Column:
    """Mean of the words' confidences above 0; null if there is none."""
    own = F.filter(F.transform(words, lambda w: w["confidence"]), lambda c: c > 0)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, c: a + c) / F.size(own))


def intrinsic(text: Column, words: Column, latency: Column) -> Column:
    return F.struct(F.size(T.tokens(T.text(text))).alias("tokens"), F.length(T.text(text)).alias("chars"), average_confidence(words).alias("avg_confidence"), latency.alias("latency_ms"), F.size(words).alias("word_box_count"))


def compute(df: DataFrame) -> DataFrame:
    """All metrics of rows with our_text, our_words, our_latency_ms, their_text, their_words, their_latency_ms, reference_text.

    Adds structs ours, theirs, comparison and, null where the reference is blank, our_reference, their_reference.
    """
    cols = F.col
    out = df.withColumns({s: intrinsic(cols(f"{w}_text"), cols(f"{w}_words"), cols(f"{w}_latency_ms")) for s, w in (("ours", "our"), ("theirs", "their"))})
    out = comparison(out, "our_text", "their_text").withColumn("comparison", F.struct("delta_char", "delta_word", *SCORES)).drop("delta_char", "delta_word", *SCORES)
    for w in ("our", "their"):
        own = ("cer", "wer", *SCORES[1:])
        out = against_reference(out, "reference_text", f"{w}_text").withColumn(f"{w}_reference", F.when(cols("cer").isNotNull(), F.struct(*own))).drop(*own, "token_jaccard")
    return out


def per_runner(rows: DataFrame) -> DataFrame:
    """One row per runner_label: counts, means over successful rows with a value, sample deviation of cer."""
    done = F.col("status") == "done"
    mean = lambda c: F.avg(F.when(done, F.col(c))).alias(f"mean_{c}")
    return rows.groupBy("runner_label").agg(
        F.count(F.lit(1)).alias("doc_count"), F.count_if(done).alias("success_count"), F.count_if(~done).alias("failure_count"),
        mean("cer"), mean("wer"), mean("token_f1"), mean("latency_ms"), F.stddev_samp(F.when(done, F.col("cer"))).alias("stdev_cer"),
    )


def evaluation(rows: DataFrame) -> DataFrame:
    """mean_cer, mean_wer, mean_field_accuracy over rows that have the value."""
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("cer", "wer", "field_accuracy")))


def confidence_summary(rows: DataFrame, by: list[str], column: str = "confidence") -> DataFrame:
    """count, average, min and max of finite confidences not below 0."""
    c = F.col(column)
    own = F.when((c >= 0) & ~F.isnan(c) & (c < float("inf")), c)
    return rows.groupBy(*by).agg(F.count(own).alias("count"), F.avg(own).alias("average"), F.min(own).alias("min"), F.max(own).alias("max"))


def skew_variance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Variance of the pixel sums of an image's rows; rows: by..., row_sum."""
    return rows.groupBy(*by).agg(F.var_pop("row_sum").alias("variance"))


