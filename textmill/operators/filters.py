"""Document filters and character budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import NTH, SAME, numbered, with_lines
from ..functions.ranking import running_sum
from ..functions.sizing import broadcast_if_small
from ..functions.text import doc_cap, lang_letter_ratio


def source_filter(docs: DataFrame, spec: DataFrame, scores: DataFrame | None = None,
                  key: str = "doc_id", threshold: float = 2.0,
                  extra: Column | None = None, text_cols: Sequence[str] = ("text",)) -> DataFrame:
    """Keep documents that pass their source's rules.

    spec: ``(source, min_len, use_score, ...)``.  A document survives when its
    text is non-empty, ``length(text) >= min_len`` and, for sources with
    ``use_score``, ``coalesce(score, 0) >= threshold``.  ``scores`` is
    ``(key, score)``, one row per key; the texts are read once, and only keys that
    pass are joined.  ``extra`` is an optional user predicate, on the columns of
    ``docs``.  If spec has ``text_col``, it names the column of ``text_cols`` that
    holds the source's text, which becomes ``text``.
    """
    if extra is not None:
        docs = docs.filter(extra)
    named = ["text_col"] if "text_col" in spec.columns else []
    s = broadcast_if_small(spec.select("source", "min_len", "use_score", *[F.col(c).alias("_text_col") for c in named]))
    d = docs.join(s, "source")
    if named:
        own = F.coalesce(*[F.when(F.col("_text_col") == c, F.col(c)) for c in text_cols])
        d = d.withColumn("text", own).drop("_text_col", *[c for c in text_cols if c != "text"])
    d = d.filter(F.col("text").isNotNull() & (F.length("text") > 0) & (F.length("text") >= F.col("min_len")))
    # keys that pass (or, where a missing score passes, those that fail); documents of free sources
    # ask for no key, so that they are neither matched nor in one group
    if scores is None:
        ok = F.lit(threshold <= 0)
    else:
        above = F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(threshold)
        known = broadcast_if_small(scores.filter(above if threshold > 0 else ~above).select(F.col(key).alias("_key"), F.lit(True).alias("_known")))
        d = d.join(known, F.col("use_score") & (F.col(key) == F.col("_key")), "left")
        ok = F.col("_known").isNotNull() if threshold > 0 else F.col("_known").isNull()
    return d.filter(~F.col("use_score") | ok).drop("min_len", "use_score", "_key", "_known")


def char_budget_sample(docs: DataFrame, max_chars: int, cap: int, order: list[str]) -> DataFrame:
    """In ``order``, keep docs while the exclusive running sum of capped lengths <= max_chars.

    The document that crosses the budget is included (its prefix sum is still
    within budget).  Adds ``capped`` text and ``cum_before``.  Only order keys and
    lengths are ranked; the text is joined to the keys that stay.
    """
    size = F.coalesce(F.length(doc_cap("text", cap)), F.lit(0)).cast("long")
    keys = numbered(docs, order, {"_n": size})
    kept = running_sum(keys, "_n", [*order, *SAME, NTH], out="cum_before", inclusive=False)
    kept = kept.filter(F.col("cum_before") <= max_chars).select(*order, *SAME, "cum_before")
    d = with_lines(docs, kept, order)
    return d.withColumn("capped", doc_cap("text", cap))


def lang_filter(df: DataFrame, text: str, letters: str, threshold: float = 0.005) -> DataFrame:
    return df.filter(lang_letter_ratio(text, letters) >= threshold)
