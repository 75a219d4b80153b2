"""Mixing sources to target weights.

Tokens are summed per source and turned into repetition rates; every document
comes out floor(rate) times and once more with the rest's probability, drawn
from a hash of seed and document, so a mix can be repeated exactly.

Without ``total_tokens`` the mix is the largest in which every source reaches
its share within its ``max_repeats``. With it, a source that cannot fill its
share is used ``max_repeats`` times and the others share the rest in
proportion. Per-source sums (one row per target, a table of fixed size) are the
only thing the driver sees.

Defined results: sources match regardless of case, blanks, and hyphen or
underscore; null and unwanted sources, and documents without tokens, are not
used; a wanted source without tokens has share 0, and the others keep their
proportions; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm import tokenizer
from archivolt.session import materialize, scratch_dir


def source_key(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_")


def token_counts(docs: DataFrame, id_col: str, text: str, source: str, **tokenizer_args) -> DataFrame:
    """(id, source, tokens) of every document, written once."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), source_key(source).alias("source"), F.col(text).alias("text"))
    counted = tokenizer.encode(keyed, ["doc_id", "source"], "text", ids="tokens", count_only=True, **tokenizer_args)
    return materialize(counted, f"{scratch_dir(docs.sparkSession)}/tokens")


def rates(totals: dict[str, float], targets: dict[str, tuple[float, float]], total_tokens: float | None = None) -> dict[str, float]:
    """Repetition rate of every usable source from its tokens and its (share, max_repeats)."""
    live = {s: (share, cap * totals[s]) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and totals.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())
    room = total_tokens if total_tokens is not None else min(most / (share / whole) for share, most in live.values())
    want: dict[str, float] = {}
    for s, (share, most) in sorted(live.items(), key=lambda x: x[1][1] / x[1][0]):
        want[s] = min(most, room * share / whole)
        room, whole = room - want[s], whole - share
    return {s: t / totals[s] for s, t in want.items()}


def mix(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, copy, tokens, rate): a row for every use of a document."""
    spark = counted.sparkSession
    wanted = targets.groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    sums = wanted.join(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left").collect()
    rate = rates({r.source: r.tokens or 0 for r in sums}, {r.source: (r.share or 0, r.cap or 0) for r in sums}, total_tokens)
    table = spark.createDataFrame([(s, float(r)) for s, r in rate.items()], "source string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    used = counted.where("tokens > 0").join(F.broadcast(table), "source").withColumn("copies", copies).where("copies > 0")
    return used.select("doc_id", "source", F.explode(F.expr("sequence(1, cast(copies AS int))")).alias("copy"), "tokens", "rate")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every wanted source."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("rate").alias("rate"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("target_share"))
    return (
        wanted.join(got, "source", "left")
        .join(F.broadcast(all_tokens))
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("uses", F.lit(0)).alias("uses"),
            F.coalesce("rate", F.lit(0.0)).alias("rate"),
        )
    )
