"""Mixing sources to target token shares by entropy balancing.

Sizes are tokens of a public tokenizer. Among all document rates w with 0 ≤ w ≤ max_repeats whose tokens add up to each
source's target, the ones nearest to "every record once" in relative entropy are exponentially tilted by document size,
w = min(cap, exp(λ · tokens / mean tokens)), with one multiplier λ per source: the convex dual. Newton steps on the
multipliers are distributed sums over a histogram of (source, tokens), which holds the same sums as the documents
because the rate depends on nothing else. Rates become whole copies by systematic rounding in salted buckets of each
source, so that neither a source with most of the rows nor the driver holds it all.

Defined results: records without a source, or of a source without a target, belong to no mix and do not appear; a
target source without tokens cannot be reached and is reported with share 0, the others keep their ratio; empty and null
texts have 0 tokens and rate 1; repeated rows are records of their own; the total is the largest one all caps allow
unless given; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: File of the public tokenizer, looked up in the tokenizer package.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Records per rounding bucket, Newton steps at most, relative error at which they stop.
BUCKET, STEPS, TOLERANCE = 20_000, 60, 1e-10


def _encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of its text. Narrow; the encoder is built once per worker."""
    held: list = []

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(_encoding(tokenizer))
        for s in batches:
            yield pd.Series([len(held[0].encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn(out, count(F.col(text)))


def balance(hist: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Multipliers by source, and mean tokens by source, for a histogram (source, tokens, n)."""
    sums = {r["source"]: (r["n"], r["t"]) for r in hist.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    live = {s: v for s, v in targets.items() if v[0] > 0 and v[1] > 0 and sums.get(s, (0, 0))[1]}
    if not live:
        return {}, {}
    mean = {s: sums[s][1] / sums[s][0] for s in live}
    most = min(live[s][1] * sums[s][1] / live[s][0] for s in live)
    total = min(total or most, most)
    want = {s: total * live[s][0] / mean[s] for s in live}
    lam = {s: 0.0 for s in live}
    low, high = {s: -math.inf for s in live}, {s: math.inf for s in live}
    session = hist.sparkSession
    for _ in range(STEPS):
        now = F.broadcast(session.createDataFrame([(s, lam[s], mean[s], float(live[s][1])) for s in live], "source string, lam double, mean double, cap double"))
        x = F.col("tokens") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        w = F.least(raw, F.col("cap"))
        sums_now = hist.join(now, "source").groupBy("source").agg(
            F.sum(F.col("n") * w * x).alias("g"), F.sum(F.when(raw < F.col("cap"), F.col("n") * w * x * x).otherwise(0.0)).alias("h")
        ).collect()
        worst = 0.0
        for r in sums_now:
            s = r["source"]
            gap = r["g"] - want[s]
            worst = max(worst, abs(gap) / want[s])
            if abs(gap) <= TOLERANCE * want[s]:
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / r["h"] if r["h"] > 0 else math.inf
            if not low[s] < step < high[s]:  # Newton left the bracket of the convex dual
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else lam[s] + (4.0 if gap < 0 else -4.0)
            lam[s] = step
        if worst <= TOLERANCE or all(lam[s] > 600 or abs(high[s] - low[s]) < 1e-12 for s in live):
            break
    return lam, mean


def mixed(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER, total: float | None = None) -> DataFrame:
    """(key, source, tokens, rate, copies) of every record of a target source."""
    stated = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").collect()}
    own = df.filter(F.col(source).isin(list(stated))).select(F.col(key).alias("_k"), F.col(source).alias("source"), text)
    sized = cut(with_tokens(own, text, tokenizer).select("_k", "source", "tokens"))
    hist = cut(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    lam, mean = balance(hist, stated, total)
    rows = [(s, lam[s], mean[s], float(stated[s][1])) for s in lam]
    plan = df.sparkSession.createDataFrame(rows, "source string, lam double, mean double, cap double")
    n = {r["source"]: r["n"] for r in hist.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sizes = df.sparkSession.createDataFrame([(s, max(1, math.ceil(n[s] / BUCKET))) for s in lam], "source string, buckets int")
    rated = sized.join(F.broadcast(plan.join(sizes, "source")), "source").withColumn(
        "rate", F.least(F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0))), F.col("cap"))
    )
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64("_k", F.lit("bucket")), F.col("buckets")))
    run = F.sum("rate").over(Window.partitionBy("source", "bucket").orderBy("tokens", "_k").rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64("source", "bucket"), F.lit(1000)) / 1000.0
    rated = rated.withColumn("run", F.round(run, 6))
    copies = F.floor(F.col("run") + start) - F.floor(F.round(F.col("run") - F.col("rate"), 6) + start)
    return rated.select(F.col("_k").alias(key), "source", "tokens", F.round("rate", 9).alias("rate"), F.least(copies, F.col("cap").cast("long")).cast("int").alias("copies"))


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens there are, tokens in the mix, the share reached and the greatest number of copies."""
    by = mix.groupBy("source").agg(
        F.count("*").alias("n_records"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies")
    )
    out = targets.join(F.broadcast(by), "source", "left").fillna(0, ["n_records", "tokens", "mixed_tokens", "most_copies"])
    return out.withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy())), F.lit(0.0)))
