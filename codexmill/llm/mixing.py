"""Problem 8: mixing sources to target weights.

Method: a low-discrepancy schedule. Slot i of the mixture has the golden-ratio point (i + 1/2) * PHI modulo 1, in integers
modulo 2**60, which the cumulative weights map to a source; slots are ranked within their source, and the r-th slot of a
source takes block r mod n of its n blocks; r div n is the repetition, which never reaches max_repeats. A source's
documents are laid end to end in a shuffled order (by a hash of seed and id) and cut every BLOCK tokens: blocks are of
equal size (but the last), and a document that spans several has a part in each. So every slot that is scheduled has its
block, and the shares are those of the schedule.

The size of the mixture is what the sources with a positive weight hold in all (or `total`). A source that cannot fill
its share gives all it has max_repeats times; the others keep their proportions to each other, and the actual shares
are reported. `total="targets"` takes the largest size at which no source with documents runs out, so that all their
targets hold (p8_targets). Sizes are token counts of a public tokenizer by this package's own encoder.

Defined results: documents without tokens (null or empty texts) and of no listed source are left out; a null or
negative weight counts as 0; a null max_repeats as 1; sources without documents appear in the report with 0; a
repeated row of a document counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.llm.common import table
from codexmill.llm.tokenize import encode_column
from codexmill.operators.skew import running_sum
from codexmill.session import materialise, texts

#: Points are integers below 2**60; the golden ratio's is cut into three parts of 20 bits, so that products fit in 63.
ONE = 1 << 60
PHI = 0x9E3779B97F4A7C1
#: Tokens of a block, and so the grain of the schedule.
BLOCK = 256
#: Ranges of hash values in which running sums are taken apart, so that no task holds a whole source.
RANGES = 1024
#: Slots whose ranks are counted in one step.
SLOTS = 1 << 14


def point(i: Column) -> Column:
    """The golden-ratio point of slot i < 2**42, exactly: (i * PHI + PHI / 2) modulo 2**60."""
    low, mid, high = PHI & 0xFFFFF, PHI >> 20 & 0xFFFFF, PHI >> 40
    sum_ = (i * high % (1 << 20)) * (1 << 40) + (i * mid % (1 << 40)) * (1 << 20) + i * low % ONE + PHI // 2
    return sum_ % ONE


def schedule(spark, sized: DataFrame, mix: DataFrame, total: int | str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(slots, plan): slot, source and rank of every slot; per source its tokens, blocks and quota."""
    plan = mix.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "source", "left").select(
        "source", "target_weight", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
    # source_mix is a fixed table of 32 rows; its plan is as small
    p = plan.toPandas().sort_values("source").reset_index(drop=True)
    most = (p.repeats * p.tokens).astype(float)
    if total == "targets":
        able = (p.w > 0) & (most > 0)
        size = float((most[able] / (p.w[able] / (p.w[able].sum() or 1.0))).min()) if able.any() else 0.0
        p["quota"] = (p.w.where(able, 0.0) / (p.w[able].sum() or 1.0) * size).clip(upper=most)
    else:
        size = float(total if total is not None else p.tokens[p.w > 0].sum())
        p["quota"] = (p.w / (p.w.sum() or 1.0) * size).clip(upper=most)
    p["n_blocks"] = -(-p.tokens // block)
    p["turns"] = p.quota * p.n_blocks / p.tokens.clip(lower=1)  # slots: a source's blocks are of equal size
    n = int(round(p.turns.sum()))
    if not len(p) or n == 0:
        return spark.createDataFrame([], "slot long, source string, rank long, n_blocks long, repeats int"), plan
    hi = [min(round(x * ONE), ONE) for x in p.turns.cumsum() / (p.turns.sum() or 1.0)]
    p["hi"], p["lo"] = hi, [0, *hi[:-1]]
    p = p[p.quota > 0]
    p.loc[p.index[-1:], "hi"] = ONE
    bounds = F.broadcast(spark.createDataFrame(p[["source", "lo", "hi", "n_blocks", "repeats"]]))
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"), F.floor(F.col("id") / SLOTS).alias("range"))
    slots = slots.join(bounds, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("u", "lo", "hi")
    slots = running_sum(slots, "source", "range", ["slot"], F.lit(1)).select("slot", "source", F.col("before").alias("rank"), "n_blocks", "repeats")
    return slots.where("rank < n_blocks * repeats"), plan


def mix(docs: DataFrame, source_mix: DataFrame, total: int | str | None = None, block: int = BLOCK, seed: int = 1, tokenizer: str = "byte_bpe_50k") -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of documents (doc_id, source, text): the mixture has a row for each part of a document in each slot."""
    spark = docs.sparkSession
    source_mix = source_mix.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    listed = docs.where("source is not null and text is not null and text <> ''").join(F.broadcast(source_mix.select("source")), "source", "left_semi")
    counted = encode_column(listed.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text", tokenizer, ids=False)
    h = F.xxhash64(F.lit(seed), "doc_id")
    counted = counted.where("n_tokens > 0").select("k.doc_id", "k.source", "n_tokens").distinct()
    sized = materialise(counted.select("*", h.alias("h"), F.shiftrightunsigned(h, 64 - RANGES.bit_length() + 1).alias("range")), "token-counts")
    placed = running_sum(sized, "source", "range", ["h", "doc_id"], F.col("n_tokens")).select("doc_id", "source", "n_tokens", "before")
    b = F.explode(F.sequence(F.expr(f"before div {block}"), F.expr(f"(before + n_tokens - 1) div {block}"))).alias("block")
    parts = placed.select("doc_id", "source", "before", "n_tokens", b)
    start, stop = F.greatest(F.col("block") * block, "before"), F.least((F.col("block") + 1) * block, F.col("before") + F.col("n_tokens"))
    parts = parts.select("source", "block", "doc_id", (start - F.col("before")).alias("token_offset"), (stop - start).alias("n_tokens"))
    slots, plan = schedule(spark, sized, source_mix, total, block)
    slots = slots.select("slot", "source", (F.col("rank") % F.col("n_blocks")).alias("block"), F.expr("rank div n_blocks").alias("repetition"))
    mixture = slots.join(parts, ["source", "block"]).select("slot", "source", "doc_id", "repetition", "token_offset", "n_tokens")
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used"), (F.max("repetition") + 1).alias("most_used"))
    whole = Window.partitionBy()  # over the report's rows, one for each listed source
    report = plan.join(got, "source", "left").select("source", "target_weight", F.col("tokens").alias("available_tokens"), F.coalesce("used", F.lit(0)).alias("tokens"), F.coalesce("most_used", F.lit(0)).alias("most_used"))
    return mixture, report.withColumns(
        {"actual_share": F.coalesce(F.try_divide("tokens", F.sum("tokens").over(whole)), F.lit(0.0))}
    )


def _tables(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "source_mix")


def p8_mixture(spark, sf_dir):
    """(slot, source, doc_id, repetition, token_offset, n_tokens): the mixture in the order of its slots."""
    return mix(*_tables(spark, sf_dir))[0]


def p8_shares(spark, sf_dir):
    """Per source: target weight, tokens available and used, most uses of one document, actual share."""
    return mix(*_tables(spark, sf_dir))[1]


def p8_targets(spark, sf_dir):
    """The same at the largest size at which all targets hold."""
    return mix(*_tables(spark, sf_dir), total="targets")[1]


def p8_texts(spark, sf_dir):
    """The mixture with whole texts, each where its first part stands."""
    docs, mixing = _tables(spark, sf_dir)
    first = mix(docs, mixing)[0].where("token_offset = 0")
    return first.join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").select("slot", "source", "doc_id", "repetition", "text")


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_targets": p8_targets, "p8_texts": p8_texts}
SQL: dict[str, str] = {}
