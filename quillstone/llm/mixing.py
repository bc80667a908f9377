"""Mixing sources to target weights: whole epochs first, then a weighted sample without replacement up to the budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.bpe import DEFAULT_VOCABULARY, Encoder, Vocabulary, slices
from quillstone.llm.quality import STATISTICS, scored, statistics
from quillstone.runtime import maybe_broadcast, ship, spread, written

SEED = 20
#: Ranges of the exponential key by which a source is sorted in parts; more of them only make the parts smaller.
PARTS = 4096
#: The least quality weight of a text; the most is 1.
LEAST_QUALITY = 0.05


def sizes(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, STATISTICS...) of every document with at least one token. One narrow pass over the texts."""
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                n = encoder.sizes(texts[a:b])
                stats = zip(*map(statistics, texts[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(c, pa.float64()) for c in stats)], names=["doc_id", "source", "tokens", *STATISTICS])

    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(documents[id_col].alias("doc_id"), documents[source_col].alias("source"), documents[text_col].alias("text")).where(F.length("text") > 0)
    return spread(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, source string, tokens bigint, " + ", ".join(f"{c} double" for c in STATISTICS))


def with_quality(spark: SparkSession, measured: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, quality) of a stored table of sizes(): the posterior of being prose that the labelling
    functions of text types give (see quality.scored), over the texts as they are, and at least LEAST_QUALITY."""
    typed, _ = scored(spark, measured)
    return typed.select("doc_id", "source", "tokens", F.greatest(F.lit(LEAST_QUALITY), 1 - F.coalesce("other", F.lit(1.0))).alias("quality"))


def allot(targets: pd.DataFrame) -> pd.DataFrame:
    """Token budgets of one mix: (source, weight, tokens, repeats, wanted) -> (…, budget). Sources that can't reach their
    share give all they have; what they lack goes to the others by weight, until the size is reached or all is used."""
    t = targets.copy()
    room = (t["tokens"] * t["repeats"]).to_numpy(float)
    weight = np.where(room > 0, t["weight"].fillna(0).clip(lower=0).to_numpy(float), 0.0)
    budget, open_ = np.zeros(len(t)), weight > 0
    left = float(t["wanted"].iloc[0])
    while open_.any() and left > 1e-6:
        share = np.where(open_, weight, 0) / weight[open_].sum() * left
        full = open_ & (budget + share >= room)
        if not full.any():
            budget += share
            break
        left -= (room - budget)[full].sum()
        budget = np.where(full, room, budget)
        open_ &= ~full
        # the rest is shared anew among what is open; nothing was given to it yet
    t["budget"] = np.floor(budget + 0.5).astype(np.int64)
    return t


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_name, source, doc_id, copies, tokens), one row per mix and chosen document, and the report
    (mix_name, source, target_share, actual_share, target_tokens, actual_tokens, available_tokens, documents, epochs).

    `targets`: mix_name, size_factor, source, weight, max_repeats (null: once). A mix's size is size_factor times the
    tokens of all documents. A source's budget is first filled with complete epochs, each using all its documents; the
    rest is an Efraimidis-Spirakis sample: documents in the order of exponential keys over quality weights (the posterior
    of being prose, in any script), up to the budget; the document at the edge is taken if that comes nearer to it. Budgets that sources can't fill go to the
    others by weight, so that the mix keeps its size where there is enough; the report shows target and reached shares.

    Keys depend on the mix, doc_id and seed only, so a lost executor's work is repeated alike. A source is sorted in
    ranges of its keys: sums by range are prefix-summed first, so that a source of any size is no single task.
    Documents without a source, text or token are never chosen, but count in the size. A source named twice in a mix
    keeps its largest weight and repeats. Weights that are null or not positive give a budget of 0, as do sources with
    no documents. Repeated doc_ids of a source are chosen together or as their keys tie, by size. Empty tables: no rows.
    """
    docs = with_quality(spark, written(spark, sizes(spark, documents, id_col, source_col, text_col, vocabulary), "sizes"))
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    per = docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = targets.groupBy("mix_name", "source").agg(F.max("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("bigint").alias("repeats"), F.max("size_factor").alias("size_factor"))
    plan = plan.join(per, "source", "left").fillna(0, ["tokens", "documents"]).crossJoin(F.broadcast(total)).withColumn("wanted", F.coalesce(F.col("size_factor") * F.col("all_tokens"), F.lit(0.0))).select("mix_name", "source", "weight", "repeats", "tokens", "documents", "wanted")
    schema = "mix_name string, source string, weight double, repeats bigint, tokens bigint, documents bigint, wanted double, budget bigint"
    plan = written(spark, plan.groupBy("mix_name").applyInPandas(allot, schema), "plan")
    epochs = F.when(F.col("tokens") > 0, F.least("repeats", F.floor(F.col("budget") / F.col("tokens")))).otherwise(0).cast("bigint")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))

    active = plan.where("budget > 0").select("mix_name", "source", "epochs", "rest", "repeats")
    chosen = docs.where("source is not null").join(maybe_broadcast(active), "source")
    # uniform in (0, 1): 52 bits of a hash, centred in their step
    u = ((F.xxhash64(F.lit(seed), "mix_name", "doc_id").bitwiseAND(F.lit((1 << 52) - 1))) + F.lit(0.5)) / F.lit(float(1 << 52))
    chosen = chosen.withColumn("key", -F.log(u) / F.col("quality"))
    # most keys of a text of weight 1 lie below 5; the part is monotone in the key
    part = F.least(F.lit(PARTS - 1), F.floor((1 - F.exp(-F.col("key") / 2)) * PARTS)).cast("int")
    chosen = chosen.withColumn("part", part)
    before = Window.partitionBy("mix_name", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = chosen.groupBy("mix_name", "source", "part").agg(F.sum("tokens").alias("t")).select("mix_name", "source", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"), "t")
    chosen = chosen.join(sums, ["mix_name", "source", "part"])
    whole = (F.col("ahead") + F.col("t") <= F.col("rest")).cast("int")
    # only the part that holds the edge must be sorted; those below it are taken, those above it are not
    edge = chosen.where((F.col("ahead") <= F.col("rest")) & (F.col("ahead") + F.col("t") > F.col("rest")))
    inside = Window.partitionBy("mix_name", "source", "part").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("at", F.col("ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn("more", (F.col("at") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    others = chosen.where((F.col("ahead") > F.col("rest")) | (F.col("ahead") + F.col("t") <= F.col("rest"))).withColumn("more", whole)
    columns = ["mix_name", "source", "doc_id", "tokens", "epochs", "repeats", "more"]
    out = others.select(columns).unionByName(edge.select(columns)).withColumn("copies", F.least(F.col("repeats"), F.col("epochs") + F.col("more")).cast("int")).where("copies > 0").select("mix_name", "source", "doc_id", "copies", "tokens")
    out = written(spark, out, "mix")

    got = out.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("used"))
    mixes = Window.partitionBy("mix_name")
    weights = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    report = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["actual_tokens", "used"])
    report = report.select(
        "mix_name", "source",
        (weights / F.nullif(F.sum(weights).over(mixes), F.lit(0.0))).alias("target_share"),
        (F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(mixes), F.lit(0))).alias("actual_share"),
        (F.col("wanted") * weights).cast("bigint").alias("target_tokens"),
        F.col("actual_tokens").cast("bigint").alias("actual_tokens"), F.col("tokens").alias("available_tokens"), F.col("used").alias("documents"), "epochs",
    )
    return out, report
