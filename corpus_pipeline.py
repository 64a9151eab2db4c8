"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

1. language_id: documents whose language can't be told go (no text, no letter,
   a posterior under ``LEAST_SCORE``, or a fit under the bound learned for the
   predicted language); predictions are learned as in the operator.
2. ngram_jaccard_join: one document of each group of near copies stays
   (shingles of 5 words, Jaccard similarity of 0.8 or more).
3. substring_dedup: words covered by a repeated window of 35 words go; documents
   that lose words carry the kept ones joined by one space.
4. secret_scan: every span of a secret is replaced by ``MASK``. A generic token is
   taken for an example and stays if several sources hold it in ``LEAST_COPIES``
   documents or more, or any in over ``MOST_COPIES``.
5. sequence_packing: documents become token sequences of 4096 ids at most.

All stages but the last return the columns of ``documents``; n_chars follows the
text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystone.llm.common import scratch_table
from keystone.llm.jaccard_join import one_of_each_group
from keystone.llm.language_id import fit_bounds, language_predictions
from keystone.llm.packing import pack_documents
from keystone.llm.passages import with_row_key
from keystone.llm.secrets import find_secrets
from keystone.llm.substring_dedup import remove_repeated_windows
from keystone.session import ensure_checkpoint_dir

LEAST_SCORE = 0.5
MASK = "<secret>"
LEAST_COPIES, MOST_COPIES = 3, 1000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; ``lang`` itself stays as given."""
    keys = with_row_key(docs).select("doc_id", "k", "h", "text", "lang")
    found = scratch_table(language_predictions(keys, carry=("k", "h")), "language-fit")
    # a row for each learned language; no bound where no training document has the language
    bounded = found.join(F.broadcast(fit_bounds(found)), "lang_pred", "left")
    fits = F.coalesce(F.col("fit") >= F.col("least_fit"), F.lit(True))
    kept = bounded.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & fits).select("k", "h").distinct()
    return with_row_key(docs).join(kept, ["k", "h"], "left_semi").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` (row, old_text, text): the columns of ``docs`` with new texts and their lengths."""
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col("text").eqNullSafe(F.col("old_text")), F.col("row.n_chars"))
                           .otherwise(F.length("text").cast(kind)).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return changed.select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(docs, 35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(docs, out.select("row", F.col("text").alias("old_text"), text.alias("text")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; overlapping spans become one."""
    out = find_secrets(docs, least_documents=LEAST_COPIES, max_documents=MOST_COPIES, carry_row=True)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc, s):
        # a span that begins inside what is masked already only extends it
        gap = F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.coalesce(gap, acc["done"]).alias("done"))

    masked = F.aggregate("all_spans", start, step,
                         lambda acc: F.concat(acc["done"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("all_spans") > 0, masked).otherwise(F.col("text"))
    return _with_text(docs, out.select("row", F.col("text").alias("old_text"), text.alias("text")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("substring_dedup", substring_dedup),
          ("secret_scan", secret_scan), ("sequence_packing", sequence_packing)]

#: SQL can't express the learned language model, nor the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
