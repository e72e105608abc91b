"""A corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed and the mix is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. What a stage returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage rows that repeat an id stand and fall together, and a null id counts as one id; of ties the smallest id
stays. Null and empty texts are empty documents: one of them survives exact deduplication, and a mix has none. Texts of
any length are read whole. Further columns may have any name and pass through up to the mix. An empty table goes
through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.exact_dedup import exact_dedup
from lodestrand.llm.jaccard import Settings, jaccard_components
from lodestrand.llm.labelled import fold
from lodestrand.llm.mixing import mix_sources, whole_documents
from lodestrand.llm.packing import pack
from lodestrand.llm.tables import fresh, materialize
from lodestrand.llm.toxicity import toxicity

#: Words of a shingle and least similarity, in percent, of near copies.
NEAR = Settings(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a toxicity score of 0.5 or more go. Documents with null text are scored as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept, score = [c for c in docs.columns if c != "doc_id"], fresh("score", docs.columns)
    scored = toxicity(docs, labels, fold("doc_id", 5) != 0, keep=kept, score_col=score)
    return scored.where(F.col(score) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the document with the smallest id stays."""
    kept = exact_dedup(docs).where("kept").select("doc_id")
    return _only(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies the document with the smallest id stays."""
    kept = jaccard_components(docs, NEAR).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    return _only(docs, kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents as often as the mix takes them.

    A document's words are taken whole: it appears once for each pass that its shard's quota holds, and seeded documents
    appear once more until their source's target is met. Documents without words are not part of a mix and go.
    """
    times, copy = fresh("times", docs.columns), fresh("copy", docs.columns)
    taken = whole_documents(mix_sources(docs)).where("times > 0").withColumnRenamed("times", times)
    repeated = docs.join(taken, docs["doc_id"].eqNullSafe(taken["doc_id"])).select(docs["*"], taken[times])
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, copy)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: what is left, packed into sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with an id in ids; a null id counts as one."""
    kept = fresh("kept", docs.columns)
    ids = ids.distinct().withColumnRenamed("doc_id", kept)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[kept]), "left_semi")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack_sequences),
]

#: Learned weights and a tokenizer are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
