"""The corpus pipeline: five stages over ``documents``, each one written and read again by whoever runs them apart.

Clean documents stay: toxicity drops what scores 0.5 and more, line dedup edits texts and keeps rows, near-dedup
keeps one document of each group, mixing repeats documents to the target weights, and the last stage encodes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pointlake.llm.line_dedup import dedup_lines
from pointlake.llm.minhash_dedup import keep_one_of_each
from pointlake.llm.mix_sources import mix_sources
from pointlake.llm.pieces import encode_pieces
from pointlake.llm.queries import tokenizer_file
from pointlake.llm.shared import cut, read_by, release, scope
from pointlake.llm.toxicity import fit_toxicity, score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """Keeps the scratch tables that the result reads and removes the others that were made on the way to it.

    So a result can be computed, and its lost parts again, for as long as it is wanted: no later stage or run touches its tables.
    They stay until ``shared.free(result)`` is called or the driver ends.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope() as made:
            out = f(spark, docs, sf_dir)
        release(made - read_by(out))
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic.

    Null and empty texts are scored like others; a text of any length is scored whole. Rows that repeat an id are scored each. An
    empty table, or one without labelled documents of both kinds, keeps all. Columns are those of ``docs``; others than text aren't read by the score.
    """
    net = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, net).where("predicted = 0").select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies and near-copies of lines.

    Rows stay, also with a null or empty text; of copies the first by id stays. Very long texts are read whole. An empty table stays empty.
    """
    return dedup_lines(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Null, empty and wordless texts, and rows without an id, are near nothing and stay. Of rows that repeat an id and a text one stays. Very long
    texts count whole. An empty table stays empty.
    """
    return keep_one_of_each(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled.

    The text isn't read. Rows that repeat an id draw their count alike; null sources are a source of their own. An empty table stays empty.
    """
    return mix_sources(docs).select(*docs.columns)


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of the text.

    Null and empty texts have no pieces; very long ones are encoded in parts, exactly. Repeated rows are encoded each. An empty table stays empty.
    """
    return encode_pieces(docs.select("doc_id", "source", "text"), tokenizer_file("piece_bpe_32k.model")).drop("text")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Between stages the documents are cut; what a stage before needed is removed then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for k, (name, apply) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return apply(spark, docs, sf_dir)
        with scope() as made:
            docs = cut(apply(spark, docs, sf_dir), name)
        kept = read_by(docs)
        release((made | before) - kept)
        before = kept
    return docs
