"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept and returns the columns of documents,
from mix on with ``mix_position``; the last returns the encoded samples. ``run`` writes each stage's result to the
shared folder and reads it again as the next one's input.

1. language_id: words are labelled by a CRF that is fitted on a bounded sample of
   the labelled documents; documents without a letter, or of which no language
   has half of the mean posterior, go.
2. exact_dedup: of equal texts the smallest doc_id stays.
3. near_dedup: of each class of near-duplicates the smallest doc_id stays.
4. mix: sources are interleaved to their target weights; the order of
   ``mix_position`` is the mixture. All rows stay.
5. encode: two distinct sampled segmentations of each text, with its source and ``mix_position``.

Cases: null and empty texts have no letter and go at stage 1, as does every text
where no row has a language to learn from; null ids stay through all stages, but
only once for each text; rows with the same id and text stay once, with the same id
and other texts each; texts are read whole at every stage; columns that aren't used
may hold nulls and have any name; ``mix_position`` replaces a column of that name;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bloomdedup, chosenpath, gumbel_pieces, lang_crf, pfair
from marlstone.llm.common import table, unused, written

#: A document of which no language holds this share of its letters is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = unused(docs.columns, "lang_pred", "score")
    judged = lang_crf.identify(docs, lang_crf.train(docs), keep=tuple(docs.columns), lang_as=lang, score_as=score)
    kept = judged.filter((F.col(lang) != lang_crf.UND) & (F.col(score) >= LEAST_SHARE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bloomdedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosenpath.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slot, block = unused(docs.columns, "mix_slot", "mix_block")
    return pfair.mix(docs, names=(slot, block, "mix_position")).drop(slot, block)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gumbel_pieces.sample_encode(docs, keep=("source", "mix_position"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: A CRF and a sampled segmentation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
