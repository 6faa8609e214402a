"""What surrounds a token model: pieces of words, the best label of a token, words to mask, words of a recogniser's output."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = re.compile(r"[a-z0-9]+|[^\sa-z0-9]")


def wordpiece(vocabulary: dict[str, int], unknown: str = "[UNK]", most: int = 100) -> Callable[[str], list[int]]:
    """Ids of the longest known pieces of a word from the left; pieces inside a word begin with ``##``."""

    def one(part: str) -> list[int]:
        if len(part) > most:
            return [vocabulary[unknown]]
        ids, at = [], 0
        while at < len(part):
            end = len(part)
            while end > at and ("##" if at else "") + part[at:end] not in vocabulary:
                end -= 1
            if end == at:
                return [vocabulary[unknown]]
            ids.append(vocabulary[("##" if at else "") + part[at:end]])
            at = end
        return ids

    return lambda word: [i for part in _PARTS.findall(word.lower()) for i in one(part)]


def encode_words(words: Column, vocabulary: dict[str, int]) -> Column:
    """(ids, word of each id) of an array of words, between the ids of [CLS] and [SEP]; null for a word that isn't plain ASCII."""

    def run(rows: pd.Series) -> pd.DataFrame:
        pieces = wordpiece(vocabulary)

        def encoded(ws) -> tuple:
            if ws is None or any(not w.strip() or len(w) > 128 or not re.fullmatch(r"[\x20-\x7e]+", w) for w in ws):
                return None, None
            ids, owners = [vocabulary["[CLS]"]], [-1]
            for n, w in enumerate(ws):
                found = pieces(w)
                ids += found
                owners += [n] * len(found)
            return [*ids, vocabulary["[SEP]"]], [*owners, -1]

        return pd.DataFrame([encoded(ws) for ws in rows], columns=["ids", "words"])

    return F.pandas_udf(run, "ids array<int>, words array<int>")(words)


def best_label(scores: Column) -> Column:
    """(label, probability): the first highest score of an array and its softmax."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda t, x: t + F.exp(x - top))
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("label"), (1 / total).alias("probability"))


def words_to_mask(tokens: DataFrame, page: str, outside: int = 0, least: float = 0.9) -> DataFrame:
    """The words with a token that is labelled, or that no label is sure about."""
    best = best_label(F.col("scores"))
    rows = tokens.withColumn("_b", best).filter((F.col("word") >= 0) & ((F.col("_b.label") != outside) | (F.col("_b.probability") < least)))
    return rows.select(page, "word").distinct()


def bridged_predictions(complete: Column, verified: Column, predictions: Column, words: Column) -> Column:
    """Whether predictions of an optional model may be used: complete, verified, one for each word."""
    return F.coalesce(complete & verified & (F.size(predictions) == F.size(words)), F.lit(False))


def recognised_words(pages: DataFrame, page: str, blocks: str) -> DataFrame:
    """A row for each word of blocks of paragraphs of lines of words, in order."""
    flat = F.flatten(F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(b["paragraphs"], lambda p: F.transform(p["lines"], lambda x: x["words"]))))))
    return pages.select(page, F.posexplode(flat).alias("place", "word")).select(page, "place", "word.*")
