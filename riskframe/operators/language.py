"""Romanised-language detection and vocabulary work over tables of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import words
from riskframe.functions.text import (
    clean_for_model, fuzzy_distance, latin_tokens, normalize_adversarial, pattern_hits,
)
from riskframe.operators.joins import lookup_join
from riskframe.session import checkpointed


def fuzzy_vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Distinct tokens that are near a scam word, with the first word they match.

    Edit distances are computed once per distinct token, and only against
    words of a length within reach: an equi-join on the length with the fixed
    word lists (a few hundred rows).
    """
    rows = []
    for kind, words_ in (("tanglish", lx.TANGLISH_WORDS), ("hinglish", lx.HINGLISH_WORDS)):
        for i, word in enumerate(words_):
            reach = fuzzy_distance(word)
            rows += [(n, kind, i, word, reach) for n in range(len(word) - reach, len(word) + reach + 1)]
    lexicon = tokens.sparkSession.createDataFrame(rows, "len int, kind string, ordinal int, word string, reach int")
    short = tokens.filter(F.length(token).between(3, 16)).select(token).distinct().withColumn("len", F.length(token))
    distance = F.levenshtein(F.col(token), F.col("word"))
    near = short.join(F.broadcast(lexicon), "len").filter(distance <= F.col("reach"))
    first = lambda kind: F.min_by("word", F.when(F.col("kind") == kind, F.col("ordinal")))
    return near.groupBy(token).agg(first("tanglish").alias("tanglish_word"), first("hinglish").alias("hinglish_word"))


def detect_romanised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds ``tanglish_indicators, hinglish_phrases, hinglish_words, tanglish, hinglish``."""
    normalized = df.select(F.col(key), normalize_adversarial(text).alias("_n"))
    phrases = normalized.select(
        key, pattern_hits(F.col("_n"), lx.TANGLISH_PHRASES).alias("_tp"),
        F.size(pattern_hits(F.col("_n"), lx.HINGLISH_PHRASES)).alias("hinglish_phrases"))
    tokens = normalized.select(key, F.explode(latin_tokens(F.col("_n"))).alias("token"))
    # The matched variants are few; their table is written once and checked
    # before it is broadcast.
    matched = checkpointed(fuzzy_vocabulary(tokens))
    hits = lookup_join(tokens, matched, "token", "inner").groupBy(key).agg(
        F.collect_set("tanglish_word").alias("_tw"),
        F.count("hinglish_word").cast("int").alias("hinglish_words"))
    out = df.join(phrases, key, "left").join(hits, key, "left")
    empty = F.array().cast("array<string>")
    indicators = F.size(F.array_union(F.coalesce("_tp", empty), F.coalesce("_tw", empty)))
    out = out.withColumns({
        "tanglish_indicators": indicators, "hinglish_phrases": F.coalesce("hinglish_phrases", F.lit(0)),
        "hinglish_words": F.coalesce("hinglish_words", F.lit(0))}).drop("_tp", "_tw")
    return out.withColumns({
        "tanglish": F.col("tanglish_indicators") >= 2,
        "hinglish": (F.col("hinglish_phrases") >= 1) | (F.col("hinglish_words") >= 2)})


def build_vocabulary(df: DataFrame, text: str = "text", size: int = 8000) -> DataFrame:
    """Most frequent tokens with ids from 2 (0 pads, 1 stands for unknown)."""
    counts = (
        df.select(F.explode(words(clean_for_model(text))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    # The size limit is the vocabulary's definition; it keeps the ranking
    # below a top-k of fixed size instead of a sort of all tokens.
    top = counts.orderBy(F.desc("n"), "token").limit(size - 2)
    from pyspark.sql import Window

    return top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1)


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", width: int = 60,
                  vocab_size: int = 8000, unknown: int = 1) -> DataFrame:
    """Token ids of each message, unknown and overflowing ids as 1, padded to ``width``.

    Only the first ``width`` tokens enter the vector, so each message yields at
    most that many rows.
    """
    tokens = df.select(key, F.posexplode(F.slice(words(clean_for_model(text)), 1, width)).alias("pos", "token"))
    known = vocab.select("token", "token_id")
    joined = lookup_join(tokens, known, "token")
    code = F.when(F.coalesce("token_id", F.lit(unknown)) >= vocab_size, unknown).otherwise(F.coalesce("token_id", F.lit(unknown)))
    packed = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))).alias("_c"))
    ids = F.transform("_c", lambda x: x["code"])
    padded = F.slice(F.concat(F.coalesce(ids, F.array().cast("array<int>")), F.array_repeat(F.lit(0), width)), 1, width)
    return df.select(key).join(packed, key, "left").select(key, padded.alias("token_ids"))
