"""Documents that hold passages of held-out items (problem 8).

A leak is a run of ``RUN`` words that an item and a document share. All its words are
words of items, so a document is first cut down, within its row, to its stretches of
at least ``RUN`` item words in sequence; other text can hold no leak. Each run of an
item needs all its words, so its rarest word is a necessary prefix token, rarity being
counted over all stretches: the stretches' words are joined with these tokens only. A
hit fixes where the run would start; positions where it would not fit into the
stretch leave by the length bound, windows with another hash than the run leave next,
and the words of those that remain are compared exactly.

Documents are folded once, without a shuffle; only windows that match are shuffled.
Beyond ``IN_ROW_WORDS`` item words, documents are taken whole instead of in stretches
and are folded once more. Runs are broadcast in blocks of ``BROADCAST_RUNS`` tokens'
rows (token, place, hash), one pass over the stretches each, so any number of items
works in bounded memory. Long stretches are cut into overlapping pieces, so that the
work grows with the length of a text and not with its square.

Defined cases: null, empty and wordless texts and items shorter than a run match
nothing; repeated items and passages give one row per document and item; null
item ids are ignored; texts are compared whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import words
from ..session import stored

RUN = 13
#: Different words of items up to which a row is cut down by them (about 0.5 MB in each task).
IN_ROW_WORDS = 20_000
#: Runs in a block that is broadcast, about 60 bytes each.
BROADCAST_RUNS = 1_000_000
#: Words of a piece, its overlap with the next not counted.
PIECE = 200


def item_runs(items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, passage): every run of an item, as an array of words."""
    listed = items.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - run + 1)
    return (
        listed.filter(F.size("w") >= run)
        .select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), run).alias("passage"))
        .distinct()
    )


def frequencies(split: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n) of how often the words of ``vocabulary`` occur in ``split`` (w); 0 counts too."""
    found = split.select(F.explode("w").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_tokens(passages: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, offset, print) of distinct runs: the rarest word (ties by word, then by place), where it is, and the run's hash."""
    placed = passages.select("passage").distinct().select("passage", F.posexplode("passage").alias("offset", "word")).join(counts, "word")
    rarest = placed.groupBy("passage").agg(F.min(F.struct("n", "word", "offset")).alias("r"))
    return rarest.select(F.col("r.word").alias("token"), F.col("r.offset").alias("offset"), F.xxhash64("passage").alias("print"))


def stretches(documents: DataFrame, known: list[str] | None, run: int = RUN) -> DataFrame:
    """(doc_id, w): pieces of the documents' words that a run could lie in; ``known`` has all words of items, if they are few."""
    split = documents.filter(F.col("text").isNotNull()).select("doc_id", words(F.col("text")).alias("w"))
    if known is not None:
        listed = ", ".join(f"'{x}'" for x in known)  # words are letters and digits only
        marked = F.array_join(F.expr(f"transform(w, x -> if(x in ({listed}), x, '|'))"), " ")
        found = F.transform(F.split(marked, r"\|"), lambda x: F.split(F.trim(x), " "))
        split = split.select("doc_id", F.explode(F.filter(found, lambda x: F.size(x) >= run)).alias("w"))
    long = split.filter(F.size("w") >= run)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - run) / PIECE).cast("int"))
    pieces = F.transform(starts, lambda i: F.slice("w", i * PIECE + 1, PIECE + run - 1))
    return long.select("doc_id", F.explode(pieces).alias("w"))


def windows(pieces: DataFrame, tokens: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, passage): the distinct windows of the pieces that hold a token in its place and hash as its run does."""
    at = pieces.select("doc_id", "w", F.posexplode("w").alias("pos", "token")).join(F.broadcast(tokens), "token")
    start = F.col("pos") - F.col("offset")
    fits = at.filter((start >= 0) & (start + run <= F.size("w"))).withColumn("passage", F.slice("w", F.greatest(start, F.lit(0)) + 1, run))  # filters may be tried in any order
    return fits.filter(F.xxhash64("passage") == F.col("print")).select("doc_id", "passage").distinct()


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id) of every document and item that share a run."""
    passages = stored(item_runs(items, run))
    vocabulary = passages.select(F.explode("passage").alias("word")).distinct()
    some = vocabulary.limit(IN_ROW_WORDS + 1).collect()  # of bounded size
    pieces = stretches(documents, [r["word"] for r in some] or ["-"], run) if len(some) <= IN_ROW_WORDS else stretches(documents, None, run)
    if len(some) <= IN_ROW_WORDS:
        pieces = stored(pieces)
    tokens = stored(prefix_tokens(passages, frequencies(pieces, vocabulary)))
    blocks = max(1, -(-tokens.count() // BROADCAST_RUNS))
    block = F.pmod(F.xxhash64("token", "print"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [windows(pieces, tokens.filter(block == k), run) for k in range(blocks)])
    return found.join(passages, "passage").select("doc_id", "item_id").distinct()
