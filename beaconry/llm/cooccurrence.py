"""Pairs of items that occur together more often than chance (problem 3).

Baskets are a sparse binary matrix of records by items. Its Gram matrix counts
every pair. It is summed from blocks: records and items are hashed into blocks,
the sparse transpose-product of two item blocks over one record block is made in
one task, and the products are added up. The counts are then divided by what the
marginals lead to expect.

Work is bounded on both sides without losing a pair: a pair can only reach
``min_together`` and ``min_lift`` if each item occurs at least ``min_together``
times and in at most N / ``min_lift`` records, since n(a,b) <= min(n(a), n(b)).
Items seen in a large share of all records therefore leave before any product.
A basket of any size is spread over all pairs of item blocks, and a product is made in
chunks of bounded size. Only records too large for the usual item blocks get more of
them, as many as the largest needs; the other records keep theirs.

Inside the products records and items are 64-bit hashes. That no two items, and no two
records, share one is checked over all of them; if any did, another seed is taken.

Defined cases: null records or items are no occurrence; an item twice in a record
counts once; a pair is reported with the smaller item first (binary order); empty
baskets and empty inputs give nothing; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored

#: Item blocks of usual records; a task multiplies two of them.
ITEM_BLOCKS = 4
#: Items that one basket may have in a block; records with more get more blocks.
BASKET_IN_BLOCK = 10_000
#: Occurrences that one record block should hold.
BLOCK_OCCURRENCES = 40_000
#: Products expanded at a time within a task.
CHUNK = 1_000_000


def sightings(facets: DataFrame, steps: DataFrame) -> DataFrame:
    """(record, item) of the facets' files and the messages' facets, some of them several times."""
    seen = facets.select(F.explode("files").alias("record"), F.col("facet_id").alias("item"))
    tied = steps.select(F.col("file").alias("record"), F.explode("facets").alias("item"))
    return seen.unionByName(tied).filter(F.col("record").isNotNull() & F.col("item").isNotNull())


def occurrences(facets: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct ``sightings``."""
    return sightings(facets, steps).distinct()


def gram_block(records: np.ndarray, left: np.ndarray, other_records: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse transpose-product of two blocks of one record block.

    The blocks are (record, item) coordinates. Gives codes left * width + right and
    their counts. Rows are expanded, sorted and compressed in chunks.
    """
    order = np.argsort(other_records, kind="stable")
    other_records, right = other_records[order], right[order]
    start = np.searchsorted(other_records, records, "left")
    length = np.searchsorted(other_records, records, "right") - start
    ends = np.cumsum(length)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    at = 0
    while at < len(records):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = length[at:to]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = np.repeat(left[at:to], n) * width + right[np.repeat(start[at:to], n) + offset]
        fresh, times = np.unique(code, return_counts=True)
        both = np.concatenate([codes, fresh])
        codes, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
        at = to
    return codes, counts


def _products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    _, i, j = key
    record, _ = pd.factorize(pdf["record"])
    item, names = pd.factorize(pdf["item"])
    block = pdf["block"].to_numpy()
    a, b = block == i, block == j
    codes, counts = gram_block(record[a], item[a], record[b], item[b], len(names))
    left, right = np.asarray(names)[codes // len(names)], np.asarray(names)[codes % len(names)]
    if i == j:
        upper = left < right  # a block with itself has every pair twice, and the diagonal
        left, right, counts = left[upper], right[upper], counts[upper]
    # The smaller first, whichever blocks they lie in, for records of other block numbers count the same pairs.
    return pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right), "n": counts})


def products(incidence: DataFrame, record_blocks: int, item_blocks: int) -> DataFrame:
    """Counts of pairs of items (numbers) per record block: (a, b, n)."""
    ship_package(incidence.sparkSession)
    block = F.pmod(F.hash("item"), F.lit(item_blocks))
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(item_blocks - 1)), lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j"))
    )
    placed = incidence.select(
        "record", "item", block.alias("block"), F.pmod(F.xxhash64("record"), F.lit(record_blocks)).alias("records"), F.explode(pairs).alias("p")
    ).select("record", "item", "block", "records", "p.i", "p.j")
    return placed.groupBy("records", "i", "j").applyInPandas(_products, "a long, b long, n long")


def gram(incidence: DataFrame) -> DataFrame:
    """Counts of all pairs of items (numbers) of distinct (record, item): (a, b, n)."""
    sizes = incidence.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    usual = BASKET_IN_BLOCK * ITEM_BLOCKS
    own = F.when(F.col("n") <= usual, F.col("n"))
    told = sizes.agg(F.sum(own).alias("usual"), F.sum("n").alias("all"), F.max("n").alias("largest")).first()
    blocks = lambda n: max(1, math.ceil((n or 0) / BLOCK_OCCURRENCES))
    if (told["largest"] or 0) <= usual:
        partial = products(incidence, blocks(told["all"]), ITEM_BLOCKS)
    else:
        large = stored(sizes.filter(F.col("n") > usual).select("record"))
        partial = products(incidence.join(large, "record", "left_anti"), blocks(told["usual"]), ITEM_BLOCKS).unionByName(
            products(incidence.join(large, "record", "left_semi"), blocks(told["all"] - (told["usual"] or 0)), math.ceil(told["largest"] / BASKET_IN_BLOCK))
        )
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _code(column: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(column))


def _seed(names: DataFrame, column: str) -> tuple[int, int]:
    """How many different names there are, and the first seed under which no two share a hash."""
    for seed in itertools.count():
        n, codes = names.agg(F.count(F.lit(1)), F.countDistinct(_code(column, seed))).first()
        if n == codes:
            return n, seed


def together(baskets: DataFrame, min_together: int = 5, min_lift: float = 5) -> DataFrame:
    """Pairs of ``baskets`` (record, item), which may be repeated: (item_a, item_b, n, n_a, n_b, lift)."""
    names = stored(baskets.select("item").distinct())
    _, item_seed = _seed(names, "item")
    total, record_seed = _seed(baskets.select("record").distinct(), "record")
    numbered = stored(baskets.select(_code("record", record_seed).alias("record"), _code("item", item_seed).alias("code")).distinct())
    sums = numbered.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    kept = sums.filter((F.col("n") >= min_together) & (F.col("n") * F.lit(float(min_lift)) <= total))
    able = stored(names.withColumn("code", _code("item", item_seed)).join(kept, "code"))
    incidence = numbered.join(able.select("code"), "code").select("record", F.col("code").alias("item"))
    counts = gram(incidence).filter(F.col("n") >= min_together)
    a = able.select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("n").alias("n_x"))
    b = able.select(F.col("code").alias("b"), F.col("item").alias("y"), F.col("n").alias("n_y"))
    first = F.col("x") < F.col("y")
    return (
        counts.join(a, "a")
        .join(b, "b")
        .filter(F.col("n") * F.lit(total) >= F.lit(float(min_lift)) * F.col("n_x") * F.col("n_y"))
        .select(
            F.least("x", "y").alias("item_a"),
            F.greatest("x", "y").alias("item_b"),
            "n",
            F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
            F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
            (F.col("n") * F.lit(total) / (F.col("n_x") * F.col("n_y"))).alias("lift"),
        )
    )
