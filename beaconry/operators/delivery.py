"""Exactly one copy of each message delivered at least once (problem 4).

Each row gets the identifier of its message, rows are ranked per identifier by
arrival with the file name breaking ties, and the first is kept. Ranking runs in
two steps, per (identifier, salt) and then among the salts' winners, so that an
identifier holding a third of all rows is never sorted by one task.

The patterns that read identifiers run once: what they give is written as a narrow
table. Only messages of a sender and second that some row lost its id in are
looked up for such rows.

Defined cases: a row with neither a long id, nor a running number with a sender,
nor a sender and instant that a identified message also has, is a message of its
own; null, empty, dash and otherwise unreadable ids are lost ids; a missing
arrival time ranks last; rows equal in time and file are ranked arbitrarily but
only one of them is kept; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import epoch_seconds
from ..session import stored

SALTS = 64
#: Senders' seconds with lost ids are broadcast up to this many, at some 100 bytes each.
BROADCAST_INSTANTS = 200_000


def bare(text: Column) -> Column:
    """An id without case, prefix punctuation or blanks."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def long_id(text: Column) -> Column:
    """The 32 hex digits of an id, however spelled; null if it has none."""
    return F.nullif(F.regexp_extract(bare(text), "([0-9a-f]{32})$", 1), F.lit(""))


def running_number(text: Column) -> Column:
    """The running number of an id, without leading zeros; null if it has none."""
    digits = F.regexp_extract(bare(text), "^(?:7s)?([0-9]{1,31})$", 1)
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))


def sender(text: Column) -> Column:
    """Comparable sender id; null when missing."""
    return F.coalesce(long_id(text), F.nullif(bare(text), F.lit("")))


def _keys(df: DataFrame, *carried: str) -> DataFrame:
    """(file, received_at, sender, sent, message, lost, *carried): the message a row names by itself, ``lost`` if only sender and instant can tell it."""
    read = F.struct(
        long_id(F.col("id")).alias("hex"),
        running_number(F.col("id")).alias("number"),
        sender(F.col("signal_avsandare_id")).alias("sender"),
        epoch_seconds(F.col("signal_tidpunkt")).alias("sent"),
    )
    # Inlined from an array, so that filters on these columns don't repeat the patterns.
    base = df.select("file", "received_at", *carried, F.inline(F.array(read))).withColumn(
        "message",
        F.when(F.col("hex").isNotNull(), F.concat(F.lit("h:"), "hex")).when(
            F.col("number").isNotNull() & F.col("sender").isNotNull(), F.concat(F.lit("n:"), "sender", F.lit(":"), "number")
        ),
    )
    lost = F.col("message").isNull() & F.col("number").isNull() & F.col("sender").isNotNull() & F.col("sent").isNotNull()
    return base.withColumn("lost", lost).drop("hex", "number")


def _own_key() -> Column:
    """The message of lost rows of a sender and instant that no identified message has."""
    return F.concat(F.lit("s:"), "sender", F.lit(":"), F.col("sent").cast("string"))


def identified(df: DataFrame, batch: str | None = None) -> DataFrame:
    """(file, received_at, message), and ``batch``: message is null for a message of its own.

    With a column ``batch``, batches come one after the other whatever their arrival times.
    """
    carried = [batch] if batch else []
    base = stored(_keys(df, *carried))
    lost = base.filter("lost")
    asked = lost.select("sender", "sent").distinct()
    few = asked.count() <= BROADCAST_INSTANTS
    order = ["received_at", "message"] if not batch else [F.col(batch).isNull().alias("unnumbered"), batch, F.col("received_at").isNull().alias("untimed"), "received_at", "message"]
    # The earliest message a sender sent in a second answers for rows that lost their id.
    known = (
        base.filter(F.col("message").isNotNull() & F.col("sender").isNotNull() & F.col("sent").isNotNull())
        .join(F.broadcast(asked) if few else asked, ["sender", "sent"], "left_semi")
        .groupBy("sender", "sent")
        .agg(F.min(F.struct(*order)).getField("message").alias("by_instant"))
    )
    # Not more than were asked for; a stored table starts its side of the join, so that a hot second is split.
    known = F.broadcast(known) if few else stored(known)
    found = lost.join(known, ["sender", "sent"], "left").select("file", "received_at", *carried, F.coalesce("by_instant", _own_key()).alias("message"))
    return base.filter(~F.col("lost")).select("file", "received_at", *carried, "message").unionByName(found)


def ranked(messages: DataFrame, *before: str) -> DataFrame:
    """Adds ``copy``: true for every row of a message but the first, by the columns ``before``, arrival and file; never for one of its own."""
    order = [F.col(c).asc_nulls_last() for c in (*before, "received_at", "file")]
    salt = F.pmod(F.xxhash64("file"), F.lit(SALTS))
    key = F.coalesce("message", F.concat(F.lit("o:"), "file"))
    inner = Window.partitionBy(key, salt).orderBy(*order)
    first = messages.withColumn("__rank", F.row_number().over(inner)).withColumn(
        "__slot", F.when(F.col("__rank") == 1, F.lit(-1)).otherwise(salt)
    )
    outer = Window.partitionBy(key, "__slot").orderBy(*order)
    return first.withColumn("copy", F.col("message").isNotNull() & ((F.col("__rank") > 1) | (F.row_number().over(outer) > 1))).drop("__rank", "__slot")


def surplus(df: DataFrame) -> DataFrame:
    """One row per surplus copy: (file)."""
    known = identified(df).filter(F.col("message").isNotNull())
    return ranked(known).filter("copy").select("file")


def deduplicated(df: DataFrame) -> DataFrame:
    """(file, message) of the one copy kept of each message, messages of their own included."""
    return ranked(identified(df)).filter(~F.col("copy")).select("file", "message")


def identities(df: DataFrame, batch: Column | None = None) -> DataFrame:
    """(message, sender, sent, received_at, batch) of all rows, surplus copies too: what later batches are told apart by.

    One row per message, sender and instant, with its first batch and arrival in it.
    Lost rows stand under sender and instant, for the message that answers for them
    may come later. Without ``batch`` all rows are of one.
    """
    rows = _keys(df.withColumn("__batch", F.lit(0) if batch is None else batch), "__batch")
    named = rows.withColumn("message", F.when(F.col("lost"), _own_key()).otherwise(F.col("message"))).filter(F.col("message").isNotNull())
    first = F.min(F.struct(F.col("__batch").alias("batch"), F.col("received_at").isNull().alias("untimed"), "received_at")).alias("first")
    return named.groupBy("message", "sender", "sent").agg(first).select("message", "sender", "sent", "first.received_at", "first.batch")


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of a batch to store: (file, message) of first copies whose message is not among ``stored``.

    ``stored`` has the ``identities`` of all earlier batches. Lost ids of both sides go
    to the first message identified with their sender and instant, in the order of
    batches: a lost row is a copy of a stored message, and an identified row a copy of
    a stored lost one. A stored table of only (message) can tell messages by id alone.
    """
    if not {"sender", "sent", "received_at", "batch"} <= set(stored.columns):
        bare_ids = stored.select("message").filter(F.col("message").isNotNull()).distinct()
        return deduplicated(batch).join(bare_ids, "message", "left_anti").select("file", "message")
    earlier = stored.filter(F.col("message").isNotNull()).select("message", "sender", "sent", "received_at", F.col("batch").cast("long").alias("turn"), F.col("message").startswith("s:").alias("lost"))
    rows = _keys(batch).withColumn("turn", F.lit(None).cast("long"))
    order = F.struct(F.col("turn").isNull().alias("now"), "turn", F.col("received_at").isNull().alias("untimed"), "received_at", "message")
    answers = (
        earlier.unionByName(rows.select(*earlier.columns))
        .filter(~F.col("lost") & F.col("message").isNotNull() & F.col("sender").isNotNull() & F.col("sent").isNotNull())
        .groupBy("sender", "sent")
        .agg(F.min(order).getField("message").alias("by_instant"))
    )

    def told(df: DataFrame, *columns: str) -> DataFrame:
        lost = df.filter("lost").join(answers, ["sender", "sent"], "left").withColumn("message", F.coalesce("by_instant", _own_key()))
        return df.filter(~F.col("lost")).select(*columns).unionByName(lost.select(*columns))

    now = told(rows, "file", "received_at", "message")
    firsts = ranked(now).filter(~F.col("copy"))
    return firsts.join(told(earlier, "message").distinct(), "message", "left_anti").select("file", "message")


def stored_by_batch(df: DataFrame, batch: str) -> DataFrame:
    """(file, message, batch): what each batch stores when all are delivered in turn, as ``new_messages`` of one after the other.

    A row is new if no earlier batch and no earlier row of its own has its message, so
    all anti-joins are one ranking by batch and arrival. Rows without a batch come last.
    """
    return ranked(identified(df, batch), batch).filter(~F.col("copy")).select("file", "message", batch)
