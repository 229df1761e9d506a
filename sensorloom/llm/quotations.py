"""Quotation linking: builds reply-ordered conversations from messages that quote each other with ``>``.

1. Each message is cut into lines; the number of leading ``>`` is a line's quote level. Level 0 is the
   message's own text. Runs of lines at one level are quoted passages. A line such as "Ann wrote:" right
   before a quotation belongs to it.
2. Quoted passages, whole, by paragraph and by line, are normalised (case, white space) and hashed; so are
   the own texts of the messages. Blank quoted lines part paragraphs. So are overlapping runs of ``RUN`` words
   of both, for paragraphs of which a part is quoted or whose lines are wrapped anew. Equal hashes in one
   conversation point from a quoted passage to the first message that wrote the unit, if that came earlier. A
   passage is linked to a message if its whole or a paragraph is found there, or if the lines found (or, where
   there are none, the runs) make up at least ``SHARE`` of it: a short line alone proves nothing.
3. The shallowest level links to the parent; with several candidates, the most quoted characters, then the
   latest turn. ``root_turn`` and ``depth`` follow by pointer doubling over the links.
4. ``position`` is a message's place in its reply-ordered conversation: every message right below the one that it
   answers, behind that one's earlier replies and all that answers these. It is the sum over the message and its
   ancestors of what stands before each among its siblings, gathered by the same doubling.

   In a conversation without any link it is the turn.

Sorting a conversation by ``position`` gives replies under what they answer, in order, without quotes.

All of it is DataFrame work keyed by (conversation, hash), so a conversation with a third of all messages is
spread by its hashes and is never collected.

Nulls: a null text is an empty message; a message with a null conv_id or turn is returned without links.
Repeated rows are returned as often as they came. A message that quotes only itself or later ones has no
parent. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import shared

QUOTE = r"^[ \t]*(?:>[ \t]*)+"
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
NO_STRINGS = "array<string>"
#: Words of a run by which partial quotations are found.
RUN = 5
#: Share of a passage (characters of its lines, or number of its runs) that must be found where not all of it is.
SHARE = 0.5
BLOCK = 4096


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, ``own`` (text without quotes) and ``passages``: (level, lines) of each quoted run."""
    rows = messages.select("conv_id", "turn", "role", F.split(shared.text_or_empty(), "\r?\n", -1).alias("lines"))
    level = F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")))
    rows = rows.withColumn("level", level)
    # The line before a quotation that says who wrote it counts as part of it (level -1: dropped).
    said_by = lambda x, i: F.when((F.get("level", i) == 0) & x.rlike(ATTRIBUTION) & (F.coalesce(F.get("level", i + 1), F.lit(0)) > 0), -1).otherwise(F.get("level", i))
    rows = rows.withColumn("kind", F.transform("lines", said_by))
    own = F.trim(F.array_join(F.filter("lines", lambda x, i: F.get("kind", i) == 0), "\n"))
    body = F.transform("lines", lambda x: normal(F.regexp_replace(x, QUOTE, "")))
    first = F.filter(F.transform("kind", lambda k, i: F.when((k > 0) & (F.coalesce(F.get("kind", i - 1), F.lit(0)) != k), i)), lambda i: i.isNotNull())
    rows = rows.select("conv_id", "turn", "role", own.alias("own"), "kind", body.alias("body"), first.alias("first"))
    # A run ends before the next line of another kind.
    last = F.filter(F.transform("kind", lambda k, i: F.when((k > 0) & (F.coalesce(F.get("kind", i + 1), F.lit(0)) != k), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("last", last)
    passages = F.zip_with("first", "last", lambda a, b: F.struct(F.get("kind", a).alias("level"), F.slice("body", a + 1, b - a + 1).alias("lines")))
    return rows.select("conv_id", "turn", "role", "own", passages.alias("passages"))


def hashed(units: Column) -> Column:
    """(hash, length) of the distinct units that are not empty."""
    return F.transform(F.array_distinct(F.filter(units, lambda x: x != "")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))


def with_runs(rows: DataFrame) -> DataFrame:
    """``runs``: (hash, length) of the overlapping runs of ``RUN`` words of the normalised ``text``.

    The words are a column of their own, so that they are not split anew for each run.
    """
    rows = rows.withColumn("words", F.split("text", " ", -1)).withColumn("w", F.transform("words", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))))
    starts = F.when(F.size("w") >= RUN, F.sequence(F.lit(1), F.size("w") - RUN + 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("s", F.transform(starts, lambda i: F.slice("w", i, RUN)))
    one = lambda x: F.struct(F.xxhash64(x["h"]).alias("h"), F.aggregate(x["n"], F.lit(RUN - 1), lambda a, n: a + n).alias("n"))
    return rows.withColumn("runs", F.array_distinct(F.transform("s", one))).drop("text", "words", "w", "s")


def paragraphs(lines: Column) -> Column:
    """Lines joined between blank ones, normalised."""
    return F.transform(F.split(F.array_join(lines, "\n"), r"\n\n+"), normal)


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn: the earlier message that each quoting message answers; one row a message."""
    usable = rows.where("conv_id is not null and turn is not null")
    quoting = usable.where(F.size("passages") > 0)
    lines = F.col("p.lines")
    whole = normal(F.array_join(lines, " "))
    quoted = quoting.select("conv_id", "turn", F.posexplode("passages").alias("place", "p"))
    quoted = quoted.select("conv_id", "turn", "place", "p.level", F.length(whole).alias("size"), hashed(F.concat(F.array(whole), paragraphs(lines))).alias("units"), hashed(lines).alias("lines"), whole.alias("text"))
    quoted = shared.stored(quoted, "quoted")
    own = normal(F.col("own"))
    blocks = F.transform(F.split("own", r"\n[ \t]*\n"), normal)
    own_lines = F.transform(F.split("own", "\n"), normal)
    written = usable.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", hashed(F.concat(F.array(own), blocks)).alias("units"), hashed(own_lines).alias("lines"), own.alias("text"))
    written = shared.stored(written, "written")

    def matched(kind: str, quoted: DataFrame, written: DataFrame) -> DataFrame:
        """conv_id, turn, place, level, size, source, n and units_found: what of each passage is in each earlier message."""
        first = written.select("conv_id", "turn", F.explode(kind).alias("u")).groupBy("conv_id", "u.h").agg(F.min("turn").alias("source"))
        said = quoted.select("conv_id", "turn", "place", "level", "size", F.explode(kind).alias("u")).select("conv_id", "turn", "place", "level", "size", "u.h", "u.n").distinct()
        return said.join(first, ["conv_id", "h"]).where(F.col("source") < F.col("turn")).groupBy("conv_id", "turn", "place", "level", "size", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("units_found"))

    passage = ["conv_id", "turn", "place"]
    exact = shared.stored(matched("units", quoted, written), "quoted-exactly")
    by_line = matched("lines", quoted, written).where(F.col("n") >= SHARE * F.col("size")).join(exact.select(*passage).distinct(), passage, "left_anti")
    found = exact.unionByName(shared.stored(by_line, "quoted-by-line"))
    # Runs overlap, so it is their number that counts, not their characters.
    runs = with_runs(quoted)
    by_run = matched("runs", runs.withColumn("size", F.size("runs")), with_runs(written)).where(F.col("units_found") >= SHARE * F.col("size"))
    found = found.unionByName(by_run.join(found.select(*passage).distinct(), passage, "left_anti"))
    found = found.groupBy("conv_id", "turn", "source").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    best = F.max_by("source", F.struct(-F.col("level"), F.col("n"), F.col("source")))
    return found.groupBy("conv_id", "turn").agg(best.alias("parent_turn"))


def places(messages: DataFrame, tree: DataFrame) -> DataFrame:
    """conv_id, turn, position: places in reply order, from 0, of conversations with replies.

    ``messages``: conv_id, turn (distinct); ``tree``: conv_id, turn, parent_turn of those that have one.
    """
    every = messages.join(tree, ["conv_id", "turn"], "left")
    # How many messages each subtree has: pointers to all ancestors are followed by doubling, one sum a message.
    jumps = shared.stored(every.select("conv_id", "turn", F.col("parent_turn").alias("up")), "reply-jumps")
    sizes = shared.stored(every.select("conv_id", "turn", F.lit(1).cast("long").alias("size")), "reply-sizes")
    while True:
        # size(x) of 2^k levels: its own and, of those that jump to it, theirs.
        above = jumps.where("up is not null").join(sizes, ["conv_id", "turn"]).groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more"))
        if above.isEmpty():
            break
        sizes = shared.stored(sizes.join(above, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "reply-sizes")
        jumps = shared.stored(jumps.join(jumps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next")), ["conv_id", "up"], "left").select("conv_id", "turn", F.col("next").alias("up")), "reply-jumps")
    # Before a message stand, among its siblings, the earlier ones with their subtrees; and its parent. Siblings are
    # summed in blocks of BLOCK turns, and the blocks before: no task gathers all siblings of a large conversation.
    group = ["conv_id", "p", "block"]
    kin = every.join(sizes, ["conv_id", "turn"]).withColumns({"p": F.coalesce(F.col("parent_turn").cast("long"), F.lit(-(1 << 63))), "block": F.floor(F.col("turn") / BLOCK)})
    kin = shared.stored(kin, "reply-siblings")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = kin.groupBy(*group).agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(earlier(Window.partitionBy("conv_id", "p").orderBy("block"))), F.lit(0)))
    inside = F.coalesce(F.sum("size").over(earlier(Window.partitionBy(*group).orderBy("turn"))), F.lit(0))
    before = kin.withColumn("inside", inside).join(shared.stored(blocks.select(*group, "base"), "reply-blocks"), group)
    before = before.withColumn("before", F.col("base") + F.col("inside") + F.col("parent_turn").isNotNull().cast("long"))
    walk = shared.stored(before.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.col("before").alias("position")), "reply-places")
    while not walk.where("up is not null").isEmpty():
        above = walk.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("position").alias("more"))
        walk = shared.stored(walk.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.col("next").alias("up"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position")), "reply-places")
    return walk.select("conv_id", "turn", "position")


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn and depth of every linked message, by pointer doubling."""
    jumps = shared.stored(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "quote-links")
    while True:
        above = jumps.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        moved = jumps.join(above, ["conv_id", "root_turn"], "left")
        if moved.where("above is not null").isEmpty():
            return jumps
        jumps = shared.stored(moved.select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quote-links")


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (own), n_quoted, quote_depth, parent_turn, root_turn, depth, position."""
    rows = shared.stored(parsed(messages), "quote-parsed")
    parents = shared.stored(links(rows), "quote-parents")
    tree = threads(parents).join(parents, ["conv_id", "turn"])
    # Only conversations with a reply need to be put in order; in the others the turn is the place.
    answered = parents.select("conv_id").distinct()
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    ordered = places(shared.stored(turns.join(answered, "conv_id", "left_semi"), "reply-turns"), parents)
    plain = turns.join(answered, "conv_id", "left_anti").select("conv_id", "turn", F.col("turn").cast("long").alias("position"))
    out = rows.join(tree, ["conv_id", "turn"], "left").join(ordered.unionByName(plain), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("quote_depth"),
        "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "position",
    )
