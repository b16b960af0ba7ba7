"""Quotation linking of conversations, in DataFrame functions only.

A line's quote level is the number of '>' marks that open it. Lines of one level that follow one another
form a passage; a passage of level 1 or more is a quotation. Passages are normalised (lower case, letters and
digits only, single spaces) and hashed. The same hash is taken of every message's own passages, of its own
lines and of its whole own text; a quotation belongs to the first message of the conversation that wrote it,
if that is an earlier one. Where a whole passage finds no original, its lines are tried.

The message that a message replies to is the latest one among the originals of its least nested linked
quotations. Thread roots come from pointer jumping over these replies. Conversations are rebuilt from own
text only, in the order (thread_root, turn), in which every message follows the one it replies to; `place` counts a
conversation's messages in that order, from 0, by ranges of all messages rather than in a group of one conversation.

Null or empty text has no passages and replies to nothing. Passages without letters or digits are not
joined on. Rows that repeat a (conv_id, turn) give repeated rows with one parent and root; their quotations
count together. Rows without conv_id or turn come back as they are, unlinked. Joins are on (conversation,
hash) with one row of original for each, so neither a long conversation nor a common line multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise

#: A line's marks: up to three spaces before each, as mail programs write them.
MARKS = r"^(?:[ \t]{0,3}>)+[ \t]?"

# (level, text) of each line, then runs of one level: fold over the lines, joined in blocks by their index
_LINES = r"transform(split(replace(replace(coalesce(text, ''), '\r\n', '\n'), '\r', '\n'), '\n'), l -> named_struct('level', char_length(regexp_replace(regexp_extract(l, '" + MARKS.replace("\\", "\\\\") + r"', 0), '[^>]', '')), 'body', regexp_replace(l, '" + MARKS.replace("\\", "\\\\") + r"', '')))"
_STARTS = "filter(sequence(0, size(_lines) - 1), i -> i = 0 OR _lines[i].level <> _lines[i - 1].level)"
_PASSAGES = "transform(sequence(0, size(_starts) - 1), i -> named_struct('level', _lines[_starts[i]].level, 'lines', transform(slice(_lines, _starts[i] + 1, (CASE WHEN i + 1 < size(_starts) THEN _starts[i + 1] ELSE size(_lines) END) - _starts[i]), l -> l.body)))"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' '))"


def parse(messages: DataFrame) -> DataFrame:
    """Adds `passages` (array<struct<level, lines>>) and `own`: the text outside quotations, blank edges trimmed."""
    out = messages.withColumn("_lines", F.expr(_LINES)).withColumn("_starts", F.expr(_STARTS)).withColumn("passages", F.expr(_PASSAGES))
    own = r"regexp_replace(array_join(flatten(transform(filter(passages, p -> p.level = 0), p -> p.lines)), '\n'), '^\\s+|\\s+$', '')"
    return out.withColumn("own", F.expr(own)).drop("_lines", "_starts")


def _hashed(texts: str) -> str:
    """Distinct hashes of an array of texts, those without letters or digits left out."""
    return f"array_distinct(transform(filter(transform({texts}, x -> {_normal('x')}), x -> x <> ''), x -> sha2(x, 256)))"


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n_quotes, n_linked, parent_turn) of each (conv_id, turn) that quotes."""
    m = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    units = f"concat(transform(filter(passages, p -> p.level = 0), p -> array_join(p.lines, ' ')), flatten(transform(filter(passages, p -> p.level = 0), p -> p.lines)), array(own))"
    first = m.select("conv_id", "turn", F.explode(F.expr(_hashed(units))).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quotes = m.select("conv_id", "turn", F.posexplode(F.expr("filter(passages, p -> p.level > 0)")).alias("nr", "p"))
    quotes = quotes.select("conv_id", "turn", "nr", F.xxhash64("p").alias("id"), "p.level", F.explode(F.expr("concat(array(named_struct('whole', true, 'x', array_join(p.lines, ' '))), transform(p.lines, l -> named_struct('whole', false, 'x', l)))")).alias("u"))
    quotes = quotes.select("conv_id", "turn", "nr", "id", "level", "u.whole", F.expr(_normal("u.x")).alias("x")).withColumn("hash", F.when(F.col("x") != "", F.sha2("x", 256)))
    met = quotes.join(first, ["conv_id", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    by_quote = met.groupBy("conv_id", "turn", "nr", "id", "level").agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("original"))), F.max("original")).alias("original"))
    nearest = F.expr("max(named_struct('near', -level, 'turn', original)) FILTER (WHERE original IS NOT NULL)")
    return by_quote.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"), nearest.alias("best")).select("conv_id", "turn", "n_quotes", "n_linked", F.col("best.turn").alias("parent_turn"))


def roots(links: DataFrame, most: int = 64) -> DataFrame:
    """(conv_id, turn, thread_root, reply_depth) of each message that replies, by pointer jumping."""
    now = materialise(links.where("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps")), "threads")
    for _ in range(most):
        hop = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        if now.join(hop, ["conv_id", "up"], "left_semi").isEmpty():
            break
        after = materialise(now.join(hop, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "threads")
        discard(now)
        now = after
    return now.select("conv_id", "turn", F.col("up").alias("thread_root"), F.col("steps").alias("reply_depth"))


def places(messages: DataFrame, tree: DataFrame) -> DataFrame:
    """(conv_id, turn, place) of every distinct (conv_id, turn): its place in the conversation's reply order.

    All messages are dealt by ranges of (conversation, thread, turn) and numbered through: a range's rows from its
    start, which is what the ranges before it hold (one number each); a conversation counts from its first number.
    """
    spark = messages.sparkSession
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    order = [F.col("conv_id"), F.coalesce("thread_root", "turn"), F.col("turn")]
    dealt = known.join(tree.select("conv_id", "turn", "thread_root"), ["conv_id", "turn"], "left")
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.select("conv_id", "turn", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("i")), "places")
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in dealt.groupBy("p").agg(F.count("*")).collect()):
        starts.append(f"({p}, {before}L)")
        before += n
    if not starts:
        return dealt.select("conv_id", "turn", F.col("i").alias("place"))
    start = spark.sql(f"SELECT * FROM VALUES {', '.join(starts)} AS t(p, o)")  # a row a range
    numbered = dealt.join(F.broadcast(start), "p").select("conv_id", "turn", (F.col("o") + F.col("i")).alias("nr"))
    first = numbered.groupBy("conv_id").agg(F.min("nr").alias("first"))
    return numbered.join(first, "conv_id").select("conv_id", "turn", (F.col("nr") - F.col("first")).alias("place"))


def thread(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, thread_root, reply_depth, place, n_quotes, n_linked, own_text."""
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    links = materialise(link(parsed), "quotes")
    tree = roots(links)
    out = parsed.join(links, ["conv_id", "turn"], "left").join(tree, ["conv_id", "turn"], "left").join(places(messages, tree), ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("reply_depth", zero).alias("reply_depth"), "place", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), F.col("own").alias("own_text"))


def conversations(messages: DataFrame, span: int = 64) -> DataFrame:
    """Threads as chat text in reply order, in blocks of `span` places so that no group is unbounded.

    (conv_id, thread_root, block, messages array<struct<place, turn, role, text>>); messages without own text are left out.
    """
    rows = thread(messages).where("conv_id IS NOT NULL AND turn IS NOT NULL AND own_text <> ''").dropDuplicates(["conv_id", "turn", "role", "own_text"])
    one = F.struct("place", "turn", "role", F.col("own_text").alias("text"))
    return rows.groupBy("conv_id", "thread_root", F.expr(f"place div {span}").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("messages"))
