"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Each turn becomes one formatted piece, `### role: text</turn>` and a line end, in which a backslash, `<`, `#` (and `:` in a role)
are written as a backslash and a letter, so no text can hold a control string and unescaping gives the text back.
Every assistant turn is then exploded into an example of its own: its context is all of the conversation's formatted text before
the reply, and only the reply is trainable. Contexts are prefixes of each other, so an example names its context as the range
[0, context_end) of the conversation's text, and its mask as the range [loss_start, loss_end). `write_examples` stores the
pieces, each once, and the examples with their replies; `digest` reads both back. `render_examples` writes contexts out in full,
which costs the square of a conversation's turns by nature.

Edge cases: null text is an empty turn, null role the role "" (never an assistant); equal turn numbers are ordered by role and
text; repeated rows are turns of their own; a conversation without an assistant has no example and an empty loss text; a
null conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import scratch_path

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    # every backslash is followed by its letter, so the order is free but for the backslash itself
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def format_turns(df: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, piece, start, end, loss_start, loss_end, example): a turn's formatted text, its place in the conversation's
    text, the part of the piece that is trainable (null but for assistant turns) and the number of its example."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = df.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(AFTER_ROLE))
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = F.col("role") == ASSISTANT
    placed = pieces.select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        "piece",
        F.sum(F.length("piece")).over(so_far).alias("end"),
        F.when(target, F.length("head")).alias("loss_start"),
        F.when(target, F.length("head") + F.length("body")).alias("loss_end"),
        F.when(target, F.sum(target.cast("int")).over(so_far)).alias("example"),
    )
    return placed.withColumn("start", F.col("end") - F.length("piece"))


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its example number and place, the ranges of its context and of its trainable part in the conversation's
    text, the reply as formatted, and the example's length."""
    reply = F.expr("substring(piece, loss_start + 1, loss_end - loss_start)")
    begin = F.col("start") + F.col("loss_start")
    example = F.struct("example", F.lit(0).cast("long").alias("context_start"), begin.alias("context_end"), begin.alias("loss_start"), (F.col("start") + F.col("loss_end")).alias("loss_end"), reply.alias("reply"), F.col("end").alias("chars"))
    return turns.where("example IS NOT NULL").select("conv_id", "pos", example.alias("e")).select("conv_id", "pos", "e.*")


def write_examples(df: DataFrame, folder: str | None = None) -> str:
    """Format df's turns and write `pieces` (a row a turn) and `examples` (a row an assistant turn) into a folder, by default in the shared one."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "chat")
    pieces = format_turns(df)
    pieces.write.parquet(f"{folder}/pieces")
    examples(spark.read.schema(pieces.schema).parquet(f"{folder}/pieces")).write.parquet(f"{folder}/examples")
    return folder


def render_examples(turns: DataFrame) -> DataFrame:
    """Examples with their whole context as text: (conv_id, example, context, reply)."""
    text = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("conversation"))
    both = examples(turns).alias("e").join(text.alias("t"), F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")))
    return both.select("e.conv_id", "e.example", F.expr("substring(conversation, 1, context_end)").alias("context"), "e.reply")


def read_back(turns: DataFrame) -> DataFrame:
    """Role and text of each turn, parsed from its formatted piece."""
    inside = F.expr(f"substring(piece, {len(OPEN) + 1}, length(piece) - {len(OPEN) + len(CLOSE)})")
    cut = F.locate(AFTER_ROLE, F.col("inside"))
    role = F.replace(F.expr("substring(inside, 1, cut - 1)"), F.lit("\\c"), F.lit(":"))
    rows = turns.withColumn("inside", inside).withColumn("cut", cut)
    return rows.select("conv_id", "pos", unescape(role).alias("role"), unescape(F.expr(f"substring(inside, cut + {len(AFTER_ROLE)})")).alias("text"), F.length("piece").alias("chars"))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """A row per conversation: its turns from the pieces, its trainable text from the examples. A digest needs a conversation's text in
    one place; nothing larger than one conversation is."""
    none, no = F.lit(None).cast("string"), F.lit(0).cast("long")
    turns = read_back(spark.read.parquet(f"{folder}/pieces"))
    turns = turns.select("conv_id", "pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), none.alias("loss"), F.col("chars").cast("long").alias("chars"), no.alias("example_chars"))
    targets = spark.read.parquet(f"{folder}/examples")
    targets = targets.select("conv_id", "pos", none.alias("turn"), unescape(F.col("reply")).alias("loss"), no.alias("chars"), F.col("chars").cast("long").alias("example_chars"))
    in_order = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("x")))))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["x"]), "")
    whole = turns.unionByName(targets).groupBy("conv_id").agg(
        F.count("turn").alias("n_turns"),
        text(in_order("turn")).alias("turns"),
        text(in_order("loss")).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("loss").alias("n_examples"),
        F.sum("example_chars").alias("example_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("losses").cast("long").alias("loss_chars"), F.sha2("losses", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "example_chars"
    )
