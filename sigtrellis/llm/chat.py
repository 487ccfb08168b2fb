"""Chat formatting in budgeted windows, by DataFrame operations only.

A turn is written as ``<s>[INST]role\\ntext\\n[/INST]</s>``, one of the assistant as
``<s>role\\ntext\\n</s>``. Control strings (``<s> </s> [INST] [/INST]``) inside a text
get one backslash more than they have; reading takes it off again. Roles are
URL-encoded. The template always puts a line feed between a text and a control
string, so a backslash at the end of a text stays harmless.

Prefix sums of the turns' tokens (words and marks of the written turn) cut a
conversation into spans of whole turns. A window holds the system turn, if the
conversation starts with one, the turns that precede its span as far as
``history`` tokens go, at most ``HISTORY_TURNS``, and its span. Repeated turns are
masked: the loss lies on the assistant texts of the span alone. A window stays
within ``budget`` unless one turn alone exceeds the room; no text is cut.

Rows order by turn (null first), then role and text. Null roles and texts are
empty; rows whose conv_id is null are one conversation. Repeated rows are turns of
their own. Only a window's turns are collected into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
HISTORY_TURNS = 8
_CONTROL = r"(</?s>|\[/?INST\])"
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*){_CONTROL}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\\{_CONTROL}", "$1$2")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, window (from 0), formatted, repeated (turns at its start that other windows hold), loss (array of start, length in code points)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    said = F.col("role") == "assistant"
    head = F.concat(F.lit("<s>"), F.when(said, "").otherwise("[INST]"), F.url_encode("role"), F.lit("\n"))
    body, tail = escape(F.col("text")), F.when(said, "\n</s>").otherwise("\n[/INST]</s>")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.struct(F.concat(head, body, tail).alias("written"), F.char_length(head).alias("skip"), F.when(said, F.char_length(body)).alias("target"))
    turns = turns.select("conv_id", "turn", "role", "text", piece.alias("piece"), F.regexp_count(F.concat(head, body), F.lit(_TOKEN)).cast("long").alias("tokens"))
    turns = turns.withColumn("place", F.row_number().over(order))
    system = F.first(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.struct("piece", "tokens"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.withColumn("system", system)
    counted = F.when((F.col("place") == 1) & F.col("system").isNotNull(), F.lit(0)).otherwise(F.col("tokens"))
    turns = turns.withColumn("counted", counted).withColumn("start", F.coalesce(F.sum("counted").over(before), F.lit(0)))
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(budget // 4))
    # spans of turns that start in one half of the room and fit a half each hold no more than the room
    turns = turns.withColumn("large", F.col("counted") * 2 > room).withColumn("cell", F.floor(F.col("start") * 2 / room))
    opens = (F.col("place") == 1) | (F.col("cell") != F.lag("cell").over(order)) | F.col("large") | F.lag("large").over(order)
    turns = turns.withColumn("opens", opens).withColumn("window", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    earlier = F.collect_list(F.struct("piece", "start", "place")).over(order.rowsBetween(-HISTORY_TURNS, -1))
    near = F.filter(earlier, lambda t: (F.col("start") - t["start"] <= history) & ~((t["place"] == 1) & F.col("system").isNotNull()))
    first = F.when(F.col("system").isNotNull() & (F.col("place") > 1), F.array("system.piece")).otherwise(F.array().cast(f"array<{turns.schema['piece'].dataType.simpleString()}>"))
    turns = turns.withColumn("context", F.when(F.col("opens"), F.concat(first, F.transform(near, lambda t: t["piece"]))))
    grouped = turns.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("own"), F.first("context", ignorenulls=True).alias("context"))
    own = F.transform("own", lambda t: t["piece"])
    skipped = F.char_length(F.array_join(F.transform("context", lambda p: p["written"]), ""))
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def mask(state: Column, p: Column) -> Column:
        spot = F.when(p["target"].isNotNull(), F.array(F.struct((state["at"] + p["skip"]).alias("start"), p["target"].alias("length")))).otherwise(empty)
        return F.struct((state["at"] + F.char_length(p["written"])).alias("at"), F.concat(state["loss"], spot).alias("loss"))

    loss = F.aggregate(own, F.struct(skipped.alias("at"), empty.alias("loss")), mask, lambda s: s["loss"])
    formatted = F.array_join(F.transform(F.concat("context", own), lambda p: p["written"]), "")
    return grouped.select("conv_id", "window", formatted.alias("formatted"), F.size("context").alias("repeated"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """windows' rows with said (the turns of its span: role, text) and learned (the text under the loss), parsed from formatted."""
    pieces = F.split("formatted", r"(?<!\\)</s>", -1)
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - F.col("repeated") - 1)

    def parse(p: Column) -> Column:
        asked = F.startswith(p, F.lit("<s>[INST]"))
        rest = F.when(asked, F.substr(p, F.lit(10), F.char_length(p) - 9 - 8)).otherwise(F.substr(p, F.lit(4), F.char_length(p) - 4))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substr(rest, F.char_length(role) + 2)).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("said", F.transform(own, parse)).withColumn("learned", F.array_join(learned, ""))


def digest(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from the windows."""
    windowed = read_back(windows(conversations, budget, history))
    turns = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", turns.alias("turns"), F.col("learned"), F.size("said").alias("n"))
    whole = windowed.select("conv_id", part.alias("part"), F.char_length("formatted").cast("long").alias("chars")).groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return whole.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("parts").cast("long").alias("n_windows"),
    )
