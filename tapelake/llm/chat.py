r"""Chat formatting from event logs.

A conversation is a log of events (conv_id, turn, seq, kind, role, text): `open` and `delta` add text to a turn's
message, `edit` and `regenerate` start it anew, `delete` drops it. Each message is folded from its events by sequence:
what precedes the last restart is void, the rest is joined. Messages are then rendered turn by turn as

    <turn ROLE>\nTEXT</turn>\n

with &, < and > of roles and texts written as &amp;, &lt; and &gt;, so that no text can hold a mark, and reading back
is exact. `loss_spans` marks the assistant's texts: position of the turn's piece, start and length in code points.

Rules: null text or role is empty; null conv_id is a conversation of its own; null turn comes first; an event that is
delivered again unchanged counts once, different events of one turn and sequence join in the order of kind, role, text;
messages of one turn (told apart by a column of their own) follow each other by role and text; an empty log gives an
empty result. A message's deltas meet in a task of their own before a conversation's messages do;
one conversation is one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import pick

END = "</turn>\n"
RESTARTS = ("edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame, message: str | None = None) -> DataFrame:
    """conv_id, turn, role, text of each message that is left. A turn is one message unless a column `message` tells several apart."""
    empty = F.lit("")
    key = ["conv_id", "turn", *([message] if message else [])]
    event = F.struct("seq", "kind", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    logs = pick(events, *key, "seq", "kind", "role", "text").groupBy(*key).agg(F.sort_array(F.collect_set(event)).alias("log"))
    restart = F.array_max(F.transform("log", lambda e, k: F.when(e["kind"].isin(*RESTARTS), k).otherwise(0)))
    logs = logs.withColumn("live", F.slice("log", restart + 1, F.size("log"))).where(F.coalesce(F.element_at("live", -1)["kind"] != "delete", F.lit(True)))
    return logs.select("conv_id", "turn", F.element_at("log", 1)["role"].alias("role"), F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (piece, start, length)."""
    conv = messages.select("conv_id", F.struct("turn", "role", "text").alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    parts = conv.select("conv_id", F.transform("ms", lambda m: F.struct(F.concat(F.lit("<turn "), escape(m["role"]), F.lit(">\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == learn).alias("learn"))).alias("ps"))
    spans = F.filter(F.transform("ps", lambda p, k: F.struct(k.alias("piece"), F.char_length(p["head"]).alias("start"), F.char_length(p["body"]).alias("length"), p["learn"])), lambda s: s["learn"])
    return parts.select("conv_id", F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), F.transform(spans, lambda s: F.struct(s["piece"], s["start"], s["length"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_texts, from the formatted text and its spans alone."""
    cut = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    df = formatted.withColumn("_pieces", cut)
    role = lambda p: F.substr(F.substring_index(p, ">", 1), F.lit(len("<turn ") + 1))
    text = lambda p: F.substr(p, F.char_length(F.substring_index(p, ">", 1)) + 3)
    return df.select(
        "conv_id", "formatted",
        F.transform("_pieces", lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(F.get("_pieces", s["piece"]), s["start"] + 1, s["length"]))).alias("loss_texts"),
    )


def format_chats(events: DataFrame, learn: str = "assistant", message: str | None = None) -> DataFrame:
    return render(fold(events, message), learn)


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
