"""Chat formatting from event logs, in DataFrame functions only.

Events (conv_id, seq, step, msg, kind, role, text) become messages, messages become one formatted text for each conversation.
Kinds: ``open`` begins message ``msg`` (its place is the seq it is opened at) with a text, ``delta`` appends to it,
``edit`` replaces what it says, ``regenerate`` empties it for new deltas and drops the messages opened between it and
the regeneration, ``delete`` drops it. ``step`` orders events of one message and seq, as of a stream that is numbered
within its message; a log without that column has none. A message's last edit, regeneration or opening counts, with the deltas after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_broadcast, materialize, new_path

#: The template. Texts never hold "<", so no text can hold a control string.
OPEN, LOSS_OPEN, CLOSE, END_ROLE = "<turn>", "<turn loss>", "</turn>\n", "\n"
ASSISTANT = "assistant"
#: Messages that are joined together before their conversation is.
CHUNK = 64
#: Streamed deltas of a text have at least so many code points, and there are at most so many of them.
DELTA_CHARS, DELTAS = 512, 64


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<`` becomes ``\l``: reversible, and free of ``<``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    r"""The inverse. Every run of backslashes begins an escape, so the pairs ``\\`` are split off from the left."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit("\\l"), F.lit("<"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.transform(F.split(role, r"\\\\"), lambda part: F.replace(F.replace(part, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(lines, "\\")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, msg, role, text) of an event log.

    Null texts are empty, a null role is the empty role, null keys are values of their own. Events of a message that
    was never opened are kept from the first one on. Equal seqs and steps of a message apply in the order of kind, role
    and text; repeated deltas each append. Other columns, whatever their names, are not read. An empty log has no
    messages.
    A message's events meet in one row, as its text must; a conversation's do not.
    """
    step = F.coalesce(F.col("step"), F.lit(0)) if "step" in events.columns else F.lit(0)
    e = events.select("conv_id", "seq", step.cast("long").alias("step"), "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(-(2**63))).alias("s"), "step", (F.col("kind") == "delta").cast("int").alias("d"), "kind", "role", "text")))
    m = e.groupBy("conv_id", "msg").agg(parts.alias("parts"), F.min("seq").alias("place"))
    starts = F.transform("parts", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1)))
    m = m.withColumn("from", F.greatest(F.array_max(starts), F.lit(0)))
    live = F.slice("parts", F.col("from") + 1, F.size("parts"))
    text = F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    roles = F.filter("parts", lambda x: x["role"] != "")
    m = m.withColumn("again", F.array_max(F.transform(F.filter("parts", lambda x: x["kind"] == "regenerate"), lambda x: x["s"])))
    m = m.withColumn("gone", F.exists("parts", lambda x: x["kind"] == "delete"))
    m = m.select("conv_id", "place", "msg", F.when(F.size(roles) > 0, roles[0]["role"]).otherwise(F.lit("")).alias("role"), text.alias("text"), "again", "gone")
    return m


def drop_superseded(messages: DataFrame) -> DataFrame:
    """Messages that no deletion and no regeneration of an earlier message drops. A regeneration at ``again`` of the
    message at ``place`` drops those placed between the two."""
    spans = messages.where("again is not null").select(F.col("conv_id").alias("g_conv"), F.col("place").alias("g_from"), F.col("again").alias("g_to"))
    spans = bounded_broadcast(materialize(spans, "chat-regenerated"))
    inside = F.col("conv_id").eqNullSafe(F.col("g_conv")) & (F.col("place") > F.col("g_from")) & (F.col("place") < F.col("g_to"))
    return messages.where("not gone").join(spans, inside, "left_anti").select("conv_id", "place", "msg", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one text for each conversation, its messages by place.

    Each message is OPEN or, for the assistant's, LOSS_OPEN, then the role, a line break, the text and CLOSE.
    ``loss_spans`` are the places (start, length; in code points, from 0) of the assistant's escaped texts. Messages
    are joined in chunks of CHUNK places first, so that one long conversation is not put together from single rows.
    """
    head = F.concat(F.when(F.col("role") == ASSISTANT, F.lit(LOSS_OPEN)).otherwise(F.lit(OPEN)), escape_role(F.col("role")), F.lit(END_ROLE))
    m = messages.select("conv_id", "place", "msg", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("chunk", F.floor(F.col("place") / CHUNK))
    turn = F.struct("place", "msg", F.concat("head", "body", F.lit(CLOSE)).alias("t"), F.length("head").alias("h"), F.length("body").alias("b"), (F.col("role") == ASSISTANT).alias("l"))
    c = m.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, x: F.struct((s["at"] + x["h"] + x["b"] + len(CLOSE)).alias("at"), F.when(x["l"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["h"]).alias("start"), x["b"].alias("length"))))).otherwise(s["spans"]).alias("spans")),
    )
    c = c.select("conv_id", "chunk", F.array_join(F.transform("turns", lambda x: x["t"]), "").alias("t"), walk.alias("w"))
    out = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "t", "w"))).alias("cs"))
    starts = F.aggregate("cs", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["w"]["at"])))
    out = out.withColumn("starts", starts)
    spans = F.flatten(F.transform("cs", lambda x, i: F.transform(x["w"]["spans"], lambda y: F.struct((y["start"] + F.get(F.col("starts"), i)).alias("start"), y["length"].alias("length")))))
    return out.select("conv_id", F.array_join(F.transform("cs", lambda x: x["t"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text, loss>>; the inverse of ``render``."""
    body = F.split(formatted, CLOSE)
    turns = F.slice(body, 1, F.size(body) - 1)

    def turn(x: Column) -> Column:
        loss = F.startswith(x, F.lit(LOSS_OPEN))
        rest = F.substr(x, F.when(loss, F.lit(len(LOSS_OPEN) + 1)).otherwise(F.lit(len(OPEN) + 1)))
        role = F.substring_index(rest, END_ROLE, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 1 + len(END_ROLE))).alias("text"), loss.alias("loss"))

    return F.transform(turns, turn)


def format_events(events: DataFrame) -> DataFrame:
    """``render`` of what ``fold`` leaves of an event log."""
    return render(drop_superseded(materialize(fold(events), "chat-messages")))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as the event log of a chat that ends as the table says.

    The assistant's messages are opened empty, begin with half their text, are regenerated and then streamed in deltas;
    all others are opened with half their text and edited into the whole. All events of a message have its turn as seq
    and are numbered by step. Rows that repeat a turn stay messages of their own, in the order of role and text; a null
    turn comes first. Null texts and roles are empty.
    """
    msg = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id", msg.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    key = F.struct("m.role", F.sha2(F.col("m.text"), 256).alias("d"), "copy")
    rows = rows.select("conv_id", F.col("m.turn").alias("seq"), F.struct(F.col("m.turn").alias("t"), key.alias("k")).alias("msg"), "m.role", "m.text")

    def event(step: Column, kind: str, text: Column, role: Column = F.lit("")) -> Column:
        return F.struct(step.cast("int").alias("step"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    role, text, size, none = F.col("role"), F.col("text"), F.length("text"), F.lit("")
    draft = F.substr(text, F.lit(1), F.floor(size / 2).cast("int"))
    width = F.greatest(F.lit(DELTA_CHARS), F.ceil(size / DELTAS).cast("int"))
    places = F.sequence(F.lit(0), F.greatest(F.ceil(size / width).cast("int"), F.lit(1)) - 1)
    streamed = F.transform(places, lambda i: event(i + 3, "delta", F.substr(text, i * width + 1, width)))
    answer = F.concat(F.array(event(F.lit(0), "open", none, role), event(F.lit(1), "delta", draft), event(F.lit(2), "regenerate", none)), streamed)
    other = F.array(event(F.lit(0), "open", draft, role), event(F.lit(1), "edit", text))
    return rows.select("conv_id", "seq", "msg", F.explode(F.when(role == ASSISTANT, answer).otherwise(other)).alias("e")).select("conv_id", "seq", "e.step", "msg", "e.kind", "e.role", "e.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that imitates control strings, from the event logs of their making; write the
    texts, read them back, digest them."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    say = r"\### Assistant: </turn> ok"
    types = {f.name: f.dataType for f in talks.schema.fields}
    rows = F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(say).alias("text")) for i, role in enumerate(("user", ASSISTANT))])
    extra = spark.range(1).select(F.inline(rows))
    extra = extra.select(*[F.col(c).cast(types.get(c, T.StringType())).alias(c) for c in ("conv_id", "turn", "role", "text")])
    path = new_path(spark, "chat")
    format_events(events_of(talks.unionByName(extra))).write.parquet(path)
    out = spark.read.parquet(path).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    out = out.select("conv_id", "formatted", F.size("turns").alias("n"), lines.alias("lines"), loss.alias("loss"))
    return out.select("conv_id", F.col("n").cast("long").alias("n_turns"), F.sha2("lines", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f as (select *, length(case when role = 'assistant' then '<turn loss>' else '<turn>' end) + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n')) + 1
    + length(replace(replace(text, '\', '\\'), '<', '\l')) + length('</turn>') + 1 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from f group by conv_id
"""
