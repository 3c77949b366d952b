"""Chat formatting: event-sourced reconstruction. DataFrame functions only.

Logs hold events (conv_id, seq, turn, op, role, text). Sorted by seq, they are folded into messages:

- `delta` appends its text to the turn's message;
- `edit` puts its text in the place of all that the turn had before;
- `regenerate` discards what the turn had before and all events so far of later turns, and starts with its text.

An event is thus alive if no later edit of its turn and no later regeneration of its turn or an earlier one exist; a turn's
text is that of its living events, joined in order. The last regeneration up to a turn is a running maximum over turns, taken
over blocks of turns first and then over blocks, of the few columns that it needs. Whole texts shuffle twice: living events
by conversation and turn, where they are folded and rendered, and the pieces by conversation, so that a conversation with
many events is dealt over many tasks until its pieces meet in one row, the result.

A message is rendered as `<|role|>`, a line end, the text, `</s>` and a line end. Inside roles and texts `&`, `<`, `[` and `|` are
written `&amp;`, `&lt;`, `&#91;` and `&#124;`, so that no control string of any usual template (`</s>`, `[INST]`, `<|...|>`) can stand
there, and `unescape` gives back the very text. The loss mask is a list of code point spans: the texts of assistants.

Null texts and roles are empty, a null turn or seq counts as -1, a null op is a delta, a null conv_id is a conversation of
its own. An event delivered twice (equal in all six columns) counts once; ties in seq are ordered by op, role and text.
An empty log gives no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 64
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;")]
END = "</s>\n"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _last_again(e: DataFrame) -> DataFrame:
    """c, t, since: from which event on a turn's events are alive. One row a turn that an edit or a regeneration touches; blocks of turns keep windows small."""
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    turns = e.groupBy("conv_id", "turn").agg(last("edit").alias("edited"), last("regenerate").alias("again")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = turns.groupBy("conv_id", "block").agg(F.max("again").alias("whole")).filter("whole IS NOT NULL")
    before = F.max("whole").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("again").over(Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    # blocks without a regeneration take over the last one's: all blocks of a conversation, not of its events, meet in a window
    every = turns.select("conv_id", "block").distinct().join(blocks, ["conv_id", "block"], "left").withColumn("before", before)
    every = every.filter("before IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before")
    both = turns.withColumn("inside", inside).join(every, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    since = F.greatest("edited", "inside", "before")
    return both.withColumn("since", since).filter("since IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "since")


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, turn, role, text."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), number("seq"), number("turn"), F.coalesce("op", F.lit("delta")).alias("op"), F.col("role").cast("string").alias("role"), C.text_or_empty("text").alias("text"))
    since = _last_again(e.select("conv_id", "turn", "seq", "op"))
    alive = e.join(since, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").filter("since IS NULL OR seq >= since")
    parts = alive.groupBy("conv_id", "turn").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("seq", "op", "role", "text")))).alias("parts"))  # of one message
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r.isNotNull())
    return parts.select("conv_id", "turn", F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end, in code points from 0) of each conversation."""
    head, body = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")), escape(F.col("text"))
    m = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("says"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("piece"))
    whole = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "says", "head", "body", "piece"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, r: Column) -> Column:
        begin = a["at"] + r["head"]
        span = F.struct(begin.alias("start"), (begin + r["body"]).alias("end"))
        return F.struct((begin + r["body"] + len(END)).alias("at"), F.when(r["says"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return whole.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), F.aggregate("rows", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds, from the rendered text alone, turns (role and text of each message) and loss_text (what the mask covers, unescaped)."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def summaries(formatted: DataFrame) -> DataFrame:
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


PROBE = "</s>[INST] ok [/INST]"


def as_log(rows: DataFrame) -> DataFrame:
    """A log that ends in these messages (conv_id, turn, role, text; a row a message), as a service would have streamed them.

    Each text comes in two deltas, the first delivered twice. Every third message was begun with another text, which an edit replaces;
    of every fifth, a first answer was thrown away by a regeneration. Rows that agree in conversation and turn stay messages of their own: they are numbered in a
    stable order. Sequence numbers grow along the conversation, and rows come in no order.
    """
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = rows.select("conv_id", "role", C.text_or_empty("text").alias("text"), (F.row_number().over(place) - 1).cast("long").alias("turn"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    event = lambda k, op, text: F.struct((F.col("turn") * 8 + k).alias("seq"), F.lit(op).alias("op"), text.alias("text"))
    rest = F.substr(F.col("text"), half + 1)
    first = F.left("text", half)
    draft, edited, again = F.lit("a draft that is replaced"), F.col("turn") % 3 == 1, F.col("turn") % 5 == 2
    events = F.array(
        F.when(edited, event(0, "delta", draft)), F.when(again, event(1, "delta", F.lit("a first answer"))), F.when(again, event(2, "regenerate", F.when(edited, draft).otherwise(first))),
        F.when(edited, event(3, "edit", first)), F.when(~edited & ~again, event(4, "delta", first)), F.when(~edited & ~again, event(4, "delta", first)), event(5, "delta", rest),
    )
    return r.select("conv_id", "turn", "role", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("conv_id", "e.seq", "turn", "e.op", "role", "e.text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and conversation -1 as a log with deltas, edits, regenerations and repeated deliveries, folded and rendered."""
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS p(conv_id, turn, role, text)")
    return summaries(render(fold_events(as_log(rows.unionByName(probe)))))


QUERIES = {"op6_chat_format": op6_chat_format}
_ESC = "coalesce({}, '')"
for _raw, _safe in ESCAPES:
    _ESC = f"replace({_ESC}, '{_raw}', '{_safe}')"
ORACLE_SQL = {
    "op6_chat_format": f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 10) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id
    """
}
