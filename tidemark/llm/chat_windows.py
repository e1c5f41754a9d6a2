"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are written as ``<|im_start|>role`` line end ``text<|im_end|>`` line end. In a text a backslash is doubled
and ``<|`` becomes ``<\\|``, so no text can hold a control string and every text can be had back.
Prefix sums of turn tokens deal the turns of a conversation to spans of about half the budget, whole
turns only. A span's window is the conversation's system turn, the preceding turns that fit the history
allowance, and the span itself; what is repeated from earlier windows is never under the loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import need

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Budget:
    """Tokens of a window (``window``), of which at most ``history`` repeat earlier turns.

    A token is reckoned as ``bytes_per_token`` bytes of the formatted turn. A span takes the turns that
    start within one ``stride``; a window exceeds ``window`` only by a turn longer than a stride, which is
    kept whole, or by a system turn longer than ``system``.
    """

    window: int = 2048
    history: int = 512
    system: int = 256
    bytes_per_token: int = 4

    @property
    def stride(self) -> int:
        return max(1, (self.window - self.history - self.system) // 2)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role on one line: plain ones as they are, others (line ends, control strings) in hex after a backslash."""
    return F.when(role.rlike(r"\A[A-Za-z0-9_. -]*\z"), role).otherwise(F.concat(F.lit("\\"), F.hex(F.encode(role, "UTF-8"))))


def unescape_role(role: Column) -> Column:
    return F.when(role.startswith("\\"), F.decode(F.unhex(F.substring(role, 2, 1 << 30)), "UTF-8")).otherwise(role)


def windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> one row per window.

    ``(conv_id, window, text, fresh, loss_spans)``: formatted text, the code point at which turns begin that
    no earlier window had, and the code points (start, end exclusive) of assistant texts to learn, each
    under the mask of exactly one window. Turns go by ``turn`` (null first), ties by role and text; repeated
    rows are turns of their own. A null text or role is empty; rows of a null conv_id form one conversation.
    """
    t = need(conversations, "conv_id", "turn", "role", "text")
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    t = t.withColumn("head", head).withColumn("body", escape(F.col("text")))
    t = t.withColumn("tokens", F.ceil((F.octet_length("head") + F.octet_length("body") + F.lit(len(CLOSE))) / F.lit(budget.bytes_per_token)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("start", F.col("end") - F.col("tokens")).withColumn("span", F.floor(F.col("start") / F.lit(budget.stride)))
    by_at = Window.partitionBy("conv_id").orderBy("at")
    t = t.withColumn("first", F.coalesce(F.lag("span").over(by_at) != F.col("span"), F.lit(True)))
    message = F.struct("at", "head", "body", (F.col("role") == "assistant").alias("learn"))
    system = F.when((F.col("at") == 1) & (F.col("role") == "system"), message)
    # the turns that start within the history allowance before this one, all of them whole
    before = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-budget.history, -1)
    t = t.withColumn("message", message).withColumn("system", F.first(system, ignorenulls=True).over(by_at.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("history", F.when(F.col("first"), F.collect_list("message").over(before)))
    w = t.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list("message")).alias("own"), F.max("history").alias("history"), F.max("system").alias("system"))
    none = F.array().cast("array<struct<at:int,head:string,body:string,learn:boolean>>")
    lead = F.element_at("own", 1)["at"]
    kept = F.when(F.col("system").isNotNull() & (lead > 1), F.array("system")).otherwise(none)
    past = F.filter(F.array_sort(F.coalesce("history", none)), lambda m: (m["at"] < lead) & ~((m["at"] == 1) & F.col("system").isNotNull()))
    w = w.withColumn("context", F.concat(kept, past))
    written = lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE))
    context = F.array_join(F.transform("context", written), "")
    w = w.withColumn("context_text", context).withColumn("fresh", F.length(context))
    text = F.concat("context_text", F.array_join(F.transform("own", written), ""))
    sizes = F.struct(F.col("fresh").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(done: Column, m: Column) -> Column:
        start = done["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.lit(len(CLOSE))).alias("at"), F.when(m["learn"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return w.select("conv_id", F.col("span").alias("window"), text.alias("text"), "fresh", F.aggregate("own", sizes, place, lambda d: d["spans"]).alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """``array<struct<role,text>>`` of formatted text."""
    parts = F.slice(F.split(text, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        body = F.substring(p, line + 1, F.length(p) - line - len(CLOSE))
        return F.struct(unescape_role(F.substring(p, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its windows: turns, texts under the loss mask, and sizes."""
    fresh = read_turns(F.substring(F.col("text"), F.col("fresh") + 1, F.length("text")))
    learnt = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    each = formatted.select("conv_id", F.length("text").cast("long").alias("chars"), F.struct(F.col("window"), fresh.alias("turns"), learnt.alias("learnt")).alias("w"))
    g = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    g = g.withColumn("turns", F.flatten(F.transform("w", lambda x: x["turns"])))
    g = g.withColumn("learnt", F.array_join(F.flatten(F.transform("w", lambda x: x["learnt"])), ""))
    said = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                    F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
