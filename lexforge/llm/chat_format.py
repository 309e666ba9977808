"""Chat formatting with a grammar round trip, in DataFrame operations only.

Each turn becomes ``open role separator text close``.  A deterministic parser (split at the close
mark, cut at the first separator) reads the result back.  A turn whose raw rendering doesn't come
back identical, or that holds a control string, is rendered with escapes, and the whole output is
parsed and compared again.

The escape puts a backslash behind the first character of every control string (``<|im_end|>``
becomes ``<\\|im_end|>``); a text that already has ``n`` backslashes there gets ``n + 1``, so the
mapping can be undone for every text.  Roles also percent-encode ``%`` and the line break.

Defined results: null role or text counts as empty; null turns come first; equal turns are ordered
by role, then text; null conversation ids form one conversation; an empty table gives no rows;
further columns are ignored.  A conversation is one output string by nature, so it is one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of public chat formats.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<|im_start|>"
    separator: str = "\n"
    close: str = "<|im_end|>\n"
    control: tuple[str, ...] = CONTROL
    loss_roles: tuple[str, ...] = ("assistant",)

    def tails(self) -> str:
        """Alternation of what follows the last bracket that can begin a control string."""
        return "|".join(dict.fromkeys(re.escape(re.sub(r"^[<\[]+", "", c)) for c in self.control))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self.tails()})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self.tails()})", r"$1$2$3")

    def escape_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit(self.separator), text, F.lit(self.close))

    def parse(self, formatted: Column) -> Column:
        """array<struct<role, text>> of the turns; null where the string isn't of the grammar."""
        parts = F.split(formatted, re.escape(self.close), -1)
        body = F.slice(parts, 1, F.size(parts) - 1)
        well = (F.element_at(parts, -1) == "") & F.forall(
            body, lambda p: p.startswith(self.open) & F.contains(p, F.lit(self.separator))
        )
        skip = len(self.open)

        def turn(p: Column) -> Column:
            at = F.locate(self.separator, p)
            return F.struct(
                self.unescape_role(F.substring(p, F.lit(skip + 1), at - skip - 1)).alias("role"),
                self.unescape(F.substring(p, at + len(self.separator), F.char_length(p))).alias("text"),
            )

        return F.when(well, F.transform(body, turn))


def format_conversations(
    rows: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 1, length; in code
    points of ``formatted``), turns (as parsed back) and round_trip (parsed turns equal the source).
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    raw = template.render(F.col("role"), F.col("text"))
    safe = template.render(template.escape_role(F.col("role")), template.escape(F.col("text")))
    plain = (template.escape(F.col("text")) == F.col("text")) & (template.escape(F.col("role")) == F.col("role"))
    turns = turns.withColumn("raw", raw).withColumn(
        "raw_ok", F.coalesce((template.parse(F.col("raw")) == source) & plain, F.lit(False))
    )
    turns = turns.withColumn("shown_role", F.when(F.col("raw_ok"), F.col("role")).otherwise(template.escape_role(F.col("role"))))
    turns = turns.withColumn("piece", F.when(F.col("raw_ok"), F.col("raw")).otherwise(safe)).drop("raw", "raw_ok")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn(
        "before", F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    head = len(template.open) + len(template.separator)
    start = F.coalesce("before", F.lit(0)) + head + F.char_length("shown_role") + 1
    length = F.char_length("piece") - head - F.char_length("shown_role") - len(template.close)
    turns = turns.select(
        "conv_id",
        F.struct(
            "n",
            "role",
            "text",
            "piece",
            start.cast("int").alias("start"),
            length.cast("int").alias("length"),
            F.col("role").isin(list(template.loss_roles)).alias("loss"),
        ).alias("t"),
    )
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    out = joined.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))
        ).alias("loss_spans"),
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    out = out.withColumn("turns", template.parse(F.col("formatted")))
    return out.withColumn("round_trip", F.coalesce(F.col("turns") == F.col("source"), F.lit(False))).drop("source")


def loss_text(formatted: Column, spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, read from the output and unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: template.unescape(F.substring(formatted, s["start"], s["length"]))), ""
    )
