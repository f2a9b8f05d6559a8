"""Chat formatting with a checked round trip (DataFrame functions only).

One turn renders as ``<s> role [INST] text [/INST] </s>``; a conversation is its
turns in order. A deterministic grammar reads the turns back: the control strings
count as marks only where no backslash stands before them. Every rendered turn is
parsed again and compared with its source; where they differ the content is escaped
(one backslash in front of each control string and the backslashes it already has),
parsed and compared once more. One round always suffices, because an escaped text
holds no bare control string and the marks are set off by spaces; a turn that still
differed would stop the job.

Shuffle: one exchange on the conversation id. The running offset of a turn is a
streaming window over that exchange, and the final string of a conversation is the
requested result, so it must exist whole in one row (a single conversation is the
only unit that is not split further). Rendering, checking and escaping work row by
row before the exchange.

Cases: null text and null role are empty; a null turn number sorts first; equal turn
numbers sort by role, then text; repeated rows are repeated turns; a null conversation
id is a conversation of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed control strings of the template
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ANY = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
_ESCAPE = rf"(\\*(?:{_ANY}))"
_UNESCAPE = rf"\\(\\*(?:{_ANY}))"
_BARE = rf"(?<!\\)(?:{_ANY})"
_TURN = r"(?s)<s> (.*?) \[INST\] (.*?) \[/INST\] </s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s> "), role, F.lit(" [INST] "), text, F.lit(" [/INST] </s>"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    return F.zip_with(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)),
                      F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)),
                      lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def _same(rendered: Column, role: Column, text: Column, put_role: Column, put_text: Column) -> Column:
    """The grammar allows no bare control string inside a turn's content, and reads the source back."""
    bare = put_role.rlike(_BARE) | put_text.rlike(_BARE)
    return ~bare & (parse(rendered) == F.array(F.struct(role.alias("role"), text.alias("text"))))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", train_role: str = "assistant") -> DataFrame:
    """``conv, formatted, loss_mask``: the mask lists the spans of ``train_role``'s texts in
    ``formatted``, in order, as code points (``start, length``) and bytes (``byte_start, byte_length``)."""
    x = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    r, t = F.col("role"), F.col("text")
    plain = _same(render(r, t), r, t, r, t)
    x = x.withColumn("er", F.when(plain, r).otherwise(escape(r))).withColumn("et", F.when(plain, t).otherwise(escape(t)))
    out = render(F.col("er"), F.col("et"))
    checked = F.when(plain | _same(out, r, t, F.col("er"), F.col("et")), out).otherwise(F.raise_error(F.lit("a turn does not survive its round trip")))
    x = x.select("conv", "turn", "role", "text", "et", checked.alias("out"),
                 (F.length("er") + len("<s>  [INST] ")).alias("at"),
                 (F.octet_length("er") + len("<s>  [INST] ")).alias("byte_at"))
    w = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select("conv", "role", "et", "out", F.row_number().over(w).alias("i"),
                 (F.coalesce(F.sum(F.length("out").cast("long")).over(before), F.lit(0)) + F.col("at")).alias("start"),
                 (F.coalesce(F.sum(F.octet_length("out").cast("long")).over(before), F.lit(0))
                  + F.col("byte_at")).alias("byte_start"))
    span = F.struct("start", F.length("et").cast("long").alias("length"), "byte_start",
                    F.octet_length("et").cast("long").alias("byte_length"))
    g = x.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "out"))).alias("parts"),
                              F.array_sort(F.collect_list(F.when(F.col("role") == train_role, span))).alias("loss_mask"))
    return g.select(F.col("conv").alias(conv), F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("formatted"),
                    "loss_mask")


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order. Slices bytes: cutting by code
    points would walk the string from its start for every span."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substring(raw, (m["byte_start"] + 1).cast("int"), m["byte_length"].cast("int")).cast("string"))), "")


# --------------------------------------------------------------------------- query

_OWN = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark, sf_dir):
    from ledgerspark.llm.common import table
    rows = ", ".join(f"({c}L, {i}L, '{r}', '{t}')" for c, i, r, t in _OWN)
    own = spark.sql(f"SELECT * FROM VALUES {rows} AS v(conv_id, turn, role, text)")
    src = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    f = format_conversations(src)
    back = f.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                    masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_LEN = rf"length(regexp_replace({{0}}, '{_ESCAPE}', '\\\1', 'g'))"
OP8_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES {", ".join(f"({c}, {i}, '{r}', '{t}')" for c, i, r, t in _OWN)}))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum({len("<s>  [INST]  [/INST] </s>")} + {_LEN.format("role")} + {_LEN.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
