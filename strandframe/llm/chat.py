"""Chat formatting with column expressions only.

A role machine checks the order of turns; a declarative template turns every
turn into an opening mark, escaped text and a closing mark, and says which
roles are trained on.  ``\\``, ``<``, ``[`` and ``>`` inside texts become
``\\e``, ``\\l``, ``\\b`` and ``\\g``, so no control string can appear in a text and the output can be
read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (opening mark, closing mark, loss); any other role uses OTHER with its escaped name
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
OTHER = ("<r:", ">", "</r>")
#: state -> {role: next state}
MACHINE = {
    "start": {"system": "briefed", "user": "asked"},
    "briefed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}


def escape(text: Column) -> Column:
    out = text
    for plain, coded in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), (">", "\\g")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, coded in ((">", "\\g"), ("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def _pick(role: Column, place: int, other: Column) -> Column:
    out = None
    for name, parts in TEMPLATE.items():
        out = (F if out is None else out).when(role == name, F.lit(parts[place]))
    return out.otherwise(other)


def _next(state: Column, role: Column) -> Column:
    out = F.lit("broken")
    for s, moves in MACHINE.items():
        for r, to in moves.items():
            out = F.when((state == s) & (role == r), F.lit(to)).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    conv_id, formatted, segments (role, start, length of the text in
    ``formatted``, loss), valid (the role machine accepts the order and ends
    after an answer).  Null texts and roles are empty; a role outside the
    template keeps its name and breaks validity; equal turn numbers are ordered
    by role, then text; a null turn comes first.  Null conv_ids form one
    conversation.  A conversation is one row of output, so its turns meet in one
    task by its nature.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_t"))
    opened = lambda r: _pick(r, 0, F.concat(F.lit(OTHER[0]), escape(r), F.lit(OTHER[1])))
    parts = F.transform("_t", lambda t: F.struct(
        t["role"].alias("role"), opened(t["role"]).alias("head"), escape(t["text"]).alias("body"),
        _pick(t["role"], 1, F.lit(OTHER[2])).alias("tail"), _pick(t["role"], 2, F.lit(False)).alias("loss"),
    ))
    state = F.aggregate("_t", F.lit("start"), lambda s, t: _next(s, t["role"]))
    cut = chats.select("conv_id", parts.alias("_p"), (state == "answered").alias("valid"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])
    segment = lambda p, at: F.struct(
        p["role"].alias("role"), (at + F.length(p["head"])).cast("int").alias("start"), F.length(p["body"]).cast("int").alias("length"), p["loss"].alias("loss")
    )
    kind = "array<struct<role:string,start:int,length:int,loss:boolean>>"
    walk = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, p: F.struct((acc["at"] + size(p)).cast("int").alias("at"), F.concat(acc["out"], F.array(segment(p, acc["at"]))).cast(kind).alias("out")),
        lambda acc: acc["out"],
    )
    return cut.select(
        "conv_id",
        F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        walk.alias("segments"),
        "valid",
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Turns (role, text) and the text under the loss mask, parsed from ``formatted`` and ``segments`` alone."""
    turn = r"(<<SYS>>|\[INST\]|<s>|<r:[^<>\[]*>)([^<\[>]*)(?:<</SYS>>|\[/INST\]|</s>|</r>)"
    heads, bodies = F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)), F.regexp_extract_all("formatted", F.lit(turn), F.lit(2))
    role = lambda h: F.coalesce(
        *[F.when(h == parts[0], F.lit(name)) for name, parts in TEMPLATE.items()], unescape(F.regexp_extract(h, "^<r:([^>]*)>$", 1))
    )
    turns = F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda z: F.struct(role(z["h"]).alias("role"), unescape(z["b"]).alias("text")))
    said = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(said, ""))
