"""Chat formatting: conversations as one string each, with a loss mask, in Spark expressions only.

A turn is written ``<|turn|>role\\ntext<|end|>\\n``. Inside role and text a backslash becomes ``\\s`` and ``<|`` becomes
``\\m``, inside a role also a newline becomes ``\\n``; every backslash of the output is thus followed by a letter that
names what it stands for, so texts hold no control string and escaping is undone exactly.

Turns are sorted by (turn, role, text); adjacent turns of one role are merged into one. Between their texts stands
``<|and|>``, which is never learnt and reads back as a newline. The mask is run-length coded by turn: what precedes the
texts, each text (learnt for the assistant), the joint after it, and at the end of the turn what closes it.

Edge cases: null text or role counts as empty, a null turn comes first, rows without a conversation id form one
conversation, repeated rows are repeated turns, an empty table gives no row. Other columns are ignored, whatever their
names. A conversation is one value by definition, so it has to fit in one, with very long texts as with many turns
(the escaped form at most doubles them); map-side lists keep its rows from being shuffled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, JOINT, CLOSE = "<|turn|>", "<|and|>", "<|end|>\n"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\m"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\m"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def chat_format(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, loss_mask) from (conv_id, turn, role, text); the mask has for each turn an array of runs.

    A run is a struct of its length in code points and whether it is learnt; runs follow each other without gaps.
    """
    blank = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    told = turns.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    heads = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda k: (k == 0) | (F.get("t", k)["role"] != F.get("t", k - 1)["role"]))
    told = told.withColumn("h", heads)

    def merged(k: Column, i: Column) -> Column:
        to = F.coalesce(F.get("h", i + 1), F.size("t"))
        role = F.get("t", k)["role"]
        return F.struct(role.alias("role"), F.concat(F.lit(OPEN), _escape_role(role), F.lit("\n")).alias("head"), F.transform(F.slice("t", k + 1, to - k), lambda x: escape(x["text"])).alias("texts"))

    told = told.withColumn("m", F.transform("h", merged))
    formatted = F.array_join(F.transform("m", lambda x: F.concat(x["head"], F.array_join(x["texts"], JOINT), F.lit(CLOSE))), "")

    def runs(x: Column) -> Column:
        run = lambda length, learn: F.struct(length.cast("int").alias("length"), learn.alias("learn"))
        after = lambda i: F.when(i < F.size(x["texts"]) - 1, len(JOINT)).otherwise(len(CLOSE))
        texts = F.transform(x["texts"], lambda t, i: F.array(run(F.char_length(t), x["role"] == LEARNT), run(after(i), F.lit(False))))
        return F.concat(F.array(run(F.char_length(x["head"]), F.lit(False))), F.flatten(texts))

    return told.select(key, formatted.alias("formatted"), F.transform("m", runs).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text as they were) and ``learnt`` (texts under the mask, unescaped) from the output alone."""
    pieces = F.split("formatted", r"<\|end\|>\n", -1)
    split = formatted.withColumn("p", F.slice(pieces, 1, F.size(pieces) - 1))

    def parts(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        cut = F.instr(body, "\n")
        return F.struct(F.substr(body, F.lit(1), cut - 1).alias("role"), F.split(F.substr(body, cut + 1), r"<\|and\|>", -1).alias("texts"))

    split = split.withColumn("p", F.transform("p", parts))

    def turn(x: Column) -> Column:
        return F.struct(_unescape_role(x["role"]).alias("role"), F.array_join(F.transform(x["texts"], unescape), "\n").alias("text"))

    def under_mask(x: Column, k: Column) -> Column:
        # Of a turn's runs, text i is the one after the head and i texts with what follows them.
        run = lambda i: F.get(F.get("loss_mask", k), i * 2 + 1)
        return F.transform(x["texts"], lambda t, i: F.when(run(i)["learn"], unescape(F.substr(t, F.lit(1), run(i)["length"]))))

    learnt = F.array_compact(F.flatten(F.transform("p", under_mask)))
    return split.withColumn("turns", F.transform("p", turn)).withColumn("learnt", learnt).drop("p")
