"""Written lists: cells that hold a list, tuple or set as a program would write it, read by a state machine over its tokens.

The grammar: [..], (..) and {..} of values and of each other, or values with commas and no brackets. Values are strings in
single or double quotes with the escapes \\\\ \\' \\" \\n \\r \\t, numbers without an exponent, None, True and False. A comma
may end a list. One value in round brackets, or without a comma, is no list, and {} is none either. Anything else is no
written list, and the cell is left to the reading of plain text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidencelake.functions.binding import let

STRING = r"""'(?:[^'\\\n]|\\[\\'"nrt])*'|"(?:[^"\\\n]|\\[\\'"nrt])*\""""
NUMBER = r"[+-]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?![\w.])"
TOKEN = rf"{STRING}|{NUMBER}|(?:None|True|False)(?!\w)|[\[\](){{}},]"
#: Nothing but tokens and white space, at least one comma or bracket.
COVERED = rf"^(?=[\s\S]*[,\[({{])(?:\s*(?:{TOKEN}))+\s*$"

#: What may come next.
VALUE, VALUE_OR_END, SEPARATOR = 0, 1, 2


def _escapes(body: Column) -> Column:
    """The text that a string's inside stands for."""
    c = F.replace(body, F.lit("\\\\"), F.lit("\x00"))
    for written, meant in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
        c = F.replace(c, F.lit(written), F.lit(meant))
    return F.replace(c, F.lit("\x00"), F.lit("\\"))


def _item(token: Column) -> Column:
    """A value as text: floats have a digit on either side of the point and no needless zeros."""
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"^\+", ""), r"^(-?)\.", "$10."), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return F.when(token.rlike("^['\"]"), _escapes(F.substring(token, F.lit(2), F.length(token) - 2))).when(token.contains(".") & token.rlike(r"^[+.\d-]"), whole).otherwise(F.regexp_replace(token, r"^\+|^-(?=0$)", ""))


def _step(s: Column, token: Column) -> Column:
    opens, closes, comma = token.isin("[", "(", "{"), token.isin("]", ")", "}"), token == ","
    stack, need = s["stack"], s["need"]
    popped = F.substring(stack, F.lit(1), F.length(stack) - 1)
    pairs = F.concat(F.substring(stack, -1, 1), token).isin("[]", "()", "{}")
    outer = lambda x: F.translate(x, "(", "") == ""  # nothing around it but round brackets
    started = (need == VALUE_OR_END) & F.substring(stack, -1, 1).isin("(", "{") & ~s["comma"]
    fine = F.when(opens, need != SEPARATOR).when(closes, pairs & (need != VALUE) & ~(started & (token == "}"))).when(comma, need == SEPARATOR).otherwise(need != SEPARATOR)
    lists = (comma & outer(stack)) | (closes & outer(popped) & (token.isin("]", "}") | started))
    return F.struct(
        (s["ok"] & fine).alias("ok"), F.when(opens, F.concat(stack, token)).when(closes, popped).otherwise(stack).alias("stack"),
        F.when(opens | comma, VALUE_OR_END).otherwise(SEPARATOR).alias("need"), (s["is_list"] | lists).alias("is_list"), comma.alias("comma"),
        F.when(opens | closes | comma, s["items"]).otherwise(F.array_append(s["items"], _item(token))).alias("items"),
    )


def written_items(c: Column) -> Column:
    """The values of a written list in order, those of inner lists among them; null if the cell is none."""
    start = F.struct(
        F.lit(True).alias("ok"), F.lit("").alias("stack"), F.lit(VALUE).alias("need"), F.lit(False).alias("is_list"), F.lit(False).alias("comma"), F.array().cast("array<string>").alias("items"),
    )
    finish = lambda s: F.when(s["ok"] & s["is_list"] & (s["stack"] == ""), s["items"])
    return F.when(c.rlike(COVERED), F.aggregate(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), start, _step, finish))


def with_items(c: Column, of_list, of_text) -> Column:
    """of_list(items) where a cell is a written list, else of_text(cell)."""
    return let(c, lambda text: F.when(text.rlike(COVERED), F.coalesce(let(written_items(text), of_list), of_text(text))).otherwise(of_text(text)))
