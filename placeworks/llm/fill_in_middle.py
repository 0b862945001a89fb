"""Fill-in-middle training texts, made by counting marks in the text itself.

A text's units are runs of ASCII letters and single other characters. One replacement puts a mark behind each unit, marks
that the text holds already being escaped; the marks are counted, and ``substring_index`` cuts before the mark of a
given rank. No array of units is made, so a text costs a few times its own length. All of it is Spark SQL, row by row:
nothing is shuffled, and a lost executor costs the rows it held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN_SHARE, SPM_SHARE = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_MARK, _ESCAPE = "\x01", "\x02"
_UNIT = rf"[A-Za-z]+|{_ESCAPE}[12]|[^A-Za-z]"


def marked(text: Column) -> Column:
    """``text`` with a mark behind each unit; the two signs that marking uses are escaped by a digit, which stays in their unit."""
    escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "2")), F.lit(_MARK), F.lit(_ESCAPE + "1"))
    return F.regexp_replace(escaped, _UNIT, f"$0{_MARK}")


def unmarked(piece: Column) -> Column:
    """What ``marked`` was given, of any run of whole units."""
    without = F.replace(piece, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(without, F.lit(_ESCAPE + "1"), F.lit(_MARK)), F.lit(_ESCAPE + "2"), F.lit(_ESCAPE))


def _cut(text: Column, rank: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(_MARK), rank.cast("int"))


def draws(id_: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of each id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of."""
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of every row.

    ``plain_share`` of a hundred texts stay as they are, and so do empty ones and those that hold one of the three markers, as they could not be
    told apart afterwards. Of the rest ``spm_share`` of a hundred put the suffix first. A null text is an empty one: n is 0,
    the output empty. Rows with a null id all draw alike; repeated rows give repeated results; an empty table
    none; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    units = base.withColumn("marks", marked(F.col("text")))
    units = units.withColumn("n", F.octet_length("marks").cast("long") - F.octet_length(F.replace("marks", F.lit(_MARK), F.lit(""))))
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | held | (h3 % 100 >= 100 - plain_share)
    units = units.withColumns({"form": F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm"), "a": h1 % (F.col("n") + 1), "b": h2 % (F.col("n") + 1)})
    units = units.withColumns({"first": F.least("a", "b"), "last": F.greatest("a", "b"), "plain": F.col("form") == "plain"})
    to_middle_end = _cut(F.col("marks"), F.col("last"))
    parts = units.select(
        "doc_id", "text", "n", "form", "plain",
        F.when(~F.col("plain"), unmarked(_cut(F.col("marks"), F.col("first")))).alias("prefix"),
        F.when(~F.col("plain"), unmarked(_cut(to_middle_end, F.col("first") - F.col("last")))).alias("middle"),
        # the last unit has a mark behind it too, so one more is counted from the right
        F.when(~F.col("plain"), F.when(F.col("last") == F.col("n"), "").otherwise(unmarked(_cut(F.col("marks"), F.col("last") - F.col("n") - 1)))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("plain"), F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return parts.select("doc_id", "text", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), output.alias("output"))
