"""Removes passages of three or more lines that stand earlier in the corpus. DataFrame functions only.

Each window of three consecutive lines is hashed (128 bits). Of a window that stands in several places, all but the first
place, by document id and position, are later occurrences; lines that any later occurrence covers are removed. Windows
overlap, so longer passages are covered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3
P = "__l_"


def _lines(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(f"{P}lines", F.split(F.col(text), "\n"))


def later_starts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, starts): sorted distinct positions of later occurrences."""
    lined = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.split(F.col(f"`{text_col}`"), "\n").alias("ls"))
    hashed = lined.where(F.size("ls") >= WIDTH).select("id", F.col("ls"), F.sequence(F.lit(0), F.size("ls") - WIDTH).alias("at"))

    def window(i):
        x = [F.col("ls")[i + k] for k in range(WIDTH)]
        return F.struct(i.alias("p"), F.xxhash64(*x).alias("h"), F.xxhash64(F.lit(7), *x).alias("g"), F.concat(*x).rlike(r"[^\x20\x09-\x0D]").alias("filled"))

    windows = hashed.select("id", F.explode(F.transform("at", window)).alias("w")).where("w.filled").select("id", "w.p", "w.h", "w.g")
    firsts = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "p")).alias("first")).where("k > 1")
    later = windows.join(firsts, ["h", "g"]).where((F.col("id") != F.col("first.id")) | (F.col("p") != F.col("first.p")))
    return later.groupBy("id").agg(F.sort_array(F.collect_set("p")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts cut, and the columns n_lines and n_removed (long) behind its own.

    Lines end at \\n and are compared as they are. Windows of nothing but white space don't count. Texts of fewer than three
    lines, null texts (0 lines) and rows with a null id stay as they are. Rows that repeat an id are one document: what is cut
    from one is cut from all, and they are no later occurrences of each other. If all lines go, the text is empty, not
    null. An empty table gives an empty result. Columns of docs named n_lines or n_removed are replaced.
    """
    starts = later_starts(docs, id_col, text_col).select(F.col("id").alias(f"{P}id"), F.col("starts").alias(f"{P}starts"))
    joined = docs.join(starts.hint("shuffle_hash"), docs[id_col] == starts[f"{P}id"], "left")
    cut = _lines(joined, f"`{text_col}`").withColumn(f"{P}gone", F.array_distinct(F.flatten(F.transform(f"{P}starts", lambda p: F.sequence(p, p + WIDTH - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{P}lines") - 1), F.col(f"{P}gone"))
    text = F.when(F.col(f"{P}gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(left, lambda i: F.col(f"{P}lines")[i]), "\n"))
    cut = cut.withColumns({"n_lines": F.coalesce(F.size(f"{P}lines"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(f"{P}gone"), F.lit(0)).cast("long"), text_col: text})
    cut = cut.withColumn("n_lines", F.greatest(F.col("n_lines"), F.lit(0))).withColumn("n_removed", F.greatest(F.col("n_removed"), F.lit(0)))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*[F.col(f"`{c}`") for c in own], "n_lines", "n_removed")
