"""Context for a prompt: adjacent chunks as groups, and packing under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as tx


def adjacent_groups(df: DataFrame, request: str, position: str, document: str, row: str) -> DataFrame:
    """``df`` with group: in list order, a row goes on with the group before if it is the next row of the same document."""
    w = Window.partitionBy(request).orderBy(position)
    goes_on = F.lag(document).over(w).eqNullSafe(F.col(document)) & (F.lag(row).over(w) + 1 == F.col(row))
    return df.withColumn("group", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))


def packed(df: DataFrame, request: str, position: str, text: str, budget: int) -> DataFrame:
    """``df`` with tokens, included and used: first fit in list order, passing over what does not fit and going on.

    A running sum would be wrong, because what is passed over takes no room. So
    each request's list, at most some hundreds of candidates, is folded in order.
    """
    if not 256 <= budget <= 32_768:
        raise ValueError("budget is 256 to 32768")
    sized = df.withColumn("tokens", tx.token_estimate(F.col(text)))
    listed = sized.groupBy(request).agg(F.sort_array(F.collect_list(F.struct(position, "tokens"))).alias("_list"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("CAST(array() AS array<struct<p: bigint, t: bigint, i: boolean, u: bigint>>)").alias("out"))

    def step(state, item):
        fits = state["used"] + item["tokens"] <= budget
        used = F.when(fits, state["used"] + item["tokens"]).otherwise(state["used"])
        row = F.struct(item[position].cast("long").alias("p"), item["tokens"].alias("t"), fits.alias("i"), used.alias("u"))
        return F.struct(used.alias("used"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = listed.select(request, F.explode(F.aggregate("_list", start, step)["out"]).alias("_r"))
    return folded.select(request, F.col("_r.p").alias(position), F.col("_r.t").alias("tokens"), F.col("_r.i").alias("included"), F.col("_r.u").alias("used"))


def joined_texts(parts: list[str]) -> str:
    """Texts of a group as one: the longest run of lines that ends one and begins the next is kept once; without one, a blank line parts them."""
    out: list[str] = []
    for i, part in enumerate(parts):
        lines = part.split("\n")
        shared = next((n for n in range(min(len(out), len(lines)), 0, -1) if out[-n:] == lines[:n]), 0)
        out += [""] * (i > 0 and not shared) + lines[shared:]
    return "\n".join(out)
