"""Fill-in-the-middle by a lazy matcher.

A text is cut between units, which a pattern matches from left to right. The
first pass counts the matches; the second goes along them once more, to the
lower of two drawn ranks and on to the upper. Of either pass only the match at
hand is kept, so memory beside the text does not grow with its units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import fresh, slices, without

CODE_POINT = r"(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first groups of sha256 of ``seed:key``; a null key is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def count_units(unit: re.Pattern, text: str) -> int:
    """The first pass: how many matches there are."""
    return sum(1 for _ in unit.finditer(text))


def ends_at(unit: re.Pattern, text: str, lower: int, upper: int) -> tuple[int, int]:
    """The second pass: where the match of rank ``lower`` ends, and that of rank ``upper``; rank 0 ends at 0."""
    matches = unit.finditer(text)
    first = next(islice(matches, lower - 1, None)).end() if lower else 0
    if upper == lower:
        return first, first
    return first, next(islice(matches, upper - lower - 1, None)).end()


def rearranged(text: str, unit: re.Pattern, n: int, drawn: list[int], fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[str, int | None, int | None, str]:
    """form, code points of the prefix and of the middle, and the output."""
    before, after, between = sentinels
    if not text or drawn[2] % 100 >= fim_percent or any(s in text for s in sentinels):
        return "plain", None, None, text
    a, b = ends_at(unit, text, *sorted(d % (n + 1) for d in drawn[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < spm_percent:
        return "spm", a, b - a, f"{after}{suffix}{before}{prefix}{between}{middle}"
    return "psm", a, b - a, f"{before}{prefix}{after}{suffix}{between}{middle}"


def _checked(sentinels: tuple[str, str, str]) -> None:
    # an end of one that begins another could join a text into a sentinel of its own
    whole = len(set(sentinels)) == 3 and all(sentinels)
    if not whole or any((s != t and s in t) or any(s.endswith(t[:i]) for i in range(1, len(t))) for s in sentinels for t in sentinels):
        raise ValueError("sentinels must be three texts of which none ends as another begins")


def fill_middle(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, fim_percent: int = 90, spm_percent: int = 20, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` with n (units), form, prefix_chars, middle_chars and output of each whole text.

    The draws h1 to h4 depend on the key alone (see ``draws``). The prefix ends
    after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after
    the larger; what lies between units goes with the unit after it, what
    follows the last with the suffix. Form is plain, and the output the text, if
    the text is null or empty, holds a sentinel, or h3 % 100 >= fim_percent;
    else spm (suffix, prefix, middle) if h4 % 100 < spm_percent, else psm.

    A null text counts as empty; a text without units has n = 0 and is all
    suffix; equal keys draw alike and repeated rows each get their own; an empty
    table stays empty; columns with the names of the new ones, in any case, are
    replaced. Texts of any length are cut whole; a task holds a few MB of texts or
    one text. There is no shuffle.
    """
    _checked(sentinels)
    matcher = re.compile(unit)
    kept = without(df, "n", "form", "prefix_chars", "middle_chars", "output")
    columns, drawn = kept.columns, fresh(kept.columns, "drawn")[0]
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    schema = T.StructType([*kept.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts = [count_units(matcher, t) for t in texts]
            made = [rearranged(t, matcher, n, d, fim_percent, spm_percent, sentinels) for t, n, d in zip(texts, counts, batch.column(drawn).to_pylist(), strict=True)]
            form, prefix, middle, output = ([m[i] for m in made] for i in range(4))
            arrays = [pa.array(counts, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *arrays], names=schema.names)

    return kept.withColumn(drawn, F.array(*draws(kept[f"`{key}`"], seed))).mapInArrow(run, schema)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from form and output alone."""
    before, after, between = (F.lit(s) for s in sentinels)

    def part(begins: Column, ends: Column) -> Column:
        return F.split_part(F.split_part(output, begins, F.lit(2)), ends, F.lit(1))

    middle = F.split_part(output, between, F.lit(2))
    psm = F.concat(part(before, after), middle, part(after, between))
    spm = F.concat(part(before, between), middle, part(after, before))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
