"""Fill-in-the-middle training texts: a document's units are cut in three, and the middle goes to the end.

A unit is a word with the white space before it; white space at the end is a unit of its own. Both cuts are ranks of
units. They are found in an indexable skip list over the units of the text: the entries of each lane carry how many
units and how many code points lie up to the lane's next entry, and a search descends by the widths it has passed, so
it knows the code point of a rank without walking over all units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, separators, text_bytes

#: One entry in so many of a lane stands in the lane above, too.
STEP = 16
#: Bytes of texts whose units are found together; a longer text is taken alone.
SLICE = 2 << 20
#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    """Seed of the cuts and forms; percentage of plain texts, and of suffix-first ones among the others."""

    seed: int = 42
    plain: int = 50
    suffix_first: int = 80


class SkipList:
    """Units of a text by rank. ``units`` and ``points`` of a lane: widths up to its next entry; ``below``: entry in the lane beneath."""

    def __init__(self, points: np.ndarray, seed: int = 0):
        units, at = np.ones(len(points), np.int64), np.arange(len(points))
        self.lanes = [(units, points, None)]
        while len(units) > STEP:
            # a tower grows by a coin of its unit; the head stands in every lane
            grown = mix((at + len(self.lanes) * 0x9E3779B1 + seed).astype(np.uint64)) % np.uint64(STEP) == 0
            grown[0] = True
            below = np.flatnonzero(grown)
            if len(below) == len(units):
                break
            units, points, at = np.add.reduceat(units, below), np.add.reduceat(points, below), at[below]
            self.lanes.append((units, points, below))

    def code_points(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        passed, found, entry = 0, 0, 0
        for units, points, below in reversed(self.lanes):
            while passed < rank and passed + units[entry] <= rank:
                passed += int(units[entry])
                found += int(points[entry])
                entry += 1
            if passed == rank:
                return found
            if below is not None:
                entry = int(below[entry])
        return found


def unit_widths(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each unit of several texts, and the first unit of each text."""
    words = Words(raw, offsets, separators())
    last = np.zeros(len(offsets) - 1, np.int64)  # where each text's last word ends
    some = words.counts() > 0
    last[some] = words.end[words.of[1:][some] - 1]
    last[~some] = offsets[:-1][~some]
    tail = last < offsets[1:]
    number = words.counts() + tail
    first = np.concatenate([[0], np.cumsum(number)])
    begins = np.zeros(first[-1], np.int64)
    # a unit begins where the one before ends: at the end of the word before, or at the text's begin
    ends = np.zeros(first[-1], np.int64)
    place = np.arange(len(words.end)) + np.repeat(first[:-1] - words.of[:-1], words.counts())
    ends[place] = words.end
    ends[first[1:][tail] - 1] = offsets[1:][tail]
    begins[1:] = ends[:-1]
    begins[first[:-1][number > 0]] = offsets[:-1][number > 0]
    leads = ((raw & 0xC0) != 0x80).astype(np.int32)
    return np.add.reduceat(leads, begins).astype(np.int64) if len(begins) else begins, first


def cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Units of each text, code points of its prefix and of its middle, by two random numbers."""
    raw, offsets = text_bytes(text)
    one, other = one.to_pylist(), other.to_pylist()
    out = np.zeros((len(text), 3), np.int64)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        points, first = unit_widths(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for k in range(lo, hi):
            own = points[first[k - lo] : first[k - lo + 1]]
            n = len(own)
            begin, end = sorted((one[k] % (n + 1), other[k] % (n + 1)))
            if n:
                units = SkipList(own)
                prefix = units.code_points(begin)
                out[k] = n, prefix, units.code_points(end) - prefix
        lo = hi
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], ["n", "prefix", "middle"])


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of docs.

    ``n`` counts the units. Form is ``plain`` (output is the text; both widths null), ``psm`` (prefix, suffix, middle)
    or ``spm`` (suffix, prefix, middle), each part behind its marker. A text that is empty, null or holds a marker is
    plain. Cuts and form follow from the seed and the id alone: repeated rows give equal rows, rows of one id and other
    texts share their random numbers; a null id counts as an empty one. Of two equal cuts the middle is empty. A text of
    any length is worked on whole, in one task, with some 40 bytes per unit. Other columns are not read. An empty table
    gives none. No shuffle.
    """
    doc_id, text = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    number = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), digest.alias("digest"))
    rows = rows.withColumn("cut", F.arrow_udf(cuts, "struct<n: long, prefix: long, middle: long>")("text", number[0], number[1]))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (number[2] % 100 >= settings.plain)
    form = F.when(plain, "plain").when(number[3] % 100 < settings.suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.prefix").cast("int").alias("begin"), F.col("cut.middle").cast("int").alias("inside"))
    part = {
        PREFIX: F.substring("text", 1, F.col("begin")), MIDDLE: F.substring("text", F.col("begin") + 1, F.col("inside")),
        SUFFIX: F.substring("text", F.col("begin") + F.col("inside") + 1, F.length("text")),
    }
    joined = {f: F.concat(*[x for m in order for x in (F.lit(m), part[m])]) for f, order in (("psm", (PREFIX, SUFFIX, MIDDLE)), ("spm", (SUFFIX, PREFIX, MIDDLE)))}
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", joined["psm"]).otherwise(joined["spm"])
    shown = [F.when(F.col("form") != "plain", F.col(c).cast("long")).alias(name) for c, name in (("begin", "prefix_chars"), ("inside", "middle_chars"))]
    return rows.select("doc_id", "n", "form", *shown, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts between the markers, prefix, middle and suffix.

    A marker's first character stands nowhere else in it, so parts and markers cannot form another marker together.
    """
    middle = F.instr(output, MIDDLE)
    last = F.substring(output, middle + 3, F.length(output))

    def parts(second: str) -> tuple[Column, Column]:
        at = F.instr(output, second)
        return F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, middle - at - 3)

    (prefix, suffix), (suffix_, prefix_) = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, last, suffix)).otherwise(F.concat(prefix_, last, suffix_))
