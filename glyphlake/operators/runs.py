"""Operators on the order of runs: segments, groups, orphans, offsets, lines, cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from glyphlake.functions import fonts
from glyphlake.functions.arrow import slices

LEADING_GLYPHS = "^[†‡ˆ‰]+$"
LEADING_GLYPHS_IN_FONT = "^[†‡ˆ‰w]+$"
TRAILING_GLYPHS = "^[©Š]+$"


def is_legacy_font(font: Column) -> Column:
    return F.coalesce(fonts.is_legacy(font), F.lit(False))


def islands(rows: DataFrame, starts: Column, partition: list[str], order: list[str], name: str = "island") -> DataFrame:
    """rows with the number of the stretch that each lies in; starts: whether a row begins one."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def joined_text(order: list[str], text: str = "text") -> Column:
    """The texts of a group, in their order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return F.array_join(F.transform(rows, lambda r: r["__text"]), "")


def font_segments(chars: DataFrame, by: str = "paragraph", position: str = "position") -> DataFrame:
    """(by, start, end, font, text): maximal stretches of characters (by, position, font, char) of one font."""
    w = Window.partitionBy(by).orderBy(position)
    starts = ~F.col("font").eqNullSafe(F.lag("font").over(w)) | F.lag(position).over(w).isNull()
    parts = islands(chars.withColumn("__starts", starts), F.col("__starts"), [by], [position])
    return parts.groupBy(by, "island").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.first("font").alias("font"), joined_text([position], "char").alias("text")).drop("island")


#: Rows of segments that go to the JVM in a batch.
_SEGMENTS = 100_000


def text_segments(texts: DataFrame, ranges: list[tuple[str, str | None]], key: str, text: str = "text", by: str = "paragraph") -> DataFrame:
    """font_segments() of texts (key, text) whose characters' fonts are known by ranges, a font for each from its first character (ASCII) to the next one's, in order.

    No row for each character, no shuffle: segments are cut out of the column's bytes.
    An empty text is a segment of the first font without a place, a null text has none.
    """
    fonts = pa.array([f for _, f in ranges], pa.string())
    kind = np.zeros(256, np.int8)
    for i, (first, _) in enumerate(ranges):
        kind[ord(first) if first else 0 :] = i
    names = [by, "start", "end", "font", "text"]
    schema = f"{by} {dict(texts.dtypes)[key]}, start int, end int, font string, text string"

    def segments(keys: pa.Array, column: pa.Array) -> pa.RecordBatch:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        data = column.buffers()[2] or pa.py_buffer(b"")
        plain = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        at = np.flatnonzero((plain & 0xC0) != 0x80)  # where characters begin
        first = np.searchsorted(at, offsets - offsets[0])  # characters before each text
        kinds = kind[plain[at]]
        begins = np.ones(len(at), bool)
        begins[1:] = kinds[1:] != kinds[:-1]
        begins[first[:-1][first[:-1] < len(at)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(at))[: len(start)]
        row = np.searchsorted(first, start, "right") - 1
        cut = np.append(at[start], len(plain)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(start), pa.py_buffer(cut), pa.py_buffer(plain))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array((start - first[row]).astype(np.int32)), pa.array((end - first[row]).astype(np.int32)), fonts.take(pa.array(kinds[start])), parts], names)

    def empty(keys: pa.Array) -> pa.RecordBatch:
        none, n = pa.nulls(len(keys), pa.int32()), len(keys)
        return pa.RecordBatch.from_arrays([keys, none, none, fonts.take(pa.array([0] * n, pa.int32())), pa.array([""] * n, pa.string())], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, column in slices(batch.column(0), batch.column(1)):
                found = segments(keys, column)
                for i in range(0, len(found), _SEGMENTS):
                    yield found.slice(i, _SEGMENTS)
            yield empty(batch.column(0).filter(pc.equal(pc.binary_length(batch.column(1)), 0)))

    return texts.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(cut, schema)


def group_runs(runs: DataFrame, partition: list[str], order: list[str], font: str = "font_name", text: str = "text") -> DataFrame:
    """runs with `group`, `group_text` and `leads`.

    Adjacent runs of the same legacy font are a group, any other run is its own. The
    group's text is converted as one, in the run that leads; the others are dropped then.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    starts = ~(is_legacy_font(F.col(font)) & (F.col(font) == F.lag(font).over(w)))
    grouped = islands(runs.withColumn("__starts", starts), F.col("__starts"), partition, order, "group").drop("__starts")
    g = Window.partitionBy(*partition, "group").orderBy(*order)
    texts = F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return grouped.withColumn("group_text", F.array_join(texts, "")).withColumn("leads", F.row_number().over(g) == 1)


def _fold(items: Column, orphan: str, forward: bool) -> Column:
    """items (legacy, text, at) in the fold's direction: an orphan's text goes to the next item, if both are of legacy fonts."""
    kind = "array<struct<legacy:boolean,text:string,at:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merges = last.isNotNull() & last["legacy"] & x["legacy"] & F.coalesce(last["text"].rlike(orphan), F.lit(False))
        text = F.concat(last["text"], x["text"]) if forward else F.concat(x["text"], last["text"])
        merged = F.struct(x["legacy"].alias("legacy"), text.alias("text"), x["at"].alias("at"))
        kept = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(merges, F.concat(kept, F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, F.array().cast(kind), step)


def merge_orphans(runs: DataFrame, partition: list[str], order: list[str], font: str = "font_name", text: str = "text") -> DataFrame:
    """(partition..., run_index, at, text): runs after orphaned signs went to their neighbours.

    A run that is only signs that belong before a letter goes to the next run; then
    one that is only signs that belong behind goes to the one before. Both must be of
    legacy fonts. `at` is the number that the run had, run_index its new one. A
    paragraph's runs are folded as an array.
    """
    number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    rows = runs.select(*partition, number.cast("long").alias("at"), is_legacy_font(F.col(font)).alias("legacy"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    arrays = rows.groupBy(*partition).agg(F.sort_array(F.collect_list(F.struct("at", "legacy", "text"))).alias("__runs"))
    items = F.transform(F.col("__runs"), lambda r: F.struct(r["legacy"].alias("legacy"), r["text"].alias("text"), r["at"].alias("at")))
    ahead = _fold(items, LEADING_GLYPHS_IN_FONT, True)
    back = F.reverse(_fold(F.reverse(ahead), TRAILING_GLYPHS, False))
    return arrays.select(*partition, F.posexplode(back).alias("run_index", "__run")).select(*partition, "run_index", F.col("__run.at").alias("at"), F.col("__run.text").alias("text"))


def running_offsets(window: WindowSpec, text: Column) -> Column:
    """Where each piece begins, from the lengths of those before it."""
    return F.coalesce(F.sum(F.char_length(text)).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, text): each line a run."""
    return texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "text"))


def words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, text): what stands between spaces and tabs, each a run."""
    parts = F.filter(F.split(text, "[ \t]"), lambda x: x != "")
    return texts.select(key, F.posexplode(parts).alias("word", "text"))


def rejoined(rows: DataFrame, key: str, order: str, text: str = "text", by: str = "\n") -> DataFrame:
    """(key, text): lines put together again."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda r: r["t"])
    return rows.groupBy(key).agg(F.array_join(parts, by).alias("text"))


def replace_spans(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """texts (key, text) with edits (key, start, end, new_text) written in; the spans are those of the old text, and don't overlap.

    Written from the last to the first, so that places before stay valid.
    """
    ordered = edits.groupBy(key).agg(F.reverse(F.sort_array(F.collect_list(F.struct("start", "end", "new_text")))).alias("__edits"))
    put = lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new_text"], F.substring(t, e["end"] + 1, F.char_length(t)))
    joined = texts.join(ordered, key, "left")
    return joined.select(key, F.when(F.col("__edits").isNull(), F.col("text")).otherwise(F.aggregate("__edits", F.col("text"), put)).alias("text"))


def cells(sheet: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    """(id, row, column, text): the text cells of a table that aren't empty; rows and columns are numbered from 1."""
    strings = [c for c in columns if dict(sheet.dtypes)[c] == "string"]
    rows = F.array(*[F.struct(F.lit(columns.index(c) + 1).alias("column"), F.col(c).alias("text")) for c in strings])
    flat = sheet.select(row, F.explode(rows).alias("cell")).select(row, "cell.column", "cell.text").filter("text is not null and text <> ''")
    return flat.select(F.concat(F.lit("sheets:R"), row, F.lit(":C"), "column").alias("id"), F.col(row).alias("row"), "column", "text")


def shape_runs(runs: DataFrame) -> DataFrame:
    """(id, text, font), ids with the first and the last character, of (slide, shape, seq, text, font): one line feed at the end of a run is left out, but counts for the places behind it."""
    w = Window.partitionBy("slide", "shape").orderBy("seq")
    start = running_offsets(w, F.col("text"))
    kept = F.regexp_replace("text", "\n\\z", "")
    placed = runs.withColumn("__start", start).withColumn("__kept", kept).filter("__kept <> ''")
    number = [F.col("slide"), F.lit(":SH"), F.col("shape"), F.lit(":C"), F.col("__start"), F.lit("-"), F.col("__start") + F.char_length("__kept") - 1]
    return placed.select(F.concat(F.lit("slides:S"), *[c.cast("string") for c in number]).alias("id"), F.col("__kept").alias("text"), "font")


def located(objects: DataFrame, places: DataFrame) -> DataFrame:
    """objects (object_id) with (slide, shape) of their first place (object_id, slide, shape), 0 and 0 where there is none."""
    first = places.groupBy("object_id").agg(F.min(F.struct("slide", "shape")).alias("__at"))
    return objects.join(first, "object_id", "left").select(objects["*"], F.coalesce("__at.slide", F.lit(0)).alias("slide"), F.coalesce("__at.shape", F.lit(0)).alias("shape"))
