"""Splitting and merging pieces of documents: tables by rows, text by sentences, short pieces under one heading."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import packed
from .segments import with_previous, with_running_sums

_FIGURES = r"^[-+()$%.,\d\s]+$"


def cells_of(line: Column) -> Column:
    """The cells of a Markdown row without the blanks around them."""
    inner = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), F.trim)


def is_section_row(line: Column) -> Column:
    """A row that labels the rows below it: one text, no figure, in every one of its cells."""
    cells = cells_of(line)
    first = F.element_at(cells, 1)
    return (F.size(cells) > 1) & (first != "") & (F.size(F.array_distinct(cells)) == 1) & ~first.rlike(_FIGURES)


def empty_grid(grid: Column) -> Column:
    """Whether a table, an array of rows, has no cell or only blank ones."""
    return ~F.coalesce(F.exists(F.flatten(grid), lambda c: F.trim(c) != ""), F.lit(False))


def sentence_parts(text: Column, limit: int) -> Column:
    """Sentences packed into parts of at most ``limit`` characters; a longer sentence is cut at the limit."""
    sentences = F.split(text, r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])""")
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.char_length(s), F.lit(1)) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))))
    return packed(F.filter(cut, lambda s: s != ""), limit)


def table_parts(text: str, limit: int) -> list[tuple[str, bool]]:
    """(part, goes on) of a Markdown table split by rows so that each part keeps to ``limit`` where its rows allow.

    Every part repeats the lines above the rows: caption, header and separator. A part that goes on
    with a section repeats the section's row as well.
    """
    lines = text.splitlines()
    top = next((i for i, x in enumerate(lines) if x.startswith("|")), 0) + 1
    if len(lines) > top + 1 and set(lines[top]) <= set("|-: "):
        top += 1
    head, size = lines[:top], len("\n".join(lines[:top]))
    parts, rows, section, used, goes_on = [], [], None, size, False
    for line in lines[top:]:
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        labels = len(cells) > 1 and cells[0] != "" and len(set(cells)) == 1 and not set(cells[0]) <= set("-+()$%.,0123456789 \t")
        if rows and used + len(line) + 1 > limit:
            parts.append(("\n".join([*head, *rows]), goes_on))
            goes_on = section is not None and not labels
            rows = [section] if goes_on else []
            used = size + sum(len(r) + 1 for r in rows)
        section = line if labels else section
        rows.append(line)
        used += len(line) + 1
    if rows or not parts:
        parts.append(("\n".join([*head, *rows]), goes_on))
    return parts


def split_tables(df: DataFrame, keep: Sequence[str], text: str, limit: int) -> DataFrame:
    """``keep``, part_no (from 1), part and goes_on of each Markdown table in ``text``; those within ``limit`` are one part, null ones none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [table_parts(t, limit) if len(t) > limit else [(t, False)] for t in batch.column("_text").to_pylist()]
            index = pa.array([k for k, parts in enumerate(found) for _ in parts], pa.int64())
            kept = batch.drop_columns(["_text"]).take(index)
            columns = [pa.array([i for parts in found for i in range(1, len(parts) + 1)], pa.int32()), pa.array([p for parts in found for p, _ in parts], pa.string()), pa.array([g for parts in found for _, g in parts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "part_no", "part", "goes_on"])

    rows = df.select(*keep, F.col(text).alias("_text")).where("_text IS NOT NULL")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(split, f"{kept}, part_no int, part string, goes_on boolean")


def split_chunks(df: DataFrame, keep: Sequence[str], text: str, element: str, limit: int) -> DataFrame:
    """``keep``, part_no (from 1) and part: pieces within ``limit`` as they are, tables and charts by rows, other text by sentences."""
    rows = df.where(F.col(text).isNotNull())
    tabular = F.coalesce(F.col(element).isin("table", "chart"), F.lit(False))
    by_rows = split_tables(rows.where(tabular), keep, text, limit).drop("goes_on")
    fits = F.char_length(text) <= limit
    parts = F.when(fits, F.array(text)).otherwise(sentence_parts(F.col(text), limit))
    by_text = rows.where(~tabular).select(*keep, F.posexplode(parts).alias("_n", "part")).select(*keep, (F.col("_n") + 1).alias("part_no"), "part")
    return by_rows.unionByName(by_text)


def merged_under_heading(df: DataFrame, group: str, order: Sequence[str], text: str, element: str, heading: str, limit: int) -> DataFrame:
    """Successive pieces of text under one heading, joined by a blank line for as long as they stay within ``limit``.

    Result: ``group``, run (a number that grows with the order), ``heading``, ``element``, part_no
    and part. A piece that isn't text, or stands under another heading, ends a run and is a run of
    its own; null headings are one heading. The runs of all groups are told by ordered scans, so a
    group of any size is spread; only the pieces of one heading come together.
    """
    given = df.where(F.col(text).isNotNull()).select(group, *order, F.col(text).alias("_t"), F.col(element).alias("_e"), F.col(heading).alias("_h"))
    seen = with_previous(given, [group], order, ["_e", "_h"])
    goes_on = F.col("_previous").isNotNull() & (F.col("_e") == "text") & (F.col("_previous._e") == "text") & F.col("_h").eqNullSafe(F.col("_previous._h"))
    numbered = with_running_sums(seen.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).drop("_previous"), [group], order, {"run": F.col("_new")})
    runs = numbered.groupBy(group, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "_t")))["_t"].alias("pieces"), F.first("_h").alias(heading), F.first("_e").alias(element))
    return runs.select(group, "run", heading, element, F.posexplode(packed(F.col("pieces"), limit, "\n\n")).alias("_n", "part")).select(group, F.col("run").cast("long").alias("run"), heading, element, (F.col("_n") + 1).alias("part_no"), "part")
