"""Document units: lines, sheet rows, tables, sections, shapes, images and locators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    normalize_inline_text,
    normalize_noisy_text,
    normalize_text,
    rstrip,
    strip,
    unify_newlines,
)
from corpusloom.operators.ordered import BLOCK_ROWS, ordered_fold, running_sums


def _starts(lengths: pa.Array) -> pa.Array:
    """Start offset of every line, given the line lengths of each document."""
    counts = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
    flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat + 1)])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    starts = total[:-1] - np.repeat(total[offsets[:-1]], counts)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts, pa.int64()))


def text_to_line_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, trailing empty line included, with character ranges.

    A document is one row, so its lines never leave the task: only line lengths cross
    into Python, and no shuffle is needed.
    """
    lines = F.split(unify_newlines(F.col(text)), "\n")
    df = docs.select(key, lines.alias("_lines"))
    df = df.withColumn(
        "_starts",
        F.arrow_udf(_starts, "array<bigint>")(F.transform("_lines", lambda x: F.length(x))),
    )
    df = df.select(key, F.size("_lines").alias("_n"), F.posexplode(F.arrays_zip("_lines", "_starts")).alias("_pos", "_z"))
    raw, start = F.col("_z._lines"), F.col("_z._starts")
    end = start + F.length(raw)
    has_break = F.col("_pos") < F.col("_n") - 1
    trimmed = rstrip(raw)
    return df.select(
        key,
        F.col("_pos").alias("unit_index"),
        (F.col("_pos") + 1).alias("line_number"),
        trimmed.alias("text"),
        start.alias("source_char_start"),
        end.alias("source_char_end"),
        (start + F.length(trimmed)).alias("text_char_end"),
        end.alias("line_break_start"),
        (end + has_break.cast("int")).alias("line_break_end"),
        has_break.alias("has_line_break"),
    )


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a 1-based column number (up to three letters)."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def letter(i: Column) -> Column:
        return F.substring(alphabet, (i % 26 + 1).cast("int"), F.lit(1))

    zero = n.cast("int") - 1
    tens = F.floor(zero / 26).cast("int") - 1
    hundreds = F.floor(tens / 26).cast("int") - 1
    return (
        F.when(zero < 26, letter(zero))
        .when(tens < 26, F.concat(letter(tens), letter(zero)))
        .otherwise(F.concat(letter(hundreds), letter(tens), letter(zero)))
    )


def cells_to_row_units(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """Sparse cells to tab-joined rows from the first to the last used column.

    Formula cells show their cached value when there is one, else the formula text.
    ``cells`` has the sheet columns and row, col, value, cached, is_formula; a cell with
    neither value is unused. A row holds at most one cell per column, which bounds the
    collected list by the sheet width.
    """
    used = cells.where(F.col("value").isNotNull() | F.col("cached").isNotNull())
    shown = F.when(F.col("is_formula"), F.coalesce("cached", "value")).otherwise(F.col("value"))
    ref = F.concat(column_letters(F.col("col")), F.col("row").cast("string"))
    rows = used.groupBy(*sheet, "row").agg(
        F.map_from_entries(
            F.collect_list(F.struct("col", F.coalesce(shown, F.lit("")).alias("v")))
        ).alias("m"),
        F.array_sort(F.collect_list(F.struct("col", ref.alias("ref")))).alias("refs"),
        F.min("col").alias("start_column"),
        F.max("col").alias("end_column"),
        F.count("*").alias("cell_count"),
        F.array_sort(
            F.collect_list(F.when(F.col("is_formula"), F.struct("col", ref.alias("ref"))))
        ).alias("formulas"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("is_formula") & F.col("cached").isNull(),
                    F.struct("col", ref.alias("ref")),
                )
            )
        ).alias("missing"),
    )
    values = F.transform(
        F.sequence("start_column", "end_column"),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")),
    )
    first = F.concat(column_letters(F.col("start_column")), F.col("row").cast("string"))
    last = F.concat(column_letters(F.col("end_column")), F.col("row").cast("string"))
    return rows.select(
        *sheet,
        "row",
        normalize_text(rstrip(F.array_join(values, "\t"))).alias("text"),
        F.concat(first, F.lit(":"), last).alias("cell_range"),
        F.col("refs.ref").alias("cell_coordinates"),
        "start_column",
        "end_column",
        "cell_count",
        (F.col("end_column") - F.col("start_column") + 1).alias("column_span"),
        F.col("formulas.ref").alias("formula_cells"),
        F.col("missing.ref").alias("formula_result_missing_cells"),
    )


def range_to_row_index(ranges: DataFrame, sheet: list[str], name: str = "name") -> DataFrame:
    """Named row ranges inverted to the ordered names that cover each row."""
    rows = ranges.select(
        *sheet, F.col(name), "ordinal", F.explode(F.sequence("min_row", "max_row")).alias("row")
    )
    names = F.array_sort(F.collect_list(F.struct("ordinal", name)))
    return rows.groupBy(*sheet, "row").agg(names.getField(name).alias("names"))


def value_to_text(value: Column, data_type: str, timespec: str = "auto") -> Column:
    """Cell value as text: ISO dates, TRUE/FALSE, empty for null.

    ``timespec`` is that of Python's ``isoformat``: by default a whole second has no fraction, with
    ``microseconds`` it has six zeros.
    """
    if data_type == "boolean":
        text = F.when(value, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif data_type.startswith("timestamp"):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        exact = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        text = exact if timespec == "microseconds" else F.when(F.endswith(exact, F.lit(".000000")), whole).otherwise(exact)
    elif data_type == "date":
        text = F.date_format(value, "yyyy-MM-dd")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def table_rows_to_text(cells: DataFrame, table: list[str]) -> DataFrame:
    """Table cells to text: cells joined by tabs, rows by line feeds.

    A table is part of one uploaded file, whose size limit bounds the collected rows.
    """
    rows = cells.groupBy(*table, "row").agg(
        F.array_sort(
            F.collect_list(F.struct("col", normalize_inline_text(F.col("value")).alias("v")))
        ).alias("c")
    )
    line = rstrip(F.array_join(F.col("c.v"), "\t"))
    tables = rows.groupBy(*table).agg(
        F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("r"),
        F.count("*").alias("row_count"),
        F.max(F.size("c")).alias("column_count"),
    )
    return tables.select(
        *table,
        normalize_text(F.array_join(F.col("r.line"), "\n")).alias("text"),
        "row_count",
        "column_count",
    )


def section_number(blocks: DataFrame, doc: str, order: str, ends_section: str) -> DataFrame:
    """Section of each block; it grows after the block that carries the break."""
    n = F.col(ends_section).cast("int")
    out = running_sums(blocks, [doc], order, {"section_index": n})
    return out.withColumn("section_index", (F.col("section_index") + 1).cast("long"))


def carry_heading(units: DataFrame, doc: str, order: str) -> DataFrame:
    """Latest heading of the current section, with its level, on every unit.

    Expects unit_type, text, heading_level and section_index. A section change, or a
    missing section, starts over.
    """
    keys = [doc, "_block"]
    section = F.when(F.col("section_index") >= 1, F.col("section_index"))
    rows = units.withColumn("_section", section).withColumn("_block", F.floor(F.col(order) / BLOCK_ROWS).cast("long"))
    inside = Window.partitionBy(*keys).orderBy(order)
    title = strip(F.col("text"))
    level = F.when(F.col("heading_level") >= 1, F.col("heading_level")).cast("int")
    nothing = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("level"))
    heading = F.when((F.col("unit_type") == "heading") & (title != ""), F.struct(title.alias("title"), level.alias("level")))

    def mark(df: DataFrame, first_changed: Column) -> DataFrame:
        """Event of each row: its heading, or a reset where the section changes."""
        is_first = F.row_number().over(inside) == 1
        differs = ~F.col("_section").eqNullSafe(F.lag("_section").over(inside))
        changed = F.when(is_first, first_changed).otherwise(differs)
        return df.withColumn("_event", F.coalesce(heading, F.when(changed, nothing)))

    # Per block: its first and last section and its last event, leaving open whether its
    # first row changes the section; that depends on the block before.
    marked = mark(rows, F.lit(False))
    blocks = marked.groupBy(*keys).agg(
        F.min_by(F.struct("_section"), order).alias("_head"),
        F.max_by(F.struct("_section"), order).alias("_tail"),
        F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col(order))).alias("_last"),
    )
    by_block = Window.partitionBy(doc).orderBy("_block")
    blocks = blocks.withColumn("_enters", ~F.col("_head").eqNullSafe(F.lag("_tail").over(by_block)))
    blocks = blocks.withColumn("_last", F.coalesce("_last", F.when(F.col("_enters"), nothing)))
    carried = F.last("_last", True).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_enters", carried.alias("_carry"))
    full = mark(rows.join(blocks, keys), F.col("_enters"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("_h", F.coalesce(F.last("_event", True).over(upto), F.col("_carry")))
    return full.select(
        *units.columns, F.col("_h.title").alias("section_title"), F.col("_h.level").alias("section_heading_level")
    )


def _positive(c: Column) -> Column:
    return F.when(c >= 1, c)


def structure_path(file_type: Column, unit_index: Column, m: Column) -> Column:
    """Place of a unit inside its document, from its typed metadata struct."""
    position = (unit_index + 1).cast("string")

    def num(name: str, default: Column) -> Column:
        return F.coalesce(_positive(m[name]).cast("string"), default)

    def txt(name: str) -> Column:
        s = strip(m[name])
        return F.when(s != "", s)

    page = _positive(m["page_number"])
    slide = F.concat(F.lit("slide:"), num("slide_number", F.lit("1")))
    return (
        F.when(
            file_type == "pdf",
            F.when(page.isNotNull(), F.concat(F.lit("page:"), page.cast("string"))).otherwise(
                F.concat(F.lit("page-unit:"), position)
            ),
        )
        .when(
            file_type == "docx",
            F.concat(
                F.lit("section:"), num("section_index", F.lit("1")),
                F.lit("/block:"), num("block_index", position),
            ),
        )
        .when(
            file_type == "pptx",
            F.when(txt("shape_path").isNotNull(), F.concat(slide, F.lit("/shape:"), txt("shape_path"))).otherwise(
                F.concat(slide, F.lit("/"), F.coalesce(txt("unit_type"), F.lit("unit")), F.lit(":"), position)
            ),
        )
        .when(
            file_type == "xlsx",
            F.concat(
                F.lit("sheet:"), F.coalesce(txt("sheet_name"), F.lit("unknown")),
                F.lit("/range:"), F.coalesce(txt("cell_range"), F.concat(F.lit("unit-"), position)),
            ),
        )
        .when(file_type == "txt", F.concat(F.lit("line:"), num("line_number", position)))
    )


def location_kind(file_type: Column, declared: Column) -> Column:
    """Kind of place a unit lies in; slides keep a declared kind."""
    kind = strip(declared)
    return (
        F.when(file_type == "pdf", F.lit("pdf_page"))
        .when(file_type == "docx", F.lit("docx_block"))
        .when(file_type == "pptx", F.coalesce(F.when(kind != "", kind), F.lit("pptx_slide_unit")))
        .when(file_type == "xlsx", F.lit("xlsx_cell_range"))
        .when(file_type == "txt", F.lit("txt_line"))
    )


def shape_geometry(
    left: Column, top: Column, width: Column, height: Column, slide_width: Column, slide_height: Column
) -> Column:
    """Edges of a shape and its ratios to the slide; ratios are 0 without a slide size."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 8)).otherwise(F.lit(0.0))

    return F.struct(
        (left + width).alias("right"),
        (top + height).alias("bottom"),
        ratio(left, slide_width).alias("left_ratio"),
        ratio(top, slide_height).alias("top_ratio"),
        ratio(width, slide_width).alias("width_ratio"),
        ratio(height, slide_height).alias("height_ratio"),
    )


def merge_located_units(
    base: DataFrame, extra: DataFrame, doc: str, anchor: str = "anchor"
) -> DataFrame:
    """Insert extra units after the last base unit with the same anchor.

    Both sides carry doc, anchor, ordinal and text. Extras without a matching anchor come
    at the end: first those whose anchor matched nothing, in order of the anchor's first
    extra, then those without one. The result gets a new ``unit_index``.
    """
    last = base.where(F.col(anchor).isNotNull()).groupBy(doc, anchor).agg(F.max("ordinal").alias("_at"))
    first = extra.where(F.col(anchor).isNotNull()).groupBy(doc, anchor).agg(F.min("ordinal").alias("_first"))
    placed = extra.join(last, [doc, anchor], "left").join(first, [doc, anchor], "left")
    big = F.lit(2**62)
    rank = F.when(F.col("_at").isNotNull(), F.struct(
        F.col("_at").cast("long").alias("a"), F.lit(1).alias("b"), F.col("ordinal").cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    ).when(F.col(anchor).isNotNull(), F.struct(
        big.alias("a"), F.lit(0).alias("b"), F.col("_first").cast("long").alias("c"), F.col("ordinal").cast("long").alias("d"))
    ).otherwise(F.struct(
        big.alias("a"), F.lit(1).alias("b"), F.col("ordinal").cast("long").alias("c"), F.lit(0).cast("long").alias("d")))
    left = base.select(
        doc, anchor, "text", F.lit(False).alias("is_extra"),
        F.struct(F.col("ordinal").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d")).alias("_rank"),
    )
    right = placed.select(doc, anchor, "text", F.lit(True).alias("is_extra"), rank.alias("_rank"))
    both = left.unionByName(right)
    # The block is the first rank field, so a huge document spreads over many blocks.
    block = F.when(F.col("_rank.a") == big, F.lit(2**62)).otherwise(F.floor(F.col("_rank.a") / BLOCK_ROWS))
    out = running_sums(both, [doc], "_rank", {"unit_index": F.lit(1)}, block=block)
    return out.withColumn("unit_index", F.col("unit_index").cast("long")).drop("_rank")


def recognised_lines_to_text(
    lines: DataFrame, image: list[str], min_confidence: float = 0.35, max_chars: int = 10_000
) -> DataFrame:
    """Accepted lines of each image in order, with their mean confidence."""
    kept = lines.where(F.col("confidence") >= min_confidence)
    texts = kept.groupBy(*image).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("l"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count("*").alias("line_count"),
    )
    text = normalize_noisy_text(F.array_join(F.col("l.text"), "\n"), max_chars)
    repaired = texts.select(*image, text.alias("_text"), "mean_confidence", "line_count")
    # A filter would move below the repair and repeat it; an explode stays.
    text = F.explode(F.filter(F.array("_text"), lambda x: x != "")).alias("text")
    return repaired.select(*image, text, "mean_confidence", "line_count")


def context_text(parts: list[Column], max_chars: int) -> Column:
    """Distinct non-empty context parts, one per line, capped."""
    if max_chars <= 0:
        return F.lit("")
    cleaned = F.array(*[normalize_noisy_text(p, max_chars) for p in parts])
    kept = F.array_distinct(F.filter(cleaned, lambda x: x != ""))
    return rstrip(F.left(F.array_join(kept, "\n"), F.lit(max_chars)))


def budget_select(
    items: DataFrame, keys: list[str], order: list[str], size: str, max_count: int, max_total: int
) -> DataFrame:
    """Greedy choice in order: an item over the remaining budget is skipped, later ones may fit.

    Items that could never fit are decided before the shuffle, so only undecided rows
    travel. Adds ``selected``. Items without a size, or with a negative one, are never chosen;
    a null key is a group of its own.
    """
    fits = (F.col(size) >= 0) & (F.col(size) <= max_total)
    never = items.where(~F.coalesce(fits, F.lit(False))).withColumn("selected", F.lit(False))

    def step(state, values):
        count, total = state
        (n,) = values
        if count < max_count and total + n <= max_total:
            return (count + 1, total + n), True
        return state, False

    folded = ordered_fold(
        items.where(F.coalesce(fits, F.lit(False))), keys, order, lambda: (0, 0), step, [size], "selected", "boolean"
    )
    return folded.unionByName(never)


def image_only_anchors(locations: DataFrame, text_units: DataFrame, location: list[str]) -> DataFrame:
    """Distinct locations that no text unit covers, as empty units."""
    bare = locations.select(*location).dropDuplicates().join(
        text_units.select(*location).dropDuplicates(), location, "left_anti"
    )
    return bare.withColumn("text", F.lit("")).withColumn("unit_type", F.lit("image_only_anchor"))


# Image limits.
IMAGE_LIMITS = {
    "max_bytes": 25 * 1024 * 1024,
    "max_pixels": 40_000_000,
    "min_bytes": 1_024,
    "min_width": 64,
    "min_height": 32,
    "min_area": 4_096,
    "max_aspect": 12.0,
    "max_count": 300,
    "max_total_bytes": 256 * 1024 * 1024,
}


def is_usable_image(n_bytes: Column, width: Column, height: Column, limits: dict = IMAGE_LIMITS) -> Column:
    """Not empty, not oversize, not decorative; unknown dimensions pass the pixel tests."""
    area = width.cast("long") * height
    known = width.isNotNull() & height.isNotNull()
    decorative = (
        (width < limits["min_width"])
        | (height < limits["min_height"])
        | (area < limits["min_area"])
        | (F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1)) > limits["max_aspect"])
    )
    sized = (width > 0) & (height > 0) & (area <= limits["max_pixels"]) & ~decorative
    return (
        (n_bytes > 0)
        & (n_bytes <= limits["max_bytes"])
        & (n_bytes >= limits["min_bytes"])
        & F.when(known, sized).otherwise(F.lit(True))
    )


def filter_image_candidates(
    images: DataFrame, doc: str, order: str, limits: dict = IMAGE_LIMITS
) -> DataFrame:
    """Images kept per document, in order, under count and byte budgets.

    Expects n_bytes, width, height and sha256. Equal hashes have equal sizes, so once a
    copy has been refused for space a later copy is refused too: keeping the first copy
    per hash before the budget walk gives the same choice as testing accepted ones.
    """
    usable = images.where(is_usable_image(F.col("n_bytes"), F.col("width"), F.col("height"), limits))
    first = usable.groupBy(doc, "sha256").agg(
        F.min_by(F.struct(*[c for c in images.columns if c not in (doc, "sha256")]), order).alias("i")
    )
    first = first.select(doc, "sha256", "i.*").select(*images.columns)
    chosen = budget_select(first, [doc], [order], "n_bytes", limits["max_count"], limits["max_total_bytes"])
    return chosen.where("selected").drop("selected")


def scan_page_flag(
    pages: DataFrame, images: DataFrame, page: list[str], max_text: int = 24, min_coverage: float = 0.60
) -> DataFrame:
    """Pages whose content is an image or an outline rather than text.

    ``pages`` has the page columns, compact_text_length and has_vector; ``images`` has one
    row per image with its coverage.
    """
    cover = images.groupBy(*page).agg(
        F.count("*").alias("image_count"),
        F.round(F.least(F.sum("coverage"), F.lit(1.0)), 9).alias("coverage"),
    )
    df = pages.join(cover, page, "left").fillna(0, ["image_count", "coverage"])
    n, length = F.col("image_count"), F.col("compact_text_length")
    flag = (
        F.when(length > max_text, F.lit(False))
        .when((n == 0) & ~F.col("has_vector"), F.lit(False))
        .when(n == 0, length == 0)
        .when(length == 0, F.lit(True))
        .otherwise(F.col("coverage") >= min_coverage)
    )
    return df.select(*page, "image_count", "coverage", flag.alias("is_scan"))

