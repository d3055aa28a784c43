"""Typed reads from open metadata, and source locators built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.chunks import reject_rows

# Location kinds.
LOCATOR_KINDS = (
    "document", "pdf_page", "docx_block", "pptx_slide", "pptx_shape", "xlsx_cell_range", "txt_line",
)

# Locator integer fields with the metadata keys they are read from, in
# order of preference, and the smallest valid value.
INT_FIELDS = {
    "section_index": (("section_index",), 0),
    "block_index": (("block_index",), 0),
    "paragraph_index": (("paragraph_index",), 0),
    "table_index": (("table_index",), 0),
    "heading_level": (("heading_level", "section_heading_level"), 1),
    "row_number": (("row_number",), 1),
    "column_number": (("column_number",), 1),
    "row_count": (("row_count",), 0),
    "column_count": (("column_count",), 0),
    "shape_index": (("shape_index",), 0),
    "shape_id": (("shape_id",), 0),
    "shape_left_emu": (("shape_left_emu",), 0),
    "shape_top_emu": (("shape_top_emu",), 0),
    "shape_width_emu": (("shape_width_emu",), 0),
    "shape_height_emu": (("shape_height_emu",), 0),
    "start_row": (("start_row",), 1),
    "end_row": (("end_row",), 1),
    "start_column": (("start_column",), 1),
    "end_column": (("end_column",), 1),
    "line_number": (("line_number",), 1),
    "line_start": (("line_start", "line_start_number", "line_number"), 1),
    "line_end": (("line_end", "line_end_number", "line_number"), 1),
    "char_start": (("chunk_source_char_start", "source_char_start", "text_char_start"), 0),
    "char_end": (("chunk_source_char_end", "source_char_end", "text_char_end"), 0),
    "image_ordinal": (("image_ordinal", "image_index", "page_image_index", "image_order"), 1),
}
# Locator text fields read under their own name.
TEXT_FIELDS = (
    "unit_type", "shape_path", "shape_name", "shape_type_name", "coordinate_space",
    "start_cell", "end_cell", "cell_range", "image_id", "image_kind", "ocr_engine",
)


def meta_fields(meta: Column, keys) -> Column:
    """The values of all ``keys`` as one struct of variants, in a single walk of the object."""
    names = ",".join(f"`{k}`:variant" for k in dict.fromkeys(keys))
    return F.try_variant_get(meta, "$", f"struct<{names}>")


def as_int(value: Column, minimum: int | Column) -> Column:
    """A JSON integer of at least ``minimum``; booleans, fractions and texts give null."""
    is_int = F.schema_of_variant(value) == "BIGINT"
    number = F.when(is_int, F.try_variant_get(value, "$", "bigint"))
    return F.when(number >= minimum, number)


def as_float(value: Column) -> Column:
    """A finite JSON number; booleans and texts give null."""
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT$|DOUBLE$|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    return F.when(F.abs(number) < float("inf"), number)


def as_string(value: Column) -> Column:
    """A JSON string as it is; other values give null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_text(value: Column, max_length: int | None = None) -> Column:
    """A non-blank JSON string, stripped."""
    text = F.nullif(strip(as_string(value)), F.lit(""))
    return text if max_length is None else F.left(text, F.lit(max_length))


def as_texts(value: Column) -> Column:
    """The non-blank strings of a JSON array; null when there are none."""
    values = F.try_variant_get(value, "$", "array<string>")
    kept = F.filter(F.transform(values, strip), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def first_int(fields: Column, keys: tuple[str, ...], minimum: int) -> Column:
    return F.coalesce(*[as_int(fields[k], minimum) for k in keys])


# Metadata keys a locator reads besides INT_FIELDS and TEXT_FIELDS.
_OTHER_KEYS = (
    "page_number", "page", "slide_number", "slide_no", "sheet_number", "sheet_index", "sheet_name",
    "section_title", "content_origin", "ocr_mean_confidence", "cell_coordinates",
    "merged_cell_ranges", "merged_ranges", "location_kind", "structure_path",
)


def build_source_locator(
    df: DataFrame,
    file_type: Column,
    meta: Column,
    page: Column | None = None,
    slide_no: Column | None = None,
    sheet_name: Column | None = None,
    section_title: Column | None = None,
    out: str = "locator",
) -> DataFrame:
    """Add one sparse struct that says where a chunk lies in its document.

    Metadata wins; the legacy columns fill the gaps.
    """
    none_int, none_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    lows = {k: low for keys, low in INT_FIELDS.values() for k in keys}
    lows |= {"page_number": 1, "page": 1, "slide_number": 1, "slide_no": 1, "sheet_number": 1, "sheet_index": 0}
    text_keys = [*TEXT_FIELDS, "sheet_name", "section_title", "content_origin", "location_kind", "structure_path"]
    given = df.columns
    df = df.withColumn("_i", meta_fields(meta, [*lows, *TEXT_FIELDS, *_OTHER_KEYS]))
    m = F.col("_i")
    # Each value is read once into a column; fields of a struct would be put back, with their reads, into all that uses them.
    # The texts are one array: a lambda keeps this step out of the one long generated method that the JVM would not compile.
    df = df.withColumns(
        {f"_n_{k}": F.when(F.schema_of_variant(m[k]) == "BIGINT", F.try_variant_get(m[k], "$", "bigint")) for k in lows}
        | {"_s": F.transform(F.array(*[as_string(m[k]) for k in text_keys]), strip), "_file_type": F.lower(strip(file_type))}
    )

    def number(*keys: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"_n_{k}") >= lows[k], F.col(f"_n_{k}")) for k in keys])

    def words(key: str) -> Column:
        return F.nullif(F.get("_s", F.lit(text_keys.index(key))), F.lit(""))

    f = {name: number(*keys) for name, (keys, _) in INT_FIELDS.items()}
    f |= {name: words(name) for name in TEXT_FIELDS}
    f["file_type"] = F.col("_file_type")
    f["page"] = F.coalesce(number("page_number", "page"), none_int if page is None else page)
    f["slide_no"] = F.coalesce(number("slide_number", "slide_no"), none_int if slide_no is None else slide_no)
    f["sheet_name"] = F.coalesce(words("sheet_name"), none_text if sheet_name is None else sheet_name)
    f["section_title"] = F.coalesce(words("section_title"), none_text if section_title is None else section_title)
    f["sheet_number"] = F.coalesce(number("sheet_number"), number("sheet_index") + 1)
    ocr = (words("content_origin") == "ocr") | (f["unit_type"] == "ocr_image")
    f["content_origin"] = F.when(ocr, F.lit("ocr")).otherwise(F.lit("text"))
    f["ocr_mean_confidence"] = as_float(m["ocr_mean_confidence"])
    f["cell_coordinates"] = as_texts(m["cell_coordinates"])
    f["merged_cell_ranges"] = F.coalesce(as_texts(m["merged_cell_ranges"]), as_texts(m["merged_ranges"]))
    f["image_index"] = f["image_ordinal"]

    fields = df.withColumns({f"_l_{n}": c for n, c in f.items()})
    loc = {n: F.col(f"_l_{n}") for n in f}
    declared = words("location_kind")
    kind = F.coalesce(
        F.when(declared.isin(*LOCATOR_KINDS), declared),
        F.when(loc["file_type"] == "pdf", F.lit("pdf_page"))
        .when(loc["file_type"] == "docx", F.lit("docx_block"))
        .when((loc["file_type"] == "pptx") & loc["shape_path"].isNotNull(), F.lit("pptx_shape"))
        .when(loc["file_type"] == "pptx", F.lit("pptx_slide"))
        .when(loc["file_type"] == "xlsx", F.lit("xlsx_cell_range"))
        .when(loc["file_type"] == "txt", F.lit("txt_line"))
        .otherwise(F.lit("document")),
    )

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value.cast("string"))

    docx = F.concat_ws("/", part("section:", loc["section_index"]), part("block:", loc["block_index"]))
    lines = F.when(
        loc["line_end"] != loc["line_start"],
        F.concat(part("line:", loc["line_start"]), part("-", loc["line_end"])),
    ).otherwise(part("line:", loc["line_start"]))
    fallback = (
        F.when(loc["file_type"] == "pdf", part("page:", loc["page"]))
        .when(loc["file_type"] == "docx", F.when(docx != "", docx))
        .when(
            loc["file_type"] == "pptx",
            F.concat(part("slide:", loc["slide_no"]), F.coalesce(part("/shape:", loc["shape_path"]), F.lit(""))),
        )
        .when(
            loc["file_type"] == "xlsx",
            F.concat(part("sheet:", loc["sheet_name"]), F.coalesce(part("/range:", loc["cell_range"]), F.lit(""))),
        )
        .when(loc["file_type"] == "txt", lines)
    )
    path = F.coalesce(words("structure_path"), fallback)
    full = F.struct(*[c.alias(n) for n, c in loc.items()], kind.alias("kind"), path.alias("structure_path"))
    return fields.withColumn(out, full).select(*given, *([] if out in given else [out]))


def validate_locator(df: DataFrame, keys: list[str], loc: str = "locator") -> DataFrame:
    """Broken locator contracts as (keys, rule, detail) rows."""
    c = F.col(loc)
    t, ocr = c["file_type"], c["content_origin"] == "ocr"

    def all_null(*names: str) -> Column:
        return F.coalesce(*[c[n].cast("string") for n in names]).isNull()

    def before(low: str, high: str) -> Column:
        return c[high] < c[low]

    rules = [
        ("char_range_order", before("char_start", "char_end")),
        ("line_range_order", before("line_start", "line_end")),
        ("row_range_order", before("start_row", "end_row")),
        ("column_range_order", before("start_column", "end_column")),
        ("image_ordinal_mismatch", c["image_ordinal"] != c["image_index"]),
        ("ocr_needs_image", ocr & c["image_ordinal"].isNull()),
        ("pdf_ocr_needs_page", ocr & (t == "pdf") & c["page"].isNull()),
        ("docx_ocr_needs_block", ocr & (t == "docx") & all_null("section_index", "block_index", "paragraph_index", "table_index", "structure_path")),
        ("pptx_ocr_needs_slide", ocr & (t == "pptx") & c["slide_no"].isNull()),
        ("xlsx_ocr_needs_sheet", ocr & (t == "xlsx") & all_null("sheet_name", "sheet_number")),
        ("txt_ocr_needs_line", ocr & (t == "txt") & all_null("line_number", "line_start")),
        ("pdf_foreign_location", (t == "pdf") & ~all_null("slide_no", "sheet_name", "sheet_number", "line_number", "line_start")),
        ("pptx_foreign_location", (t == "pptx") & c["page"].isNotNull()),
        ("xlsx_foreign_location", (t == "xlsx") & ~all_null("page", "slide_no")),
        ("txt_foreign_location", (t == "txt") & ~all_null("page", "slide_no", "sheet_name")),
    ]
    return reject_rows(df, keys, [(n, bad, F.lit(1)) for n, bad in rules])
