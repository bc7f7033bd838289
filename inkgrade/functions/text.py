"""Text columns: upload URLs, id lists, grades, report cells, task requirements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkgrade.functions.cols import ladder

# Extensions accepted for submissions, and the wider list the scorer can open.
UPLOAD_SUFFIXES = [".jpg", ".jpeg", ".png", ".pdf"]
LOADER_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff", ".pdf"]

UPLOAD_MARKER = "app/uploads/"


def to_upload_url(path: Column) -> Column:
    """Public URL of a stored file path; null for null or empty."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(norm, F.lit(UPLOAD_MARKER))
    return (
        F.when(path.isNull() | (path == ""), F.lit(None).cast("string"))
        .when(at > 0, F.concat(F.lit("/uploads/"), F.substr(norm, at + len(UPLOAD_MARKER))))
        .when(norm.startswith("uploads/"), F.concat(F.lit("/"), norm))
        .otherwise(norm)
    )


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def has_suffix(path: Column, suffixes: list[str] = UPLOAD_SUFFIXES) -> Column:
    """Whether the file name ends with one of the suffixes and has a stem before it.

    Plain string functions: this runs on every request, and a regular expression costs far more.
    """
    last = F.substring_index(path, ".", -1)
    stem_end = F.length(path) - F.length(last) - 1
    return (
        F.lower(last).isin([s.lstrip(".") for s in suffixes]) & (stem_end > 0)
        & ~F.substr(path, stem_end, F.lit(1)).isin("/", "\\"))


def parse_id_list(text: Column) -> Column:
    """Struct(ids array<bigint>, valid): comma list, white space trimmed, blanks skipped, first-seen order, digits only.

    A number beyond bigint makes the list invalid.
    """
    trimmed = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, ","), trimmed), lambda p: p != "")
    parts = F.coalesce(parts, F.array().cast("array<string>"))
    valid = F.forall(parts, lambda p: p.rlike(r"^\d+$") & p.try_cast("bigint").isNotNull())
    ids = F.when(valid, F.array_distinct(F.transform(parts, lambda p: p.try_cast("bigint"))))
    return F.struct(ids.alias("ids"), valid.alias("valid"))


def grade_label(total: Column) -> Column:
    """Grade of a total from the comparison rubric; null without a total."""
    return F.when(total.isNotNull(), ladder(
        total, [(86, "A'lo"), (71, "Yaxshi"), (56, "Qoniqarli")], "Qoniqarsiz"))


def band_label(total: Column) -> Column:
    """Grade of a total from the stand-alone rubric; null without a total."""
    return F.when(total.isNotNull(), ladder(
        total, [(90, "A'lo"), (80, "Yaxshi"), (70, "Qoniqarli+"), (60, "Qoniqarli")], "Qoniqarsiz"
    ))


def safe_number(value: Column) -> Column:
    """A float cell of a report, at four decimals."""
    return F.bround(value, 4)


def safe_text(value: Column, limit: int = 180) -> Column:
    """Text of a container cell, cut with an ellipsis when longer than ``limit``."""
    return F.when(
        F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(value)


# Vocabulary of task descriptions (Uzbek, Russian, English).
VIEW_PATTERNS = [
    r"(\d+)\s*(?:ta\s*)?(?:proyeksiya|proeksiya|ko['‘’`]?rinish|korinish|вид|вида|views?)",
    r"(?:proyeksiya|proeksiya|ko['‘’`]?rinish|korinish|вид|views?)\s*(\d+)",
]
ISOMETRIC_WORDS = [
    "yaqqol tasvir", "yaqqol", "aksonometriya", "axonometry", "isometric", "izometrik",
    "аксонометр", "изометр",
]
SECTION_WORDS = ["qirqim", "kesim", "section", "sectional", "razrez", "разрез", "сечение"]
DIMENSION_WORDS = [
    "o'lcham", "o‘lcham", "olcham", "razmer", "размер", "dimension", "dimensions",
]


def task_requirements(text: Column, views: int = 3, isometric: bool = False,
                      section: bool = False, dimensions: bool = True) -> dict[str, Column]:
    """Requirement columns read from a task description, defaults where it says nothing."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))

    def mentions(words):
        return low.rlike("|".join(words))

    def number(pattern):  # one beyond int is a number that no drawing meets
        digits = F.regexp_extract(low, "(?iu)" + pattern, 1)
        return F.when(digits != "", F.coalesce(digits.try_cast("int"), F.lit(2**31 - 1)))

    found = [number(p) for p in VIEW_PATTERNS]
    return {
        "required_views": F.coalesce(*found, F.lit(views)),
        "requires_isometric": mentions(ISOMETRIC_WORDS) | F.lit(isometric),
        "requires_section": mentions(SECTION_WORDS) | F.lit(section),
        "requires_dimensions": mentions(DIMENSION_WORDS) | F.lit(dimensions),
    }
