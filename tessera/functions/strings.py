"""String kernels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def extension(c: Column) -> Column:
    """Lower-case text after the last dot of the name; empty without one."""
    return F.lower(F.regexp_extract(c, r"\.([^./]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def renamed(c: Column, prefix: str = "", suffix: str = "") -> Column:
    """prefix + stem + suffix + extension; a name without a dot gets both at its ends."""
    dot = F.regexp_extract(c, r"(\.[^.]*)$", 1)
    return F.concat(F.lit(prefix), stem(c), F.lit(suffix), dot)


def numbered(prefix: str, n: Column, ext: Column | str) -> Column:
    """prefix, at least nine digits, extension; longer numbers are never cut."""
    return F.concat(F.lit(prefix), F.format_string("%09d", n), F.lit(ext) if isinstance(ext, str) else ext)


def name_faults(c: Column) -> Column:
    """What is wrong with a file name; several reasons may hold."""
    checks = [
        ("starts_with_space", c.startswith(" ")),
        ("ends_with_space", c.endswith(" ")),
        ("two_spaces", c.contains("  ")),
        ("space_before_dot", c.contains(" .")),
        ("ends_with_dot", c.endswith(".")),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda x: x.isNotNull())


def collapse_pairs(c: Column) -> Column:
    """One pass: each pair of blanks becomes one."""
    return F.replace(c, F.lit("  "), F.lit(" "))


def glob_pattern(globs: list[str]) -> str:
    """A regular expression that matches whole names by any of the shell patterns (`*` only)."""
    one = lambda g: "".join(".*" if ch == "*" else "\\" + ch if not ch.isalnum() and ch not in "_ " else ch for ch in g)
    return "^(" + "|".join(one(g) for g in globs) + ")$"


# Names that a LaTeX build, or systems and applications, leave behind.
LATEX_JUNK = ["*.aux", "*.backup", "*.bbl", "*.blg", "*.definition", "*.dvi", "*.idx", "*.ilg", "*.ind", "*.info", "*.lof", "*.log", "*.lot", "*.ps", "*.synctex", "*.toc", "*~"]
SYSTEM_JUNK = [".DS_Store", "._.DS_Store", "Thumbs.db", "desktop.ini", "*.AAE", "AlbumArt*", ".picasa.ini", ".picasaoriginals", "~$*.docx", "~WRL*.tmp", ".~lock.*odt#"]


def is_junk(c: Column) -> Column:
    return c.rlike(glob_pattern(LATEX_JUNK + SYSTEM_JUNK))


def is_jpeg(c: Column) -> Column:
    return F.lower(c).endswith(".jpg") | F.lower(c).endswith(".jpeg")


def jpeg_to_jpg(c: Column) -> Column:
    return F.regexp_replace(c, r"\.jpeg$", ".jpg")


def first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def after_first_blank(c: Column) -> Column:
    return F.when(c.contains(" "), F.substr(c, F.instr(c, " ") + 1)).otherwise(F.lit(""))


def lenient_long(c: Column) -> Column:
    """The integer a text begins with, as scripting languages read it; null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def size_kib(c: Column) -> Column:
    """`128KB`, `5MB`, `2GB` or a bare number to KiB; null for other texts."""
    low = F.lower(c)
    number = lambda unit: F.substring_index(low, unit, 1).try_cast("bigint")
    return (
        F.when(low.contains("kb"), number("kb"))
        .when(low.contains("mb"), number("mb") * 1024)
        .when(low.contains("gb"), number("gb") * 1024 * 1024)
        .otherwise(low.try_cast("bigint"))
    )


def is_empty_loose(c: Column) -> Column:
    """Null, empty or "0": what loose languages call empty."""
    return c.isNull() | c.isin("", "0")


def parts_without_empty(c: Column, by: str) -> Column:
    return F.filter(F.split(c, by), lambda x: x != "")


def rotate_by_one(c: Column) -> Column:
    return F.concat(F.substr(c, F.lit(2)), F.substring(c, 1, 1))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def add_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"(['\"\\])", r"\\$1")


def chunk_split(c: Column, size: int, end: str) -> Column:
    return F.regexp_replace(c, f"([\\s\\S]{{1,{size}}})", "$1" + end)


def html_link(href: Column, text: Column) -> Column:
    return F.format_string('<a href="%s">%s</a>', href, text)


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def outside_outputs(path: Column, outputs: list[str]) -> Column:
    """Whether the file's folder is none of the output folders."""
    return ~F.coalesce(F.element_at(F.split(path, "/"), -2), F.lit("")).isin(outputs)


def add_slashes(c: Column) -> Column:
    """A backslash before each quote, double quote, backslash and NUL (which is written 0)."""
    return F.replace(F.regexp_replace(c, r"([\\'\"\x00])", r"\\$1"), F.lit("\0"), F.lit("0"))
