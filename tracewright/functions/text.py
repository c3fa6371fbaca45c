"""Column functions on source text: tokens, k-grams, shingles, lines, opening comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token rule, and the widths of k-grams, shingles and winnow windows.
TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|==|!=|<=|>=|->|::|&&|\|\||[-+*/%<>&|^~!?=(){}\[\],.;:]"
KGRAM, SHINGLE, WINDOW = 8, 5, 5
#: An opening comment: a closed block, or a run of // or ! lines with blank lines between them.
LEADING_COMMENT = (
    r"\A[ \t\r\n]*(?:/\*[\s\S]*?\*/[ \t\r\n]*"
    r"|//[^\n]*(?:\n|\z)(?:[ \t\r]*(?://[^\n]*)?(?:\n|\z))*"
    r"|![^\n]*(?:\n|\z)(?:[ \t\r]*(?:![^\n]*)?(?:\n|\z))*)"
)


def ascii_text(data: Column) -> Column:
    """Bytes as text with every byte beyond ASCII made a blank; tokens are the same as of the text."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[\x80-\xff]", " ")


def tokens(text: Column) -> Column:
    """All tokens in order; other characters separate. Null gives null, blank text an empty array."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def strip_leading_comment(text: Column) -> Column:
    """Text behind the opening comment; unclosed blocks and other beginnings stay."""
    return F.regexp_replace(text, LEADING_COMMENT, "")


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def runs_of(words: Column, width: int) -> Column:
    """Blank-joined runs of ``width`` successive words; fewer words give one run, none give none."""
    count = F.greatest(F.size(words) - (width - 1), F.lit(1))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(F.array().cast("array<string>"))


def portable_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits that order alike in every engine."""
    return F.substring(F.md5(text), 1, 16)


def hashed(texts: Column) -> Column:
    """64-bit hashes of the elements of an array, for sets that move."""
    return F.transform(texts, lambda t: F.xxhash64(t))


def stripped_lines(text: Column) -> Column:
    """Distinct lines without surrounding white space, blank ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda l: F.regexp_replace(l, r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", "")), lambda l: l != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell glob, in which a star also crosses slashes."""
    out = ""
    for c in glob:
        out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "_/-" else "\\" + c)
    return f"^{out}$"


def tlsh_distance(a: Column, b: Column) -> Column:
    """Distance of two locality-sensitive digests (T1 and 70 hexadecimal digits); -1 if either is none.

    Header differences (length, quartile ratios, checksum) and the differences of the 128 two-bit
    codes of the body, where the greatest counts double.
    """
    form = "^T1[0-9A-F]{70}$"
    digit = lambda c, i: F.instr(F.lit("0123456789ABCDEF"), F.substring(c, i, 1)) - 1

    def around(x: Column, y: Column, size: int) -> Column:
        return F.least(F.abs(x - y), size - F.abs(x - y))

    def step(d: Column, less: int) -> Column:
        return F.when(d <= 1, d).otherwise((d - less) * 12)

    length = around(16 * digit(a, 6) + digit(a, 5), 16 * digit(b, 6) + digit(b, 5), 256)
    header = step(length, 0) + step(around(digit(a, 7), digit(b, 7), 16), 1) + step(around(digit(a, 8), digit(b, 8), 16), 1)
    header = header + F.when(F.substring(a, 3, 2) != F.substring(b, 3, 2), 1).otherwise(0)

    def code(x: Column, y: Column) -> Column:
        d = F.abs(x - y)
        return F.when(d == 3, 6).otherwise(d)

    def pair(i: Column) -> Column:
        x = F.instr(F.lit("0123456789ABCDEF"), a.substr(i, F.lit(1))) - 1
        y = F.instr(F.lit("0123456789ABCDEF"), b.substr(i, F.lit(1))) - 1
        return code(F.floor(x / 4), F.floor(y / 4)) + code(x % 4, y % 4)

    body = F.aggregate(F.sequence(F.lit(9), F.lit(72)), F.lit(0).cast("bigint"), lambda acc, i: acc + pair(i).cast("bigint"))
    return F.when(a.rlike(form) & b.rlike(form), header + body).otherwise(-1).cast("bigint")
