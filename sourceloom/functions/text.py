"""Text columns: decoding, banner stripping, snippets, escaping, formatting.

Python's ``\\w`` and ``\\s`` are Unicode classes without a direct Java twin, so both are
spelled out below. ``.`` is spelled ``[^\\n]`` because Java's dot stops at more line
ends than Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
INLINE_SPACE = r"[\t\x0b-\r\x1c-\x20\x85\p{Z}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"

# The words that mark a leading comment as a licence banner.
BLOCK_BANNER_WORDS = "license|copyright|apache software foundation|licensed to the apache"
LINE_BANNER_WORDS = "apache|license|copyright"

# Possessive groups: they match the same text as the greedy ones here and keep Java's
# matcher from recursing once per comment line.
_BLOCK = rf"(?s)\A{SPACE}*+/\*(.*?)\*/{SPACE}*+"
_LINES = rf"\A{SPACE}*+(?://[^\n]*+\n)++{SPACE}*+"

_REPLACEMENT = "\ufffd"
_ESCAPE = "\ufdd0"

NO_CODE = "[no code stored for this fragment]"


def decode_source(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 bytes dropped, line ends normalised to LF.

    A replacement character that is really in the file is kept: it is escaped while the
    invalid bytes are removed, and so is the escape character itself.
    """
    raw = content.cast("string")
    escaped = raw
    for char, code in ((_ESCAPE, _ESCAPE + "e"), (_REPLACEMENT, _ESCAPE + "r")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    for char, code in ((_REPLACEMENT, _ESCAPE + "r"), (_ESCAPE, _ESCAPE + "e")):
        cleaned = F.replace(cleaned, F.lit(code), F.lit(char))
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(raw), cleaned), r"\r\n?", "\n")


def strip_block_banner(text: Column) -> Column:
    """Drop a leading block comment if it names a licence."""
    banner = F.lower(F.regexp_extract(text, _BLOCK, 1))
    return F.when(banner.rlike(BLOCK_BANNER_WORDS), F.regexp_replace(text, _BLOCK, "")).otherwise(text)


def strip_line_banner(text: Column) -> Column:
    """Drop a leading run of ``//`` lines if it names a licence."""
    banner = F.lower(F.regexp_extract(text, _LINES, 0))
    return F.when(banner.rlike(LINE_BANNER_WORDS), F.regexp_replace(text, _LINES, "")).otherwise(text)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    # The one-item array binds the split to a lambda variable, so it is made once per row.
    cut = F.transform(
        F.array(F.split(text, LINE_END)),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )
    return F.get(cut, F.lit(0))


def code_preview(code: Column, n: int = 8) -> Column:
    """The first n lines of the trimmed code, then ``...`` if there are more."""
    lines = lines_of(F.regexp_replace(code, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", ""))
    head = F.array_join(F.slice(lines, 1, n), "\n")
    shown = F.when(F.size(lines) > n, F.concat(head, F.lit("\n..."))).otherwise(head)
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(NO_CODE)).otherwise(shown)


def report_snippet(code: Column, n: int = 60) -> Column:
    """The first n lines as they are."""
    return F.array_join(F.slice(lines_of(F.coalesce(code, F.lit(""))), 1, n), "\n")


def html_escape(text: Column) -> Column:
    """Escape ``&``, ``<`` and ``>``; quotes stay."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def fixed4(value: Column) -> Column:
    """A number with four decimals. The shortest decimal form is rounded, halves to even;
    C rounds the binary value, which can differ in the last digit of such halves."""
    return F.format_string("%.4f", F.bround(value.cast("double"), 4))


def clip(text: Column, n: int, missing: str) -> Column:
    """The first n characters, or those of a stand-in for a missing text."""
    return F.substring(F.coalesce(text, F.lit(missing)), 1, n)


def hit_title(kind: Column, symbol: Column) -> Column:
    return F.concat_ws(" · ", kind, symbol)


def hit_meta(file_path: Column, score: Column) -> Column:
    return F.concat(F.lit("File: "), file_path, F.lit(" · Score: "), fixed4(score))


def vector_head(vector: Column, n: int = 5) -> Column:
    """``[0.1000, 0.2000 ...]``: the first n numbers of a vector, ``-`` for none."""
    shown = F.array_join(F.transform(F.slice(vector, 1, n), fixed4), ", ")
    tail = F.when(F.size(vector) > n, F.lit(" ...]")).otherwise(F.lit("]"))
    return F.when(vector.isNull(), F.lit("-")).otherwise(F.concat(F.lit("["), shown, tail))


def graph_text(symbol: Column, callers: Column, callees: Column) -> Column:
    """Left-to-right graph markup of one method with its callers and callees.

    Node ids come from md5, so the same name gets the same id in every run.
    """

    def node_id(name: Column) -> Column:
        return F.substring(F.md5(name), 1, 16)

    head = F.concat(F.lit('graph LR\n  target["'), symbol, F.lit('"]'))
    into = F.transform(
        callers,
        lambda c: F.concat(F.lit("  caller_"), node_id(c), F.lit('(["'), c, F.lit('"]) --> target')),
    )
    out = F.transform(
        callees,
        lambda c: F.concat(F.lit("  target --> callee_"), node_id(c), F.lit('(["'), c, F.lit('"]) ')),
    )
    return F.array_join(F.concat(F.array(head), into, out), "\n")
