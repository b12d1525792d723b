"""Columns that read package, class, method and call names out of Java text.

Matching is by pattern over the whole file, comments included. Possessive quantifiers
mark the places where giving characters back can never help a match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.text import INLINE_SPACE, SPACE, WORD

# Names that are never taken for a call.
NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "new", "throw", "try", "else",
    "do", "synchronized", "super", "this", "eval",
    "String", "INT", "ROW", "FIELD", "FLOAT", "BOOLEAN", "explicit",
    "hashCode", "equals", "toString", "clone", "finalize", "wait", "notify", "notifyAll",
)

PACKAGE = rf"(?md)^{INLINE_SPACE}*+package{SPACE}++([\p{{L}}\p{{N}}_.]++){SPACE}*+;"
CLASS = rf"class{SPACE}++({WORD}++)"
# A modifier, anything on its line, a name, parameters on one line, a brace. The name is
# the first that fits. Three things leave the matches as they are and keep long lines
# linear. Of the names that are followed by a parenthesis on the modifier's line only the
# first is tried: where no parameter list closes before a brace behind it, none does
# behind a later one. Then only a name at the end of the line or on the next can fit.
# And where a modifier leads nowhere, no later one on its line can lead anywhere either:
# the last branch skips the line, with an empty name. Blanks before a name are taken from
# their start, as a try from within them ends alike.
_BLANKS = rf"(?<!{SPACE}){SPACE}++"
METHOD = (
    rf"(?:public|protected|private)(?:(?:"
    rf"(?>[^\n]*?(?<!{SPACE}){INLINE_SPACE}++(?={WORD}++{INLINE_SPACE}*+\())"
    rf"|[^\n]*?(?<!{SPACE})(?=(?:{INLINE_SPACE}++{WORD}++)?{INLINE_SPACE}*+\n){_BLANKS}"
    rf")({WORD}++){SPACE}*+\([^\n]*?\){SPACE}*+\{{"
    rf"|[^\n]*+)"
)
# Read from a parenthesis backwards: blanks, then a name.
CALL_BACKWARDS = rf"\A{SPACE}*+({WORD}++)"


def package_of(text: Column) -> Column:
    """The first declared package, null if there is none."""
    return F.nullif(F.regexp_extract(text, PACKAGE, 1), F.lit(""))


def classes_of(text: Column) -> Column:
    """All class names in order, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(CLASS), F.lit(1))


def methods_of(text: Column) -> Column:
    """All declared method names in order, duplicates kept."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(METHOD), F.lit(1)), "")


def call_sites_of(text: Column) -> Column:
    """All names followed by an opening parenthesis, in order, duplicates kept.

    Each name is read backwards from its parenthesis, so that no other word is tried.
    """
    before = F.split(text, r"\(")
    found = F.transform(before, lambda part: F.regexp_extract(F.reverse(part), CALL_BACKWARDS, 1))
    # Behind the last parenthesis there is no call; of one that follows no name, none is left.
    names = F.filter(F.slice(found, 1, F.size(found) - 1), lambda name: name != "")
    return F.transform(names, lambda name: F.reverse(name))


def local_calls(call_sites: Column, methods: Column) -> Column:
    """Call sites naming a method of the same file, less the fixed names.

    The two set operations are hash-based and shrink the list that the
    order-keeping filter has to search. Through the one-item array that list is bound
    to a lambda variable and built once per file, not once per call site.
    """
    stop = F.array(*[F.lit(name) for name in NOT_CALLS])
    known = F.array_except(F.array_intersect(call_sites, methods), stop)
    kept = F.transform(
        F.array(known), lambda names: F.filter(call_sites, lambda c: F.array_contains(names, c))
    )
    return F.get(kept, F.lit(0))


def class_fqn(package: Column, name: Column) -> Column:
    return F.concat_ws(".", package, name)


def method_fqn(package: Column, classes: Column, name: Column) -> Column:
    """Package, the file's first class, method; missing parts are left out."""
    return F.concat_ws(".", package, F.get(classes, F.lit(0)), name)
