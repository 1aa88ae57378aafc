"""Text expressions. Whitespace is what Unicode calls whitespace plus the four separators U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

# fixed values: task sentences and the layout of instructed queries
TASK_PLAIN = "Given a legal context, retrieve the most relevant precedent passage."
TASK_COURT = "Given a legal context and the court it appeared in, retrieve the most relevant precedent passage."
TASK_COURT_DATE = (
    "Given a legal context and the court it appeared in, retrieve the most relevant precedent passage "
    "for which we also know the court it came from and its date."
)
QUERY_LAYOUT = "Instruct: {task}\nQuery: "
CONTEXT_LAYOUT = "{task}\nContext: "


def collapse_ws(c: Column) -> Column:
    """Words joined by one space, nothing at the ends."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def strip_ws(c: Column) -> Column:
    """Remove whitespace at both ends; null stays null."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"(?U){NON_SPACE}+"))


def words(c: Column) -> Column:
    """Array of words; empty for blank text."""
    return F.filter(F.split(c, f"(?U){SPACE}+"), lambda w: w != "")


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def keep_last_words(c: Column, n: int) -> Column:
    """The last ``n`` words: texts are cut on the left, so the end of a context survives."""
    all_words = words(c)
    return F.array_join(F.slice(all_words, F.greatest(F.size(all_words) - n + 1, F.lit(1)), n), " ")


def tag_format(fields: list[tuple[str, Column]]) -> Column:
    """``<A>..</A> <B>..</B>`` from the given tags and columns; a missing value gives an empty tag."""
    return F.concat_ws(
        " ",
        *[F.concat(F.lit(f"<{tag}>"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f"</{tag}>")) for tag, c in fields],
    )


def with_instruction(c: Column, prefix: str, suffix: str = "") -> Column:
    """Prefix and end marker around the unchanged text."""
    return F.concat(F.lit(prefix), c, F.lit(suffix))


def e5_query(c: Column, task: str = TASK_PLAIN) -> Column:
    """Instructed query with its whitespace collapsed."""
    return with_instruction(collapse_ws(c), QUERY_LAYOUT.format(task=task))
