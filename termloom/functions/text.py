"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the tokeniser sees it.
SPACE = r"\s\u0085\p{Z}"
STRIP = rf"[^\p{{IsAlphabetic}}\p{{N}}{SPACE}]+"
WINDOW = 60


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Case-insensitive form: full Unicode lower case."""
    return F.lower(col(x))


def ascii_fold(x: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(col(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column | str, stop_words: list[str] | tuple[str, ...] = ()) -> Column:
    """Lower-case words without their punctuation, of two bytes or more, that aren't stop words."""
    stripped = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), STRIP, ""))
    words = F.split(stripped, rf"[{SPACE}]+")
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & (~w.isin(*stop_words) if stop_words else F.lit(True)))


def words(text: Column | str) -> Column:
    """What stands between white space."""
    return F.filter(F.split(col(text), rf"[{SPACE}]+"), lambda w: w != "")


def trim_stopwords(term: Column | str, stop_words: list[str] | tuple[str, ...]) -> Column:
    """Drop stop words from both ends of a phrase. One word, or nothing but stop words, stays as it is."""
    parts = words(term)
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    useful = F.filter(F.transform(parts, lambda w, i: F.when(~F.array_contains(stop, F.lower(w)), i + 1)), lambda i: i.isNotNull())
    first, last = F.array_min(useful), F.array_max(useful)
    return F.when((F.size(parts) <= 1) | (F.size(useful) == 0), col(term)).otherwise(F.array_join(F.slice(parts, first, last - first + 1), " "))


def contains_fold(text: Column | str, term: Column | str) -> Column:
    return F.contains(fold(text), fold(term))


def context(text: Column | str, term: Column | str, window: int = WINDOW) -> Column:
    """The text around the first case-insensitive hit: ``window`` characters on either side, the left edge moved
    past a cut word, white space trimmed. Null without a hit."""
    text, term = col(text), col(term)
    at = F.position(fold(term), fold(text))
    start = F.greatest(at - window, F.lit(1))
    end = F.least(at + F.char_length(term) + window - 1, F.char_length(text))
    cut = F.substring(text, start, end - start + 1)
    snapped = F.when(start > 1, F.regexp_replace(cut, rf"\A[^{SPACE}]*[{SPACE}]+(?=[^{SPACE}])", "")).otherwise(cut)
    return F.when(at > 0, F.regexp_replace(snapped, rf"\A[{SPACE}]+|[{SPACE}]+\z", ""))


def byte_offset_after(text: Column | str, term: Column | str) -> Column:
    """Byte offset just behind the first case-insensitive hit, in UTF-8; null without one.

    The hit is sought in characters, so text whose case folding changes its byte length is met as well.
    """
    text, term = col(text), col(term)
    at = F.position(fold(term), fold(text))
    return F.when((at > 0) & (F.char_length(term) > 0), F.octet_length(F.substring(text, F.lit(1), at - 1 + F.char_length(term))).cast("long"))


def toggle_plural(term: Column | str) -> Column:
    term = col(term)
    return F.when(F.endswith(term, F.lit("s")), F.substring(term, F.lit(1), F.char_length(term) - 1)).otherwise(F.concat(term, F.lit("s")))


def alias_forms(term: Column | str) -> Column:
    """What an unresolved term is tried as, in order: suffixes, prefixes (longest first), plural toggled."""
    parts = words(term)
    n = F.size(parts)
    many = n >= 2
    none = F.array().cast("array<string>")
    suffixes = F.when(many, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), " "))).otherwise(none)
    prefixes = F.when(many, F.transform(F.sequence(F.greatest(n - 1, F.lit(1)), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))).otherwise(none)
    return F.concat(suffixes, prefixes, F.array(toggle_plural(term)))


def suggest_alias(text: Column | str, term: Column | str) -> Column:
    """The first of the forms that the text holds, else null."""
    return F.get(F.filter(alias_forms(term), lambda x: contains_fold(text, x)), 0)


def escape_markup(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"([@#<$_*])", r"\\$1")


def term_label(term: Column | str) -> Column:
    """A reference label: ASCII letters and digits in lower case, other runs a hyphen, no hyphen at the end."""
    dashed = F.regexp_replace(col(term), r"[^A-Za-z0-9]+", "-")
    return F.concat(F.lit("term-"), F.lower(F.regexp_replace(dashed, r"-\z", "")))


def marker(term: Column | str, chain: Column | str, main: Column | str) -> Column:
    """An index marker, with the chain of parents if there is one."""
    term, chain = col(term), col(chain)
    name = F.when(col(main), F.lit("#index-main")).otherwise(F.lit("#index"))
    quoted = F.array_join(F.transform(F.concat(chain, F.array(term)), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return F.when(F.size(chain) > 0, F.concat(name, F.lit("("), quoted, F.lit(")"))).otherwise(F.concat(name, F.lit("["), term, F.lit("]")))


def see_also(terms: Column | str) -> Column:
    """A line of links to other terms; empty without any."""
    links = F.transform(col(terms), lambda t: F.concat(F.lit("#link(<"), term_label(t), F.lit(">)["), escape_markup(t), F.lit("]")))
    return F.when(F.size(col(terms)) > 0, F.concat(F.lit(" _See also: "), F.array_join(links, ", "), F.lit("_"))).otherwise(F.lit(""))


def compact_candidate(term: Column | str, score: Column | str, files: Column | str) -> Column:
    return F.concat_ws(" | ", col(term), F.format_string("%.2f", col(score)), F.array_join(col(files), ", "))


def compact_entry(term: Column | str, parent: Column | str, children: Column | str, aliases: Column | str, links: Column | str) -> Column:
    """A term with its relations on one line."""
    part = lambda name, x: F.when(F.size(col(x)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(col(x), ", ")))
    related = F.concat_ws(" | ", F.concat(F.lit("parent: "), col(parent)), part("children", children), part("aliases", aliases), part("see_also", links))
    return F.concat(col(term), F.lit(" | "), F.when(related == "", F.lit("(top-level, no relationships)")).otherwise(related))


def human_size(n: Column | str) -> Column:
    n = col(n)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / (1024.0 * 1024.0), 1)))
    )


def path_ends_with(path: Column | str, suffix: Column | str) -> Column:
    """Whether a path ends with another's components; ``old-auth.md`` doesn't end with ``auth.md``."""
    path, suffix = col(path), col(suffix)
    return (path == suffix) | F.endswith(path, F.concat(F.lit("/"), suffix))


def timestamp_text(ts: Column | str) -> Column:
    """RFC 3339 in whole seconds, UTC (the session's time zone is expected to be UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def strip_frontmatter(content: Column | str) -> Column:
    """Without the block between two ``---`` lines at the start; unchanged where it isn't closed."""
    return F.regexp_replace(col(content), r"(?s)\A\s*---\r?\n(.*?\n)??[ \t]*---[ \t]*(\r?\n|\z)", "")
