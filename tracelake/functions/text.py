"""Column expressions on text: truncation, fingerprints, paths, commands, time stamps."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
WORKTREE = r"/\.claude/worktrees/[^/]+/"
#: Signs that are stripped from both ends of a command's tokens (fixed values).
TRIMMED = r"""^['",;:()\[\]]+|['",;:()\[\]]+$"""


def truncated(text: Column, n: int) -> Column:
    """The first ``n`` code points, and three dots if there were more."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def scaled_round(value: Column, digits: int) -> Column:
    """Half away from zero after scaling, which differs from rounding the decimal value."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def error_fingerprint(content: Column) -> Column:
    paths = F.regexp_replace(content, r"(?U)/[^\s:]+/[^\s:]+", "<path>")
    return truncated(F.regexp_replace(paths, r"(?U)\d+", "N"), 120)


def tokens(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, WHITE), lambda t: t != "")


def command_fingerprint(command: Column) -> Column:
    return truncated(F.array_join(tokens(F.regexp_replace(command, r"(?U)/[^\s]+", "<path>/")), " "), 200)


def command_paths(command: Column) -> Column:
    """Tokens of a command that look like paths."""
    bare = F.transform(tokens(command), lambda t: F.regexp_replace(t, TRIMMED, ""))
    return F.filter(bare, lambda t: t.contains("/") & ~t.startswith("http://") & ~t.startswith("https://"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def last_component(path: Column) -> Column:
    return F.try_element_at(path_parts(path), F.lit(-1))


def folded_worktree(path: Column) -> Column:
    """The path of a file in a worktree as it is in the main tree."""
    return F.regexp_replace(path, WORKTREE, "/")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def instant(text: Column) -> Column:
    """A time stamp from strict RFC 3339 text; NULL for anything else."""
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def rfc3339(stamp: Column) -> Column:
    """UTC text with no, 3 or 6 fractional digits, as they are needed."""
    micros = F.pmod(F.unix_micros(stamp), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.format_string(".%03d", (micros / 1000).cast("long"))).otherwise(F.format_string(".%06d", micros))
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def millis_between(start: Column, end: Column) -> Column:
    """Signed milliseconds, cut off towards zero; NULL if either is."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return (F.signum(micros) * F.floor(F.abs(micros) / 1000)).cast("long")


def accents() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and those base letters, one for one."""
    letters = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c))[0] == "L"]
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in letters]
    pairs = [(c, base) for c, base in pairs if c != base]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def unaccented(text: Column) -> Column:
    """Text without accents: composed letters as their base letters, combining marks dropped."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *accents())


def words(text: Column, plain: bool = False) -> Column:
    """Letters and digits between single spaces, for phrase search; ``plain`` drops accents."""
    lower = F.lower(text)
    lower = unaccented(lower) if plain else lower
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(lower, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != ""), " "), F.lit(" "))
