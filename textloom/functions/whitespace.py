"""The white space that the text functions agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points at which text is split into words.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_RUN = f"[{WHITE}]+"


def but_single_blanks(white: str) -> str:
    """Matches the runs of white space that are not just one blank: most blanks of a text do not match, so little is rewritten."""
    return f"(?:[{white.replace(chr(92) + 'x1C-' + chr(92) + 'x20', chr(92) + 'x1C-' + chr(92) + 'x1F')}]| (?=[{white}]))[{white}]*"


_CHANGED = but_single_blanks(WHITE)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, _CHANGED, " "))


def collapse_blanks(text: Column) -> Column:
    """collapse for text whose only white space is blanks."""
    return F.trim(F.regexp_replace(text, "  +", " "))


def strip(text: Column) -> Column:
    """Removes white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE_RUN}|{WHITE_RUN}$", "")
