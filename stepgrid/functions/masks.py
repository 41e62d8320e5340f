"""Name masks: file globs whose wildcards stop at ``/``, and regular expressions that match whole names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(mask: str) -> str:
    out, at = "", 0
    while at < len(mask):
        c = mask[at]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := mask.find("]", at + 2)) > 0:
            inner = mask[at + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return out


def matches(name: Column, mask: str, regex: bool = False) -> Column:
    """Whether a name matches a mask as a whole; a mask without a leading ``/`` also matches names with one."""
    pattern = mask if regex else glob_to_regex(mask)
    lead = "" if mask.startswith("/") else "/?"
    return name.rlike(f"^{lead}(?:{pattern})$")
