"""Categories of error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

#: Needles of each category in order of precedence (fixed values); a tuple holds alternatives, a list of tuples needs one of each.
CATEGORIES = (
    ("user_rejected", [("doesn't want to proceed", "was rejected")]),
    ("sibling_errored", [("sibling tool call errored",)]),
    ("hook_blocked", [("hook",), ("blocked", "denied")]),
    ("file_not_read_first", [("has not been read yet",)]),
    ("file_modified_since_read", [("modified since read",)]),
    ("file_not_found", [("does not exist", "no such file", "enoent")]),
    ("path_error", [("eisdir", "path does not exist")]),
    ("token_limit_exceeded", [("exceeds maximum allowed tokens",)]),
    ("mcp_error", [("mcp error",)]),
    ("pre_commit_failed", [("precommit failed", "pre-commit", "lefthook")]),
    ("exit_code", [("exit code",)]),
)
OTHER = "other"
#: Who could have prevented an error of a category (fixed values).
PREVENTABILITY = {
    "preventable": ("file_not_read_first", "file_modified_since_read", "file_not_found", "path_error", "token_limit_exceeded"),
    "user_driven": ("user_rejected", "hook_blocked"),
    "cascading": ("sibling_errored",),
    "systemic": ("exit_code", "mcp_error", "pre_commit_failed"),
}


def category(content: Column) -> Column:
    lower = ascii_lower(content)
    out = None
    for name, groups in CATEGORIES:
        match = F.lit(True)
        for needles in groups:
            any_of = F.lit(False)
            for needle in needles:
                any_of = any_of | lower.contains(needle)
            match = match & any_of
        out = F.when(match, name) if out is None else out.when(match, name)
    return out.otherwise(OTHER)


def preventability(name: Column) -> Column:
    out = None
    for kind, names in PREVENTABILITY.items():
        out = F.when(name.isin(*names), kind) if out is None else out.when(name.isin(*names), kind)
    return out.otherwise(OTHER)
