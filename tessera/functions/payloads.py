"""Rewriting the strings of JSON texts of any nesting, for redaction.

A text is walked token by token, so escapes are understood and all that is not a string to
be replaced (numbers, blanks, the order of keys, repeated keys) stays as it was. A text that does not parse
gives null: what cannot be read cannot be shown to be clean.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]')


def rewritten(text: str | None, value: Callable[[str, str], str], name: Callable[[str], str] = lambda k: k) -> str | None:
    """text with every string s replaced by value(key, s), and every key k by name(k).

    The key of a string is that of the nearest object around it, also through lists ("" without one).
    """
    try:
        json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    around: list[list] = []  # per open bracket: whether it is an object, its current key, whether a key comes next

    def fold(m: re.Match) -> str:
        t = m.group()
        top = around[-1] if around else [False, "", False]
        if t == "{":
            around.append([True, "", True])
        elif t == "[":
            around.append([False, top[1], False])
        elif t in "}]":
            around.pop()
        elif t == ",":
            top[2] = top[0]
        elif t == ":":
            top[2] = False
        else:
            own = json.loads(t)
            if top[2]:
                top[1] = own
            new = name(own) if top[2] else value(top[1], own)
            return t if new == own else json.dumps(new, ensure_ascii=False)
        return t

    return TOKEN.sub(fold, text)


#: Words in keys that name paths, keys whose path stands for the evidence itself, and what a relative path begins with.
PATH_WORDS, EVIDENCE_WORD, EVIDENCE_KEYS = ("path", "directory", "folder"), "image", ("path", "media_path", "file_path")
PATH_STARTS = ("/", "data/", "runs/", "outputs/")


def public_payload(payload: Column, sha256: Column, artifacts: dict[str, str], hidden: str = "REDACTED_INTERNAL_PATH") -> Column:
    """A JSON text without local paths: registered artifacts become their URL, the evidence's own path its digest, other paths and file URLs, also those inside a text, are hidden.

    Null where the text does not parse.
    """
    known = {p: u for path, u in artifacts.items() for p in (path, f"file://{path}")}
    inside = re.compile(r"file://[^\s\"'<>]*")

    def public(key: str, s: str, digest: str | None) -> str:
        if s in known:
            return known[s]
        if s.startswith("file://"):
            return hidden
        k = key.lower()
        if any(w in k for w in PATH_WORDS) and s.startswith(PATH_STARTS):
            return f"evidence://sha256/{digest}" if digest is not None and (EVIDENCE_WORD in k or k in EVIDENCE_KEYS) else hidden
        return inside.sub(hidden, s)

    @F.pandas_udf("string")
    def run(texts: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([rewritten(t, lambda k, s, d=d: public(k, s, d if isinstance(d, str) else None)) for t, d in zip(texts, digests)], dtype=object)

    return run(payload, sha256)


def redacted_payload(payload: Column, secrets: Sequence[str], mark: str = "[REDACTED]") -> Column:
    """A JSON text with every non-empty secret replaced in all strings and keys at any depth, longest first. Null where it does not parse."""
    longest = sorted({x for x in secrets if x}, key=lambda x: (-len(x), x))

    def clean(s: str) -> str:
        for x in longest:
            s = s.replace(x, mark)
        return s

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([rewritten(t, lambda k, s: clean(s), clean) for t in texts], dtype=object)

    return run(payload)
