"""Sentences from a signature's tokens: what a function takes and returns, what fields a type has."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

Token = tuple[str, str]  # text, kind

# Plain words for primitive types.
WORDS = {
    "string": "text", "number": "a number", "boolean": "a boolean", "void": "nothing", "undefined": "undefined", "null": "null", "never": "never", "any": "any value", "unknown": "an unknown value",
}

# A signature is read as a string of one sign a token, in which names and types are found by patterns.
_KINDS = {"keyword": "k", "localName": "l", "aliasName": "a", "parameterName": "p", "propertyName": "f", "space": " ", "lineBreak": " ", "punctuation": "."}
_OWN_SIGN = frozenset(",);[]<>")
_SILENT = re.compile(r"[ .,);]")
_PARTS = {"function": re.compile(r"p([^,)]*)"), "type": re.compile(r"f([^;]*)")}


class Signature:
    """Tokens as signs and texts; slices of it speak types."""

    def __init__(self, tokens: list[Token], terms: dict[str, str]):
        self.texts, self.terms = [text for text, _ in tokens], terms
        self.signs = "".join(text if text in _OWN_SIGN and text else _KINDS.get(kind, "x") for text, kind in tokens)
        self.used: set[str] = set()

    def spoken(self, start: int, stop: int) -> str:
        """The type between two tokens: what wraps it, outermost first, and its own words."""
        heard = [k for k in range(start, stop) if not _SILENT.match(self.signs[k])]
        wrapped = ""
        while heard:
            signs = "".join(self.signs[k] for k in heard)
            if signs.endswith("[]"):
                wrapped, heard = wrapped + "array of ", heard[:-2]
            elif signs.startswith("l<") and self.texts[heard[0]] == "Promise":
                wrapped, heard = wrapped + "promise of ", heard[2:-1]
            else:
                return wrapped + self._plain(signs, "".join(self.texts[k] for k in heard))
        return wrapped + "unknown"

    def _plain(self, signs: str, text: str) -> str:
        if signs == "a" and text in self.terms:
            self.used.add(text)
            return f"[{text}]"
        return WORDS.get(text, text) if signs == "k" else text

    def parts(self, what: str) -> str:
        """All names of a signature's parts, each with its type."""
        return ", ".join(f"{self.texts[m.start()]} ({self.spoken(*m.span(1))})" for m in _PARTS[what].finditer(self.signs))


def prose(tokens: list[Token], terms: dict[str, str] | None = None) -> str:
    """The sentence for a function's or a type's tokens, and definitions of the terms that it names."""
    read = Signature(tokens, terms or {})
    what = read.texts[read.signs.index("k")] if "k" in read.signs else None
    if what not in _PARTS:
        return ""
    told = read.parts(what)
    if what == "type":
        sentence = f"has fields: {told}." if told else ""
    else:
        closing = read.signs.rfind(")")
        result = read.spoken(closing + 1, len(tokens)) if closing >= 0 else "unknown"
        sentence = f"takes {told}. Returns {result}." if told else f"returns {result}."
    notes = [f"[{t}]: {read.terms[t]}" for t in sorted(read.used)]
    return "\n\n".join([sentence, "\n".join(notes)]) if notes else sentence


def prose_udf(terms: dict[str, str] | None = None):
    """A vectorized function of array<struct<text, kind>>."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda parts: prose([(p["text"], p["kind"]) for p in parts], terms) if parts is not None else "")

    return F.pandas_udf(run, "string")
