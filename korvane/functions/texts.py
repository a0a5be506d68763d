"""Text: token estimates, lossless chunks, sentences, readable text of HTML, tolerant JSON."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Scripts whose characters are about a token each.
CJK = "[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0002fa1f]"
_CJK = re.compile(CJK)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; at least the number of CJK characters. Null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.ceil(F.length(text) / 4), F.regexp_count(text, F.lit(CJK))).cast("long")


def tokens_of(text: str) -> int:
    """``token_estimate`` of one text."""
    return max(-(-len(text) // 4), len(_CJK.findall(text)))


def _within(text: str, budget: int) -> Iterator[str]:
    """Equal cuts of the text, as many as it has budgets of tokens; the last one has what is left over."""
    n = -(-tokens_of(text) // budget)
    width = len(text) // n
    return (text[i * width : (i + 1) * width if i < n - 1 else None] for i in range(n))


def chunks_of(text: str, budget: int) -> list[str]:
    """Chunks of about ``budget`` tokens that join to the text. They end where paragraphs do, or lines if there is only
    one paragraph; a paragraph or line over the budget is cut evenly, and two of its cuts are never one chunk. No chunk
    for empty text."""
    if tokens_of(text) <= budget:
        return [text] if text else []
    units = re.findall(r"(?s).+?(?:\n\n+|\Z)|\n+", text)
    if len(units) == 1:
        units = re.findall(r"[^\n]*\n+|[^\n]+", text)
    out = [""]
    for i, part in (p for u in units for p in enumerate(_within(u, budget) if tokens_of(u) > budget else [u])):
        if out[-1] and (i or tokens_of(out[-1] + part) > budget):
            out.append("")
        out[-1] += part
    return out


def chunks(text: Column, budget: int = 2000) -> Column:
    """``chunks_of`` as an array; no chunks for null and empty text."""

    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: chunks_of(t or "", budget))

    return run(text)


def sentences(text: Column) -> Column:
    """Sentences: cut after a terminator with its closing quotes before white space, and at blank lines."""
    parts = F.split(F.regexp_replace(text, r"([.!?…。！？][\"'”’)\]]*)\s+", "$1\u0001"), "\u0001|\\n\\s*\\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


#: Elements without readable text, and elements that stand on lines of their own.
HIDDEN = ("script", "style", "head", "noscript", "template")
BLOCKS = "p|div|br|li|ul|ol|dl|dt|dd|tr|td|th|h[1-6]|section|article|aside|main|nav|header|footer|table|blockquote|pre|form|hr|figure|figcaption"
#: A tag's attributes: quoted values may hold ">".
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def unescaped(text: Column) -> Column:
    """Character references resolved, all that HTML names and numeric ones; text without "&" stays in the JVM's hands
    until then and is not looked at."""
    import html

    @pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return run(text)


def html_text(page: Column) -> Column:
    """Readable text of a page: without comments, scripts, styles and tags, blocks on lines of their own, references
    resolved, blanks and empty lines closed up. Null is empty; an element that never ends hides the rest of the page."""
    out = F.coalesce(page, F.lit(""))
    out = F.regexp_replace(out, r"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>", " ")
    for name in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{name}\b{_ATTRIBUTES}>.*?(?:</{name}\s*>|\z)", " ")
    out = F.regexp_replace(out, rf"(?is)</?(?:{BLOCKS})\b{_ATTRIBUTES}>", "\n")
    out = F.regexp_replace(out, rf"(?is)</?[a-z]{_ATTRIBUTES}>", "")
    out = F.regexp_replace(unescaped(out), "[ \t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


#: A string literal of JSON or Python; what stands inside is never changed.
_STRING = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""", re.S)
#: Words of Python that JSON spells otherwise.
_WORDS = {"True": "true", "False": "false", "None": "null"}


def _between(text: str, pattern: str, by) -> str:
    """``text`` with a pattern replaced outside string literals only."""
    return "".join(part if i % 2 else re.sub(pattern, by, part) for i, part in enumerate(_STRING.split(text)))


def _spans(text: str) -> Iterator[str]:
    """Where an object or array may stand: the whole text, what a fence holds, from the first bracket to the last one of
    its kind."""
    yield text
    for fenced in re.findall(r"```(?:json)?\s*(.*?)```", text, re.S):
        yield fenced
    opened = re.search(r"[\[{]", text)
    if opened:
        yield text[opened.start() : text.rfind("}" if opened[0] == "{" else "]") + 1]


def _attempts(text: str) -> Iterator[str]:
    """The text, then with one slip after another mended as well: trailing commas, Python's words, bare keys, quotes."""
    yield text
    text = _between(text, r",(\s*[\]}])", r"\1")
    yield text
    text = _between(text, r"\b(True|False|None)\b", lambda m: _WORDS[m[1]])
    yield text
    text = _between(text, r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3')
    yield text
    yield text.replace("'", '"')


def _read(text: str) -> dict | list | None:
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text.strip())
        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(value, (dict, list)):
            return value
    return None


def repaired(text: str) -> str | None:
    """Canonical JSON of an object or array that a text holds, with the usual slips mended outside its string literals;
    None if there is none."""
    for span in _spans(text):
        for attempt in _attempts(span):
            value = _read(attempt)
            if value is not None:
                try:
                    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
                except (TypeError, ValueError):  # sets, bytes and NaN have no JSON
                    continue
    return None


def repair_json(text: Column) -> Column:
    @pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: repaired(t) if t is not None else None)

    return run(text)
