"""Cells and outputs of notebooks kept as text: marked cells, percent scripts, notebook JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_MARK = re.compile(r"^=== (text|code|output)\b[^\n]*===[ \t]*\r?$", re.M)
_PERCENT = re.compile(r"^# (?:%%|Out\[)[^\n]*$", re.M)


def cells(text: str | None, form: str | None) -> Iterator[tuple[str, str]]:
    """(kind, content) of every cell and every output, kind being text, code or output.

    A null or empty text has none. What isn't of the form claimed is one cell of kind text, whole.
    """
    if not text or not text.strip():
        return
    if form == "ipynb" or (form not in ("cells", "percent") and text.lstrip().startswith("{")):
        try:
            book = json.loads(text)
            parts = book["cells"]
        except (ValueError, KeyError, TypeError, RecursionError):
            yield "text", text
            return
        for c in parts if isinstance(parts, list) else []:
            if isinstance(c, dict):
                yield ("code" if c.get("cell_type") == "code" else "text"), _joined(c.get("source"))
                for out in c.get("outputs") or []:
                    yield from (("output", t) for t in _output(out) if t)
    elif form == "percent":
        yield from _percent(text)
    else:
        marks = list(_MARK.finditer(text))
        if not marks:
            yield "text", text
            return
        if head := text[: marks[0].start()].strip():
            yield "text", head
        for m, end in zip(marks, [*(n.start() for n in marks[1:]), len(text)]):
            yield m[1], text[m.end() : end]


def _percent(text: str) -> Iterator[tuple[str, str]]:
    marks = list(_PERCENT.finditer(text))
    if not marks:
        yield "text", text
        return
    if head := text[: marks[0].start()].strip():
        yield "text", head
    for m, end in zip(marks, [*(n.start() for n in marks[1:]), len(text)]):
        body, line = text[m.end() : end], m[0]
        if line.startswith("# Out["):
            yield "output", re.sub(r"^#> ?", "", body, flags=re.M)
        elif "[markdown]" in line or "[md]" in line:
            yield "text", re.sub(r"^# ?", "", body, flags=re.M)
        else:
            yield "code", body


def _joined(source: object) -> str:
    if isinstance(source, str):
        return source
    return "".join(s for s in source if isinstance(s, str)) if isinstance(source, list) else ""


def _lines(source: object) -> str:
    """Lines of an output: joined by line breaks where they don't end in one."""
    if isinstance(source, list):
        return "".join(s if s.endswith("\n") else s + "\n" for s in source if isinstance(s, str))
    return source if isinstance(source, str) else ""


def _output(out: object) -> Iterator[str]:
    if not isinstance(out, dict):
        return
    for key in ("text", "traceback"):
        if key in out:
            yield _lines(out[key])
    data = out.get("data")
    for value in data.values() if isinstance(data, dict) else []:
        yield _lines(value)
