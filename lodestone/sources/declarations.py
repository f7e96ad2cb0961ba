"""A catalogue of the symbols that source files declare, found by their lines' beginnings.

Declarations at the top of a file, members of classes, and names in import and export lists are found. Names behind
re-exports or module settings of a compiler are not followed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import SYMBOL

VALUE, TYPE, SPACE = "value", "type", "namespace"
FORMS = [
    (re.compile(r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), "function", [VALUE]),
    (re.compile(r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), "class", [VALUE, TYPE]),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?const\s+enum\s+([A-Za-z_$][\w$]*)"), "enum", [VALUE, TYPE]),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?(const|let|var)\s+([A-Za-z_$][\w$]*)"), None, [VALUE]),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"), "interface", [TYPE]),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]"), "type", [TYPE]),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?enum\s+([A-Za-z_$][\w$]*)"), "enum", [VALUE, TYPE]),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([A-Za-z_$][\w$]*)"), "namespace", [VALUE, TYPE, SPACE]),
]
MEMBER = re.compile(r"^\s+(?:(?:public|private|protected|static|readonly|async|override|abstract|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(\(|[:=;?!])")
LIST = re.compile(r"^(import|export)\s+(?:type\s+)?(?:[A-Za-z_$][\w$]*\s*,\s*)?\{([^}]*)\}")
WORDS = {"if", "for", "while", "switch", "return", "catch", "throw", "new", "else", "do", "try", "case", "await", "typeof", "super", "constructor"}


def scan(file: str, content: str) -> list[tuple]:
    """Rows (file, symbol, kind, namespaces, line, column). Overloads of a function are one."""
    out: dict[tuple, tuple] = {}
    clean = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)
    inside = 0
    for n, line in enumerate(clean.split("\n"), 1):
        line = re.sub(r"//.*$", "", line)
        for form, kind, spaces in FORMS:
            if m := form.match(line):
                name = m[m.lastindex]
                out.setdefault((name, kind or m[1]), (file, name, kind or m[1], spaces, n, m.start(m.lastindex) + 1))
                inside = n if kind in ("class", "interface") else 0
                break
        else:
            if m := LIST.match(line):
                for item in filter(None, (x.strip() for x in m[2].split(","))):
                    name = re.split(r"\s+as\s+", item.removeprefix("type "))[-1].strip()
                    out.setdefault((name, m[1]), (file, name, m[1], [VALUE, TYPE], n, line.find(name) + 1))
            elif line.startswith("}"):
                inside = 0
            elif inside and (m := MEMBER.match(line)) and m[1] not in WORDS and len(line) - len(line.lstrip()) <= 4:
                kind = "method" if m[2] == "(" else "property"
                out.setdefault((m[1], kind), (file, m[1], kind, [VALUE], n, m.start(1) + 1))
    return list(out.values())


def scanned(files: DataFrame) -> DataFrame:
    """The symbols of source files (file, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [r for n, c in zip(rows["file"], rows["content"]) for r in scan(n, c)]
            yield pd.DataFrame(found, columns=["file", "symbol", "kind", "namespaces", "line", "column"])

    return files.select("file", "content").mapInPandas(parse, SYMBOL)


def catalogue(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The symbols of these files, relative to the root, that exist."""
    base = Path(root)
    known = [n for n in names if (base / n).resolve().is_relative_to(base.resolve()) and (base / n).is_file()]
    return scanned(spark.createDataFrame([(n, (base / n).read_text(errors="replace")) for n in known], "file string, content string"))
