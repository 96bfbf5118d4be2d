"""Writers for the edges of the pipeline; stages among themselves use Parquet."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, append: bool = False) -> None:
    """JSON lines, Unicode as it is; null fields are left out."""
    w = df.write.mode("append" if append else "overwrite")
    (w.option("compression", "gzip") if gzip else w).json(path)


def write_json_map(df: DataFrame, path: str, key: str) -> None:
    """One JSON object of the rows by their key, for small results; rows come to the driver one partition at a time."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for i, r in enumerate(df.toLocalIterator()):
            row = r.asDict(recursive=True)
            f.write((", " if i else "") + json.dumps(str(row.pop(key)), ensure_ascii=False) + ": " + json.dumps(row, ensure_ascii=False, default=str))
        f.write("}")


def write_csv_stats(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for profiles, which have a row for each group."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def stats_path(output: str, suffix: str = "_stats") -> str:
    """Where the profile of an output belongs: beside it."""
    return re.sub(r"(\.jsonl)?(\.gz)?/?$", "", output) + suffix


def write_report(df: DataFrame, path: str, indent: int = 2) -> None:
    """All rows as one indented JSON list; they come to the driver one partition at a time and are written as they come."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        some = False
        for r in df.toLocalIterator():
            text = json.dumps(r.asDict(recursive=True), indent=indent, ensure_ascii=False, default=str)
            f.write((",\n" if some else "\n") + re.sub(r"(?m)^", " " * indent, text))
            some = True
        f.write("\n]" if some else "]")


def print_report(df: DataFrame, to: IO[str], title: str = "") -> int:
    """A profile as aligned columns, and how many rows it has."""
    rows = [[str(x) for x in r] for r in df.toLocalIterator()]
    width = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    for line in ([[title]] if title else []) + [df.columns, *rows]:
        to.write("  ".join(x.ljust(w) for x, w in zip(line, width)).rstrip() + "\n" if len(line) > 1 or line is df.columns else line[0] + "\n")
    return len(rows)
