"""Writers: every one distributed but the few-row reports, which the driver writes."""

from __future__ import annotations

import datetime
import json
import os
import shutil

from pyspark.sql import DataFrame, functions as F


def run_label(at: datetime.datetime | None = None) -> str:
    return (at or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")


def write_csv(df: DataFrame, folder: str, label: str | None = None) -> str:
    """CSV with a header under folder/<label>; a folder that ends in a file name gives its parent."""
    base = os.path.dirname(folder) if os.path.splitext(folder)[1] else folder
    path = f"{base.rstrip('/')}/{label or run_label()}"
    df.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    return path


def write_summary(df: DataFrame, path: str) -> dict:
    """The one row of df as a JSON object; NaN becomes null."""
    row = {k: (None if isinstance(v, float) and v != v else v) for k, v in df.limit(2).collect()[0].asDict().items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, ensure_ascii=False)
    return row


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_pairs(nested: DataFrame, path: str) -> None:
    """The nested comparisons under path/nested, and one row per output under path/flat."""
    nested.write.json(f"{path}/nested")
    nested.select("id", "prompt", F.inline("outputs")).write.json(f"{path}/flat")


def write_json_array(df: DataFrame, path: str) -> int:
    """One file with the rows of df as a JSON array, in their order, streamed through the driver row by row; the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write(("[\n" if n == 0 else ",\n") + row["j"])
            n += 1
        f.write("[]" if n == 0 else "\n]")
    return n


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_file(text: str, path: str) -> None:
    """The file at path replaced in one step: readers see the old bytes or the new ones; the old ones stay as path.bak."""
    staged = f"{path}.tmp"
    with open(staged, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    if os.path.exists(path):
        shutil.copy2(path, f"{path}.bak")
    os.replace(staged, path)


def replace_table(df: DataFrame, path: str) -> None:
    """df as the table at path, which names its current version by a link, so that it is replaced in one step and there
    is a table at any time; the version before stays as path.bak. Local paths; a plain folder at path becomes a version."""
    base, name = os.path.split(path.rstrip("/"))
    versions = os.path.join(base, f".{name}.versions")
    os.makedirs(versions, exist_ok=True)
    staged = os.path.join(versions, f"{run_label()}-{os.getpid()}-{len(os.listdir(versions))}")
    df.write.parquet(staged)
    if os.path.isdir(path) and not os.path.islink(path):
        os.replace(path, os.path.join(versions, "first"))
        os.symlink(os.path.join(versions, "first"), path)
    before = os.path.realpath(path) if os.path.islink(path) else None
    _point(path, staged)
    if before:
        if os.path.isdir(f"{path}.bak") and not os.path.islink(f"{path}.bak"):
            shutil.rmtree(f"{path}.bak")
        _point(f"{path}.bak", before)
        for old in os.listdir(versions):
            if os.path.join(versions, old) not in (staged, before):
                shutil.rmtree(os.path.join(versions, old), ignore_errors=True)


def _point(link: str, to: str) -> None:
    os.symlink(to, f"{link}.tmp")
    os.replace(f"{link}.tmp", link)


def write_report(df: DataFrame, path: str, name: str = "token_distribution_shift") -> None:
    """Lines "name a->b: value" of rows (a, b, value)."""
    df.select(F.format_string(f"{name} %s->%s: %.6f", "a", "b", "value").alias("value")).write.mode("overwrite").text(path)
