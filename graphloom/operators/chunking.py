"""Splitting documents into chunks: one row in, many rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import bind

SIZE, OVERLAP = 500, 100
#: Characters of chunks that a Python task holds before it sends them on.
SENT = 1 << 20


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be smaller than the chunk size {size}")


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sliding windows at 0, size - overlap, ... while the start is inside the text; ``keep`` names columns to carry on."""
    _check(size, overlap)
    text = docs.where(F.trim(text_col) != "").select(id_col, *keep, F.col(text_col).alias("_text"))
    starts = text.select(id_col, *keep, "_text", F.posexplode(F.sequence(F.lit(0), F.length("_text") - 1, F.lit(size - overlap))).alias("idx", "start_char"))
    return starts.select(id_col, *keep, "idx", "start_char", F.col("_text").substr(F.col("start_char") + 1, F.lit(size)).alias("chunk"))


#: What Python's strip takes off, of ASCII.
_BLANK = " \t\n\r\x0b\x0c"


def paragraphs(docs: DataFrame, separator: str = r"\n\s*\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One chunk per non-blank paragraph, stripped; indices count the paragraphs that are kept."""
    parts = F.filter(F.transform(F.split(text_col, separator), lambda p: F.btrim(p, F.lit(_BLANK))), lambda p: p != "")
    return docs.select(id_col, F.posexplode(parts).alias("idx", "chunk"))


def paragraph_offsets(docs: DataFrame, separator: str = r"\n\s*\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs with the places where they stand in the text: start_char up to end_char, half-open.

    A part starts after the parts and separators before it, summed up in a window over the document."""
    cut = F.arrays_zip(F.split(text_col, separator).alias("p"), F.regexp_extract_all(text_col, F.lit(separator), F.lit(0)).alias("s"))
    rows = docs.select(id_col, F.posexplode(cut).alias("_n", "c")).select(id_col, "_n", F.col("c.p").alias("_p"), F.length(F.coalesce("c.s", F.lit(""))).alias("_s"))
    order = Window.partitionBy(id_col).orderBy("_n")
    begun = F.coalesce(F.sum(F.length("_p") + F.col("_s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = begun + F.length("_p") - F.length(F.ltrim("_p", F.lit(_BLANK)))
    placed = rows.withColumns({"chunk": F.btrim("_p", F.lit(_BLANK)), "start_char": start.cast("int")}).where("chunk <> ''")
    return placed.select(id_col, (F.row_number().over(order) - 1).alias("idx"), "chunk", "start_char", (F.col("start_char") + F.length("chunk")).alias("end_char"))


def _fixed(text: str, size: int, overlap: int) -> list[str]:
    out, current = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not part:
            continue
        if len(part) > size:
            if current:
                out.append(current)
            current = ""
            out += [part[i : i + size] for i in range(0, len(part), size - overlap)]
        elif not current:
            current = part
        elif len(current) + len(part) + 1 <= size:
            current += "\n\n" + part
        else:
            out.append(current)
            current = part
    return out + [current] if current else out


#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "!", "？", "?", " ")


def _recursive(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    """Pieces of at most ``size`` characters, white space inside them kept; separators at their ends are lost."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if level == len(SEPARATORS):
        return [text[i : i + size] for i in range(0, len(text), size - overlap)]
    mark, out, current = SEPARATORS[level], [], ""
    for part in text.split(mark):
        joined = current + mark + part if current else part
        if len(joined) <= size:
            current = joined
            continue
        if current.strip():
            out.append(current)
        current = ""
        if len(part) > size:
            out += _recursive(part, size, overlap, level + 1)
        else:
            current = part
    return out + [current] if current.strip() else out


#: What a heading looks like, in the order of trial, and the level of each.
_HEADINGS = (
    (re.compile(r"^(#{1,6})\s+(.*)$"), lambda m: len(m[1])),
    (re.compile(r"^(\d+(\.\d+)*)\s+(.*)$"), lambda m: m[1].count(".") + 1),
    (re.compile(r"^([一二三四五六七八九十]+)、(.*)$"), lambda m: 2),
    (re.compile(r"^第([一二三四五六七八九十百]+)[章节规回](.*)$"), lambda m: 1),
)


def heading_level(line: str) -> int:
    """1 to 6, deeper numbers count as 6; 0 for what is no heading."""
    return next((min(6, level(m)) for pattern, level in _HEADINGS if (m := pattern.match(line))), 0)


def _hierarchical(text: str, target: int) -> list[tuple[str, list[str]]]:
    """(chunk, heading path) under each heading of the target level, or of the shallowest one if that is missing."""
    lines = [(heading_level(x), x) for x in text.split("\n")]
    present = sorted({level for level, _ in lines if level})
    if not present:
        return [(text.strip(), [])] if text.strip() else []
    target = target if target in present else present[0]
    out, parents, body, path = [], {}, None, []
    for level, line in lines:
        if level:
            parents = {k: v for k, v in parents.items() if k < level} | {level: line.lstrip("#").strip()}
        if level and level <= target:
            if body:
                out.append(("\n".join([*path[:-1], *body]).strip(), path))
            body, path = ([line], [parents[k] for k in sorted(parents)]) if level == target else (None, [])
        elif body is not None:
            body.append(line)
    if body:
        out.append(("\n".join([*path[:-1], *body]).strip(), path))
    return out


def split_documents(docs: DataFrame, method: str = "fixed_length", size: int = SIZE, overlap: int = OVERLAP, level: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dispatch by method: paragraph and sliding_window natively, packing methods row by row; unknown is fixed_length."""
    _check(size, overlap)
    if method == "sliding_window":
        found = windows(docs, size, overlap, id_col, text_col)
        return found.select(id_col, "idx", "chunk", F.array().cast("array<string>").alias("heading_path"))
    if method == "paragraph":
        return paragraphs(docs, id_col=id_col, text_col=text_col).withColumn("heading_path", F.array().cast("array<string>"))
    cut = {"recursive_character": lambda t: [(c, []) for c in _recursive(t, size, overlap)], "hierarchical": lambda t: _hierarchical(t, level)}.get(method, lambda t: [(c, []) for c in _fixed(t, size, overlap)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts become Python's one at a time, and chunks leave after ``SENT`` characters: memory does not grow with a batch."""
        for batch in batches:
            ids, texts, at, rows, held = batch.column(0), batch.column(1), [], [], 0
            for i in range(batch.num_rows):
                for n, (chunk, path) in enumerate(cut(texts[i].as_py() or "")):
                    at.append(i)
                    rows.append((n, chunk, path))
                    held += len(chunk)
                if held >= SENT or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *map(pa.array, ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]), (pa.int32(), texts.type, pa.list_(texts.type)))], names=[id_col, "idx", "chunk", "heading_path"])
                    at, rows, held = [], [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, idx int, chunk string, heading_path array<string>")


def heading_paths(lines: DataFrame) -> DataFrame:
    """lines: doc, line_no, level, title -> the open headings above each line, by levels below it; no Python."""
    opened = F.aggregate(
        F.expr("history"),
        F.array().cast("array<struct<level:int,title:string>>"),
        lambda path, h: F.concat(F.filter(path, lambda p: p["level"] < h["level"]), F.array(h)),
    )
    return lines.withColumn("path", bind(opened, lambda p: F.transform(p, lambda x: x["title"])))
