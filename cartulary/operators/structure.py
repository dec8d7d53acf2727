"""Turning plain documents into control items, by the first tier that finds some."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import REQUIREMENT_WORDS, has_any, trim_all

ITEMS = "doc_id string, position int, id string, title string, text string, class string, parent_id string, props map<string,string>"
_COLUMNS = ["doc_id", "position", "id", "title", "text", "class", "parent_id", "props"]

#: How numbered lines begin, in order of precedence.
LINE_PATTERNS = (
    r"^\d+\.\d+", r"^[A-Z]\.\d+", r"^Article\s+\d+", r"^Section\s+\d+", r"^Rule\s+\d+", r"^§\s*\d+", r"^\([a-z]\)",
    r"^\(\d+\)", r"^[ivxlcdm]+\.", r"^[a-z]\.", r"^[A-Z]\.", r"^\d+\.",
)

#: Labels of clauses, in order of precedence, and how many words a clause must have.
CLAUSES = (
    (r"^\s*\(([a-zA-Z]{1,3}|\d+)\)\s+(.+)$", 0),
    (r"^\s*(\d{1,4})\.\s+(.+)$", 8),
    (r"^\s*(xiii|xii|xi|viii|vii|vi|iv|iii|ii|ix|x|v|i)\.\s+(.+)$", 8),
    (r"^\s*([a-z])\.\s+(.+)$", 8),
    (r"^\s*([A-Z])\.\s+(.+)$", 8),
)
_CLAUSES = [(re.compile(p, re.ASCII), n) for p, n in CLAUSES]


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, id, text) of blank-line separated paragraphs; ordinals count empty ones too."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\n")).alias("pos", "raw"))
    return split.select("doc_id", F.concat(F.lit("para-"), F.col("pos") + 1).alias("id"), trim_all(F.col("raw")).alias("text")).where("text <> ''")


def pattern_items(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """(doc_id, pattern, pos, id, text): lines that match the first pattern with at least ``least`` matching lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), trim_all), lambda x: x != "")
    fits = lambda p: lambda x: x.rlike(p)
    matching = [F.struct(F.lit(i).alias("pattern"), F.filter(lines, fits(p)).alias("lines")) for i, p in enumerate(LINE_PATTERNS)]
    first = F.get(F.filter(F.array(*matching), lambda x: F.size(x["lines"]) >= least), F.lit(0))
    found = docs.select("doc_id", first.alias("m")).where("m is not null").select("doc_id", "m.pattern", F.posexplode("m.lines").alias("pos", "text"))
    name = F.lit(None).cast("string")
    for i, p in enumerate(LINE_PATTERNS):
        name = F.when(F.col("pattern") == i, F.regexp_extract("text", f"({p})", 1)).otherwise(name)
    return found.select("doc_id", "pattern", "pos", trim_all(name).alias("id"), "text")


def heading_items(sections: DataFrame, most: int = 3) -> DataFrame:
    """Sections (doc_id, pos, title, text) whose exact title occurs at most ``most`` times; ids keep the ordinal."""
    n = F.count("*").over(Window.partitionBy("doc_id", "title"))
    kept = sections.withColumn("_n", n).where(F.col("_n") <= (most if most > 0 else 3))
    return kept.select("doc_id", F.concat(F.lit("sec-"), F.col("pos") + 1).alias("id"), "title", "text")


def table_items(tables: DataFrame) -> DataFrame:
    """Rows of tables (doc_id, rows array<array<string>>) with any cells: the first cell without blanks around it is the
    id if it has 1 to 49 bytes, else the row's number among them; the text has all cells as they are."""
    return tables.select("doc_id", F.inline(_table_tier(F.col("rows")))).select("doc_id", "id", "text")


def required_items(items: DataFrame, vocabulary: tuple[str, ...] = REQUIREMENT_WORDS) -> DataFrame:
    """Items with a word of obligation in text or title; a document where none has one keeps all."""
    hit = has_any(F.col("text"), vocabulary) | has_any(F.col("title"), vocabulary)
    flagged = items.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(Window.partitionBy("doc_id")))
    return flagged.where("_hit or not _any").drop("_hit", "_any")


def clauses(text: str, pattern: re.Pattern, least: int) -> list[tuple[str, str]]:
    """(label, text) of labelled clauses with the lines that go on from them; what stands before the first is dropped."""
    found: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        m = pattern.match(line)
        if m:
            found.append((m[1], [m[2]]))
        elif found:
            found[-1][1].append(line)
    joined = [(label, "\n".join(lines).strip()) for label, lines in found]
    return [(label, t) for label, t in joined if t and len(t.split()) >= least]


def decompose(base: str, text: str, min_words: int = 40) -> list[dict]:
    """A text's clauses as items below ``base``; a clause that decomposes further is a section, and all rows below it
    name it as their parent. A short text, or one without two clauses of a kind, is one requirement."""
    if len(text.split()) >= min_words:
        for pattern, least in _CLAUSES:
            found = clauses(text, pattern, least)
            if len(found) < 2:
                continue
            out = []
            for label, own in found:
                name = f"{base}.{label}"
                below = decompose(name, own, min_words)
                kind = "section" if len(below) > 1 else "requirement"
                out.append({"id": name, "title": "", "text": own, "class": kind, "parent_id": "", "props": {"label": label}})
                if len(below) > 1:
                    out += [b | {"parent_id": name, "props": b["props"] | {"parent-id": name}} for b in below]
            return out
    return [{"id": base, "title": "", "text": text.strip(), "class": "requirement", "parent_id": "", "props": {}}]


def decomposed(items: DataFrame, min_words: int = 40) -> DataFrame:
    """The clauses (ITEMS) of items (doc_id, id, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, base, text in zip(batch["doc_id"], batch["id"], batch["text"], strict=True):
                rows += [{"doc_id": doc, "position": i, **r} for i, r in enumerate(decompose(base, text or "", min_words if min_words > 0 else 40))]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return items.select(F.col("doc_id").cast("string"), "id", "text").mapInPandas(run, ITEMS)


def chunks(text: str, most: int) -> list[str]:
    """Whole lines packed into pieces of at most ``most`` bytes; a longer line is a piece of its own."""
    out: list[list[str]] = []
    size = 0
    for line in text.split("\n"):
        n = len(line.encode()) + 1
        if out and size + n <= most:
            out[-1].append(line)
            size += n
        else:
            out.append([line])
            size = n
    return ["\n".join(x) for x in out]


#: Bytes of text that a worker makes rows of at a time.
PART_BYTES = 4 << 20


def _chunk_batches(batches, most: int):
    """Arrow batches of (doc_id, pos, chunk): a batch's texts are taken one by one, and chunks leave as soon as they are
    ``PART_BYTES``, so that neither all texts of a batch nor all their chunks are Python objects at once."""
    names = ["doc_id", "pos", "chunk"]
    types = [pa.string(), pa.int32(), pa.string()]
    made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    for batch in batches:
        rows, size = ([], [], []), 0
        for doc, text in zip(*batch.columns, strict=True):
            doc = doc.as_py()
            for i, chunk in enumerate(chunks(text.as_py() or "", most)):
                for column, value in zip(rows, (doc, i, chunk), strict=True):
                    column.append(value)
                size += len(chunk) + 64
                if size >= PART_BYTES:
                    yield made(rows)
                    rows, size = ([], [], []), 0
        yield made(rows)


def chunked(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """(doc_id, pos, chunk) of every document."""
    return docs.select(F.col("doc_id").cast("string"), text).mapInArrow(lambda batches: _chunk_batches(batches, most), "doc_id string, pos int, chunk string")


def regex_items(text: str, pattern: str) -> list[dict]:
    """One item a match: two groups are id and text, one is text, none is the whole match."""
    if len(pattern) > 512:
        raise ValueError("the pattern is too long")
    out = []
    for i, m in enumerate(re.finditer(pattern, text, re.MULTILINE), 1):
        groups = m.groups()
        name, body = (groups[0], groups[1]) if len(groups) >= 2 else (f"item-{i}", groups[0] if groups else m[0])
        if (body or "").strip():
            out.append({"id": (name or f"item-{i}").strip(), "title": "", "text": body.strip(), "class": "requirement", "parent_id": "", "props": {}})
    return out


#: prompt -> response; a deployment passes a client, tests a stub.
Completer = Callable[[str], str]


def detected_items(text: str, complete: Completer) -> list[dict]:
    """Items by a pattern that a model proposes for the first 3000 bytes."""
    try:
        return regex_items(text, complete("pattern:" + text.encode()[:3000].decode("utf-8", "ignore")).strip())
    except (re.error, ValueError):
        return []


def extracted_items(text: str, complete: Completer, chunk_bytes: int = 8000) -> list[dict]:
    """Items that a model lists as JSON, chunk by chunk, 500 of each at most; a chunk that cannot be read is skipped."""
    out = []
    for chunk in chunks(text, chunk_bytes):
        try:
            found = json.loads(complete("items:" + chunk))
        except ValueError:
            continue
        for r in found[:500] if isinstance(found, list) else []:
            if isinstance(r, dict) and str(r.get("text") or "").strip():
                out.append({"id": str(r.get("id") or ""), "title": str(r.get("title") or ""), "text": str(r["text"]), "class": "requirement", "parent_id": "", "props": {}})
    return out


_ITEM = "array<struct<id:string,title:string,text:string>>"


def _items(array: Column, make: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """An array of items made of each element and its position; null where there is none."""
    made = F.transform(array, lambda x, i: F.struct(*[c.cast("string").alias(n) for n, c in zip(("id", "title", "text"), make(x, i), strict=True)]))
    return made.cast(_ITEM)


def _some(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def _heading_tier(sections: Column, most: int) -> Column:
    """Sections are sorted by title, so one with a title that occurs too often is within ``most`` places of two equal
    titles that are ``most`` places apart: no section is compared with all others."""
    most = most if most > 0 else 3
    key = lambda x: F.coalesce(F.concat(F.lit("="), x["title"]), F.lit(""))  # noqa: E731  a null title is one of its own
    placed = F.transform(sections, lambda x, i: F.struct(key(x).alias("key"), (i + 1).alias("at"), x["title"].alias("title"), x["text"].alias("text")))

    def few(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce((F.get(ordered, j)["key"] == x["key"]) & (F.get(ordered, j + most)["key"] == x["key"]), F.lit(False))
        return F.filter(ordered, lambda x, i: ~F.exists(F.sequence(F.greatest(i - most, F.lit(0)), i), lambda j: same(x, j)))

    kept = F.get(F.transform(F.array(F.sort_array(placed)), few), F.lit(0))  # sorted once, not for each section
    back = F.sort_array(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["title"].alias("title"), x["text"].alias("text"))))
    return _items(back, lambda x, i: (F.concat(F.lit("sec-"), x["at"].cast("string")), x["title"], x["text"]))


def _table_tier(rows: Column) -> Column:
    cells = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))), lambda r: F.size(r) > 0)
    first = lambda r: trim_all(F.get(r, F.lit(0)))
    name = lambda r, i: F.when(F.octet_length(first(r)).between(1, 49), first(r)).otherwise(F.concat(F.lit("tbl-"), (i + 1).cast("string")))
    return _items(cells, lambda r, i: (name(r, i), F.lit(""), F.array_join(r, " | ")))


def _pattern_tier(text: Column, least: int = 3) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != "")

    def tier(pattern: str) -> Column:
        hits = F.filter(lines, lambda x: x.rlike(pattern))
        made = _items(hits, lambda x, i: (trim_all(F.regexp_extract(x, f"({pattern})", 1)), F.lit(""), x))
        return F.when(F.size(hits) >= least, made)

    return F.coalesce(*map(tier, LINE_PATTERNS))


def _paragraph_tier(text: Column) -> Column:
    made = _items(F.split(text, r"\n\n"), lambda x, i: (F.concat(F.lit("para-"), (i + 1).cast("string")), F.lit(""), trim_all(x)))
    return F.filter(made, lambda x: x["text"] != "")


def structured(
    docs: DataFrame, pattern: str | None = None, complete: Completer | None = None, keywords: bool = False, min_words: int | None = None, heading_repeats: int = 3
) -> DataFrame:
    """Items (ITEMS) of plain documents, by the first tier that finds some: ``pattern``, headings, tables, numbered
    lines, a pattern that a model proposes, items that a model lists, paragraphs.

    ``docs`` has doc_id and text, and may have sections (array of structs of title and text) and rows (array of arrays
    of strings), the headings and tables that were found in a document. A null text is empty. Only the tiers that take
    a pattern or a model need Python; the others are columns.
    """
    d = docs.select(
        F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"),
        (_heading_tier(F.col("sections"), heading_repeats) if "sections" in docs.columns else F.lit(None).cast(_ITEM)).alias("_heading"),
        (_table_tier(F.col("rows")) if "rows" in docs.columns else F.lit(None).cast(_ITEM)).alias("_table"),
    )

    def by_python(df: DataFrame, name: str, find: Callable[[str], list[dict]], wanted: Column) -> DataFrame:
        """Adds an array of what ``find`` makes of the texts that are still wanted."""
        short = lambda items: [{k: r[k] for k in ("id", "title", "text")} for r in items]

        @F.pandas_udf(_ITEM)
        def found(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else short(find(t)))

        return df.withColumn(name, found(F.when(wanted, F.col("text"))))

    earlier = [F.col("_heading"), F.col("_table")]
    if pattern:
        d = by_python(d, "_regex", lambda t: regex_items(t, pattern), F.lit(True))
        earlier.insert(0, F.col("_regex"))
    d = d.withColumn("_first", F.coalesce(*map(_some, earlier), _pattern_tier(F.col("text"))))
    if complete:
        d = by_python(d, "_model", lambda t: detected_items(t, complete) or extracted_items(t, complete), F.col("_first").isNull())
        d = d.withColumn("_first", F.coalesce("_first", _some(F.col("_model"))))
    all_items = d.select("doc_id", F.posexplode(F.coalesce("_first", _paragraph_tier(F.col("text")))).alias("position", "_item"))
    blank = F.create_map().cast("map<string,string>")
    items = all_items.select("doc_id", "position", "_item.*", F.lit("requirement").alias("class"), F.lit("").alias("parent_id"), blank.alias("props"))
    if keywords:
        items = required_items(items)
    return decomposed(items, min_words) if min_words is not None else items


def sections(text: Column) -> Column:
    """array<struct<title,text>> of a text with # headings."""
    parts = F.filter(F.split(text, r"(?m)^#+[ \t]+"), lambda x: trim_all(x) != "")
    return F.transform(parts, lambda x: F.struct(trim_all(F.substring_index(x, "\n", 1)).alias("title"), trim_all(F.regexp_replace(x, r"^[^\n]*\n?", "")).alias("text")))
