"""Control catalogs as nested JSON: reading them into rows, and writing rows back as a catalog.

A catalog nests groups, controls and parts to any depth, so a document is flattened by a Python function in one narrow
step; everything behind it is DataFrame work.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartulary.sources import schemas

ITEM = "id string, title string, text string, class string, parent_id string, group_id string, props map<string,string>"
ITEM_COLUMNS = ["id", "title", "text", "class", "parent_id", "group_id", "props"]
VERSION = "1.1.3"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").cast("string").alias("content"))


def is_catalog(content: Column) -> Column:
    """Whether a text is a JSON object with the key catalog."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.when(F.try_parse_json(content).isNotNull(), content)), "catalog"), F.lit(False))


def walk(catalog: dict) -> Iterator[tuple[dict, str, int]]:
    """(control, group id, depth): a catalog's own controls, then those of each group, then its nested groups."""
    work: list[tuple[str, dict, str, int]] = [("group", {"controls": catalog.get("controls") or [], "groups": catalog.get("groups") or []}, "", 0)]
    while work:
        kind, node, group, depth = work.pop()
        if kind == "control":
            yield node, group, depth
            work += [("control", c, group, depth + 1) for c in reversed(node.get("controls") or [])]
        else:
            own = node.get("id") or group
            work += [("group", g, own, 0) for g in reversed(node.get("groups") or [])]
            work += [("control", c, own, 0) for c in reversed(node.get("controls") or [])]


def params_of(catalog: dict, control: dict) -> dict[str, str]:
    """Parameter id to label, else first value; a control's own win, blank ones are left out."""
    out = {}
    for param in [*(catalog.get("params") or []), *(control.get("params") or [])]:
        value = param.get("label") or next(iter(param.get("values") or []), "")
        if param.get("id") and value.strip():
            out[param["id"]] = value
    return out


def clean_prose(text: str, params: dict[str, str]) -> str:
    """The row form of functions.text.resolved_prose."""

    def value(mark: re.Match) -> str:
        name = re.search(r"insert:\s*param,\s*([\w\-.]+)", mark[0])
        return params.get(name[1], f"[{name[1]}]") if name else "[parameter]"

    return re.sub(r"\{\{.*?\}\}", value, text or "")


def _prose(part: dict) -> str:
    return "\n".join(x for x in [part.get("prose") or "", *(_prose(p) for p in part.get("parts") or [])] if x)


def _items(part: dict) -> list[dict]:
    return [p for p in part.get("parts") or [] if p.get("name") == "item"]


def child_id(parent: str, part: dict, index: int) -> str:
    """A part's id without its statement mark; else, unless it extends the parent's, the parent's and an ordinal."""
    own = part.get("id") or ""
    for mark in ("_smt.", "_stmt."):
        if mark in own:
            return own.replace(mark, ".", 1)
    return own if own.startswith(f"{parent}.") else f"{parent}.{index + 1}"


def decomposed(control: dict, group: str, params: dict[str, str], parent: str = "") -> list[dict]:
    """A control's statement as rows: with items a section and its children, two levels deep; else one requirement."""

    def row(i, title, text, kind, above, source=None) -> dict:
        props = {"parent-id": above, "source-part": source} if source is not None else {}
        return dict(zip(ITEM_COLUMNS, (i, title, clean_prose(text, params), kind, above, group, props), strict=True))

    statement = next((p for p in control.get("parts") or [] if p.get("name") == "statement"), None)
    name, title = control.get("id") or "", control.get("title") or ""
    if statement is None:
        return [row(name, title, "\n".join(filter(None, map(_prose, control.get("parts") or []))), "requirement", parent)]
    items = _items(statement)
    out = [row(name, title, statement.get("prose") or "", "section" if items else "requirement", parent)]
    for i, item in enumerate(items):
        below, own = _items(item), child_id(name, item, i)
        out.append(row(own, "", item.get("prose") or "", "section" if below else "requirement", name, item.get("id") or ""))
        out += [row(child_id(own, sub, k), "", sub.get("prose") or "", "requirement", own, sub.get("id") or "") for k, sub in enumerate(below)]
    return out


def parsed(content: str, decompose: bool = True) -> list[dict]:
    """All rows of a catalog document; ValueError without a catalog or without controls."""
    document = json.loads(content)
    if not isinstance(document, dict) or not isinstance(document.get("catalog"), dict):
        raise ValueError("invalid format: no catalog")
    catalog, out = document["catalog"], []
    for control, group, _ in walk(catalog):
        params = params_of(catalog, control)
        if decompose:
            out += decomposed(control, group, params)
        else:
            text = "\n".join(_prose(p) for p in control.get("parts") or [] if p.get("name") == "statement")
            out.append(dict(zip(ITEM_COLUMNS, (control.get("id") or "", control.get("title") or "", clean_prose(text, params), control.get("class") or "", "", group, {}), strict=True)))
    if not out:
        raise ValueError("the catalog has no controls")
    return out


def flatten(documents: DataFrame, decompose: bool = True, schema: str | None = None) -> DataFrame:
    """Rows (path, position, ITEM, error) of documents (path, content). One that is no catalog gives one row with the
    error and no item, so a bad document does not end the import of the others. With a JSON Schema (its text), one that
    does not fit gives the first of its faults as the error."""
    if schema is not None:
        schemas.ready(schema)  # one that cannot be used is an error at once

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if schema is not None:
                        schemas.ready(schema).require(json.loads(content))
                    rows += [{"path": path, "position": i, "error": None, **r} for i, r in enumerate(parsed(content, decompose))]
                except ValueError as e:
                    rows.append({"path": path, "position": 0, "error": str(e)[:200]} | dict.fromkeys(ITEM_COLUMNS))
            yield pd.DataFrame(rows, columns=["path", "position", *ITEM_COLUMNS, "error"])

    return documents.select("path", "content").mapInPandas(run, f"path string, position int, {ITEM}, error string")


def control(items: DataFrame, name: str) -> DataFrame:
    """The item of an id; LookupError without one."""
    found = items.where(F.col("id") == name).limit(1)
    if found.isEmpty():
        raise LookupError(name)
    return found


def provenance(files: DataFrame) -> DataFrame:
    """sha256 and size of each file (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").alias("bytes"))


#: Who makes catalogs here.
EXTRACTOR = ("cartulary", "0.3")


def exported(items: DataFrame, title: str, version: str, path: str, sources: DataFrame | None = None, extractor: tuple[str, str] = EXTRACTOR) -> dict:
    """Writes the catalog of the items as one text file below ``path``; what its provenance is. The hash and the size of
    the output are observed while it is written, and are those of the file. ``sources`` (path, content) are the files
    that the items came from: their number, size and a hash over theirs."""
    watched = Observation()
    line = F.concat("catalog", F.lit("\n"))
    seen = [F.max(F.sha2(line, 256)).alias("output_hash"), F.max(F.octet_length(line)).alias("output_size")]
    assembled(items, title, version).select("catalog").coalesce(1).observe(watched, *seen).write.text(path)
    record = {"format": "catalog json", "output_hash": watched.get["output_hash"], "output_size": watched.get["output_size"], "extractor_name": extractor[0], "extractor_version": extractor[1], "at": datetime.now(UTC).isoformat()}
    if sources is not None:
        each = provenance(sources)
        total = each.agg(F.count("*").alias("source_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("source_size"), F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), "\n"), 256).alias("source_hash"))
        record |= total.first().asDict()  # a hash for each file of one catalog
    return record


def assembled(items: DataFrame, title: str, version: str, stamp: bool = True) -> DataFrame:
    """One row (catalog): a catalog document of the items. Items of a group are gathered first; only the finished
    groups, which make up one document, meet in one task."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list] = {}
        for r in rows.itertuples():
            if r.parent_id:
                below.setdefault(r.parent_id, []).append(r)

        def part(r) -> dict:
            inner = [part(c) for c in below.get(r.id, [])]
            return {"id": r.id, "name": "item", "prose": r.text or ""} | ({"parts": inner} if inner else {})

        controls = []
        for r in rows[rows.parent_id.fillna("") == ""].itertuples():
            inner = [part(c) for c in below.get(r.id, [])]
            statement = {"id": f"{r.id}_smt", "name": "statement", "prose": r.text or ""} | ({"parts": inner} if inner else {})
            controls.append({"id": r.id, "title": r.title or r.id, "parts": [statement]})
        name = rows._group.iloc[0]
        made = {"id": name} | ({"title": name} if name != "default" else {}) | {"controls": controls}
        return pd.DataFrame({"group_id": [name], "json": [json.dumps(made)]})

    named = items.withColumn("_group", F.when(F.coalesce("group_id", F.lit("")) == "", "default").otherwise(F.col("group_id")))
    groups = named.groupBy("_group").applyInPandas(group, "group_id string, json string")
    head = {"title": title, "version": version, "oscal-version": VERSION}
    if stamp:
        head["last-modified"] = datetime.now(UTC).isoformat()
    begin = json.dumps({"uuid": str(uuid.uuid4()) if stamp else "", "metadata": head})[:-1]
    joined = groups.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group_id", "json"))), lambda x: x["json"]), ",").alias("j"))
    return joined.select(F.concat(F.lit('{"catalog":' + begin + ', "groups":['), "j", F.lit("]}}")).alias("catalog"))
