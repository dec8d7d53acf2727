"""YAML on the driver: prompt specifications and lists of catalog documents, small files that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # it is no part of Spark
    yaml = None


def parsed(text: str) -> dict:
    """A YAML mapping; anything else is an error."""
    if yaml is None:
        raise RuntimeError("YAML needs the yaml package")
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError("bad YAML") from e
    if not isinstance(found, dict):
        raise ValueError("a YAML mapping is expected")
    return found


def prompt_specs(spark: SparkSession, path: str) -> dict[str, dict]:
    """The specifications in the .yaml and .yml files of a folder, by name; one without a name is an error, and of two
    with one name the file that comes later by path counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").load(path).select("path", "content")
    found = {}
    for row in sorted(files.collect()):
        spec = parsed(bytes(row["content"]).decode())
        if not spec.get("name"):
            raise ValueError(f"a prompt needs a name: {row['path']}")
        found[spec["name"]] = spec
    return found


def catalog_documents(spark: SparkSession, text: str) -> DataFrame:
    """(path, local, url) of a list of catalog documents: base_url, and documents with path and local name.

    A document without a path is an error; without a local name it takes the last part of its path.
    """
    spec = parsed(text)
    rows = []
    for d in spec.get("documents") or []:
        if not isinstance(d, dict) or not d.get("path"):
            raise ValueError("a document needs a path")
        rows.append((d["path"], d.get("local") or d["path"].rsplit("/", 1)[-1], f"{str(spec.get('base_url') or '').rstrip('/')}/{d['path'].lstrip('/')}"))
    return spark.createDataFrame(rows, "path string, local string, url string")
