"""A temporal property graph in two frames.

nodes: tenant_id, id, label, valid_from, valid_to, props. edges: the same with source_id, target_id. A fact holds from
valid_from until before valid_to; without valid_to it is current.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime
from itertools import count

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.ids import artifact_id, edge_id
from cartulary.functions.parsers import ARTIFACT_TYPES
from cartulary.functions.text import normal_name
from cartulary.operators.stored import stored


def current() -> Column:
    return F.col("valid_to").isNull()


def at(moment: datetime | Column, prefix: str = "") -> Column:
    """Holds at a moment: the interval is half open."""
    moment = moment if isinstance(moment, Column) else F.lit(moment)
    return (F.col(f"{prefix}valid_from") <= moment) & (F.col(f"{prefix}valid_to").isNull() | (F.col(f"{prefix}valid_to") > moment))


def _required(df: DataFrame, *columns: str) -> DataFrame:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    return df.where(F.when(missing, F.raise_error(F.lit(f"required: {', '.join(columns)}")).cast("boolean")).otherwise(True))


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with ``new`` appended; (tenant_id, label, id) is unique, and one that exists is an error."""
    new = _required(new, "id", "label", "valid_from")
    key = ["tenant_id", "label", "id"]
    if not new.join(nodes.select(*key), key, "left_semi").isEmpty() or not new.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("the node exists")
    return nodes.unionByName(new.select(nodes.columns))


def add_edges(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` appended whose two ends exist in their tenant; all are validated first."""
    new = _required(new, "label", "source_id", "target_id", "valid_from")
    ends = nodes.select("tenant_id", F.col("id").alias("_end")).distinct()
    for side in ("source_id", "target_id"):
        new = new.join(ends.withColumnRenamed("_end", side), ["tenant_id", side], "left_semi")
    return edges.unionByName(new.select(edges.columns))


def merged_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Appends edges whose id is not there yet: writing the same result twice adds nothing."""
    return edges.unionByName(new.dropDuplicates(["tenant_id", "id"]).join(edges.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti").select(edges.columns))


def relationships(
    edges: DataFrame, nodes: DataFrame, tenant: str, labels: list[str] | None = None, props: dict[str, str] | None = None, moment: datetime | None = None
) -> DataFrame:
    """The edges of a tenant with their end nodes; current ones, or those that held at ``moment``.

    Only the edge's interval is tested. Labels and properties are optional filters and go before the joins.
    """
    own = edges.where(F.col("tenant_id") == tenant).where(current() if moment is None else at(moment))
    if labels:
        own = own.where(F.col("label").isin(*labels))
    for k, v in (props or {}).items():
        own = own.where(F.col("props")[k] == v)
    named = nodes.where(F.col("tenant_id") == tenant)
    for side in ("source", "target"):
        end = named.select(F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("props").alias(f"{side}_props"))
        own = own.join(end, f"{side}_id")
    return own


def _one(facts: DataFrame, tenant: str, fact: str, label: str | None, moment: datetime | None, kind: str) -> DataFrame:
    own = facts.where((F.col("tenant_id") == tenant) & (F.col("id") == fact))
    own = own if label is None else own.where(F.col("label") == label)
    own = own if moment is None else own.where(at(moment))
    if own.isEmpty():
        raise LookupError(f"no {kind} {fact}")
    return own


def node(nodes: DataFrame, tenant: str, fact: str, label: str | None = None, moment: datetime | None = None) -> DataFrame:
    """The node of this id, or it is an error; given a moment, as it was then."""
    return _one(nodes, tenant, fact, label, moment, "node")


def edge(edges: DataFrame, tenant: str, fact: str, label: str | None = None, moment: datetime | None = None) -> DataFrame:
    """The edge of this id, or it is an error; given a moment, as it was then."""
    return _one(edges, tenant, fact, label, moment, "edge")


#: Functions that call into the machine that runs them.
CALLS = ("reflect", "java_method", "try_reflect")


def _refuse_unless_reading(session: SparkSession, query: str, own: set[str]) -> None:
    """An error unless a statement reads, and reads nothing but the relations named in ``own`` and what it defines."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(query).toString()
    except ParseException as e:
        raise ValueError("a query reads: it is one SELECT") from e
    defined = {n.strip() for names in re.findall(r"\bCTE \[([^\]]*)\]", plan) for n in names.split(",")}
    # A name of several parts is a path, a file or another schema's table; what is defined must not hide a table, or the
    # same name outside of its scope would read that one.
    read = set(re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan))
    if "UnresolvedIdentifier" in plan or re.search(rf"'({'|'.join(CALLS)})\(", plan, re.IGNORECASE):
        raise ValueError("a query names what it reads and calls nothing outside")
    if read - own - defined or any(session.catalog.tableExists(n) for n in defined):
        raise ValueError("a query reads {nodes} and {edges} only")


def answered(nodes: DataFrame, edges: DataFrame, tenant: str, query: str, parameters: dict | None = None, moment: datetime | None = None) -> DataFrame:
    """A SELECT over {nodes} and {edges} of one tenant, with :named parameters; of the facts of a moment if one is given.

    The statement is parsed first. What writes, reads another relation or file, or calls outside, is an error.
    """
    session, used = edges.sparkSession, {k: f"_{k}_{uuid.uuid4().hex}" for k in ("nodes", "edges")}
    # As a part of another query a statement cannot be a command.
    whole = "SELECT * FROM (\n" + re.sub(r"\{(nodes|edges)\}", lambda m: used[m[1]], query) + "\n) AS answer"
    _refuse_unless_reading(session, whole, set(used.values()))
    for k, df in (("nodes", nodes), ("edges", edges)):
        df.where(F.col("tenant_id") == tenant).where(F.lit(True) if moment is None else at(moment)).createOrReplaceTempView(used[k])
    try:
        return session.sql(whole, args=parameters or {})
    finally:
        for name in used.values():
            session.catalog.dropTempView(name)


def _steps(edges: DataFrame, start: DataFrame, depth: int | None, direction: str, labels: list[str] | None, moment: datetime | None, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(tenant_id, _e, _a, _b): the edges as steps from _a to _b; and ``start``, both without what did not hold then."""
    if direction not in ("outbound", "inbound", "both"):
        raise ValueError(f"unknown direction {direction}")
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    own = edges.where(F.col("label").isin(*labels)) if labels else edges
    if moment is not None:
        own = own.where(at(moment))
        if nodes is not None:
            valid = nodes.where(at(moment)).select("tenant_id", F.col("id").alias("_n")).distinct()
            for side in ("source_id", "target_id"):
                own = own.join(valid.withColumnRenamed("_n", side), ["tenant_id", side], "left_semi")
            start = start.join(valid.withColumnRenamed("_n", "id"), ["tenant_id", "id"], "left_semi")
    out = own.select("tenant_id", F.col("id").alias("_e"), F.col("source_id").alias("_a"), F.col("target_id").alias("_b"))
    back = out.select("tenant_id", "_e", F.col("_b").alias("_a"), F.col("_a").alias("_b"))
    return {"outbound": out, "inbound": back, "both": out.union(back)}[direction], start


def traverse(
    edges: DataFrame, start: DataFrame, depth: int | None, direction: str = "outbound", labels: list[str] | None = None, moment: datetime | None = None, nodes: DataFrame | None = None
) -> DataFrame:
    """All paths of 1 to ``depth`` edges from the nodes in ``start`` (tenant_id, id), no edge twice in one path.

    (tenant_id, start_id, end_id, hops, node_ids, edge_ids). With a moment, edges (and, given ``nodes``, nodes) that
    did not hold are left out before each step, so no invalid path is ever extended. Stored directions are kept.
    Without a depth, steps are made until none is left to make; no edge is used twice, so that ends. Then each step's
    paths are written down. Paths may be many more than nodes: what only has to know what is reached asks ``reachable``.
    """
    steps, start = _steps(edges, start, depth, direction, labels, moment, nodes)
    none = F.array().cast("array<string>")
    frontier = start.select("tenant_id", F.col("id").alias("start_id"), F.col("id").alias("end_id"), F.lit(0).alias("hops"), F.array(F.col("id").cast("string")).alias("node_ids"), none.alias("edge_ids"))
    found = None
    for _ in count() if depth is None else range(depth):
        frontier = (
            frontier.join(steps, (frontier["tenant_id"] == steps["tenant_id"]) & (frontier["end_id"] == steps["_a"]))
            .where(~F.array_contains("edge_ids", F.col("_e").cast("string")))
            .select(
                frontier["tenant_id"], "start_id", F.col("_b").alias("end_id"), (F.col("hops") + 1).alias("hops"),
                F.array_append("node_ids", F.col("_b").cast("string")).alias("node_ids"), F.array_append("edge_ids", F.col("_e").cast("string")).alias("edge_ids"),
            )
        )
        if depth is None:
            frontier = stored(frontier)
        found = frontier if found is None else found.union(frontier)
        if depth is None and frontier.isEmpty():
            break
    return found


def reached(paths: DataFrame, column: str = "node_ids") -> DataFrame:
    """The distinct nodes (or edges) of paths."""
    return paths.select("tenant_id", F.explode(column).alias("id")).distinct()


def reachable(
    edges: DataFrame, start: DataFrame, depth: int | None = None, direction: str = "outbound", labels: list[str] | None = None, moment: datetime | None = None,
    nodes: DataFrame | None = None, by_start: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """What paths of 1 to ``depth`` edges from ``start`` (tenant_id, id) lead through, without listing the paths: the
    nodes (tenant_id, id, hops) and the edges (tenant_id, id, hops), each once, at the least number of steps.

    hops is 0 for a start (which is there if a path leaves it), and for an edge the step that first takes it. With
    ``by_start`` all is told for each start: start_id stands before id. Without a depth, all that can be reached.

    Breadth first: each round only the nodes found in the last one make a step, and those that were found before are
    taken out, so a cycle ends and a hub is left once, whatever the number of paths. A node is on a path without
    repeated edges if and only if it is reached; so is an edge, if one of its ends is reached a step before.
    """
    steps, start = _steps(edges, start, depth, direction, labels, moment, nodes)
    # Written once as each round joins it: dealt by the end that a step leaves, so a round only deals what was found last.
    lasting = stored(steps.repartition(_parts(steps), "tenant_id", "_a").sortWithinPartitions("tenant_id", "_a"))
    key = ["tenant_id", *(["start_id"] if by_start else [])]
    first = start.select("tenant_id", F.col("id").alias("start_id"), "id").distinct() if by_start else start.select("tenant_id", "id").distinct()
    frontier = stored(first.join(lasting.select("tenant_id", F.col("_a").alias("id")), ["tenant_id", "id"], "left_semi").select(*key, "id"))
    found = frontier.withColumn("hops", F.lit(0))
    for hop in count(1) if depth is None else range(1, depth + 1):
        # The steps themselves are not kept: many lead to one node, and only different nodes are shuffled.
        step = frontier.join(lasting.withColumnRenamed("_a", "id"), ["tenant_id", "id"]).select(*key, F.col("_b").alias("id")).distinct()
        frontier = stored(step.join(found.select(*key, "id"), [*key, "id"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("hops", F.lit(hop)))
    # An edge is first taken one step after the nearer of the ends that it may be left from.
    left = found if depth is None else found.where(F.col("hops") < depth)
    taken = lasting.join(left.withColumnRenamed("id", "_a"), ["tenant_id", "_a"]).groupBy(*key, F.col("_e").alias("id")).agg((F.min("hops") + 1).alias("hops"))
    return found.select(*key, "id", "hops"), taken


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def supersede(facts: DataFrame, tenant: str, fact: str, moment: datetime, job: str | None = None) -> tuple[DataFrame, bool]:
    """The facts with the current one of this id closed at ``moment``, and whether there was one."""
    hit = (F.col("tenant_id") == tenant) & (F.col("id") == fact) & current()
    closed = facts.withColumn("valid_to", F.when(hit, F.lit(moment)).otherwise(F.col("valid_to")))
    if job is not None and "superseded_by" in facts.columns:
        closed = closed.withColumn("superseded_by", F.when(hit, F.lit(job)).otherwise(F.col("superseded_by")))
    return closed, not facts.where(hit).isEmpty()


def relationship_edges(consensus: DataFrame, moment: Column) -> DataFrame:
    """One SEMANTIC_MATCH edge for each pair (tenant_id, job_id, source_id, target_id, relationship, confidence)."""
    return consensus.select(
        "tenant_id",
        edge_id(F.lit("SEMANTIC_MATCH"), F.col("job_id"), F.col("source_id"), F.col("target_id")).alias("id"),
        F.lit("SEMANTIC_MATCH").alias("label"),
        "source_id",
        "target_id",
        moment.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.create_map(F.lit("relationship"), F.col("relationship"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("job_id"), F.col("job_id")).alias("props"),
    )


def requires_edges(decisions: DataFrame) -> DataFrame:
    """One REQUIRES edge for each affirmed pair; it holds from when it was analysed."""
    yes = decisions.where("decision")
    return yes.select(
        "tenant_id",
        edge_id(F.lit("REQUIRES"), F.col("job_id"), F.col("source_id"), F.col("target_id")).alias("id"),
        F.lit("REQUIRES").alias("label"),
        "source_id",
        "target_id",
        F.col("analyzed_at").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("job_id"), F.col("job_id")).alias("props"),
    )


def artifact_facts(agreed: DataFrame, moment: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of agreed artifacts (tenant_id, control_id, name, type): a node for each, DEMANDS from its control
    and IS_TYPE to the node of its type. Each tenant has the nodes of all types, those that no artifact is of too."""
    a = agreed.withColumn("_id", artifact_id(F.col("control_id"), normal_name(F.col("name")), F.col("type")))
    blank = F.create_map().cast("map<string,string>")
    open_end = F.lit(None).cast("timestamp").alias("valid_to")
    fact = lambda i, label, props: ["tenant_id", i.alias("id"), label.alias("label"), moment.alias("valid_from"), open_end, props.alias("props")]
    own = a.select(*fact(F.col("_id"), F.lit("Artifact"), F.create_map(F.lit("name"), F.col("name"), F.lit("type"), F.col("type"))))
    every = F.explode(F.array(*map(F.lit, ARTIFACT_TYPES))).alias("type")
    kinds = a.select("tenant_id", "type").unionByName(a.select("tenant_id").distinct().select("tenant_id", every)).distinct().select(*fact(F.concat(F.lit("type:"), "type"), F.lit("ArtifactType"), blank))
    edge = lambda label, s, t: a.select(
        "tenant_id", edge_id(F.lit(label), s, t).alias("id"), F.lit(label).alias("label"), s.alias("source_id"), t.alias("target_id"), moment.alias("valid_from"), open_end, blank.alias("props")
    )
    edges = edge("DEMANDS", F.col("control_id"), F.col("_id")).unionByName(edge("IS_TYPE", F.col("_id"), F.concat(F.lit("type:"), "type")))
    return own.unionByName(kinds).dropDuplicates(["tenant_id", "id"]), edges.dropDuplicates(["tenant_id", "id"])


def catalog_facts(controls: DataFrame, moment: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of controls (tenant_id, control_id, title, parent_id): Control nodes and PARENT_OF edges."""
    open_end = F.lit(None).cast("timestamp").alias("valid_to")
    nodes = controls.select(
        "tenant_id", F.col("control_id").alias("id"), F.lit("Control").alias("label"), moment.alias("valid_from"), open_end,
        F.create_map(F.lit("title"), F.coalesce("title", F.lit(""))).alias("props"),
    )
    child = controls.where(F.coalesce("parent_id", F.lit("")) != "")
    edges = child.select(
        "tenant_id", edge_id(F.lit("PARENT_OF"), F.col("parent_id"), F.col("control_id")).alias("id"), F.lit("PARENT_OF").alias("label"),
        F.col("parent_id").alias("source_id"), F.col("control_id").alias("target_id"), moment.alias("valid_from"), open_end, F.create_map().cast("map<string,string>").alias("props"),
    )
    return nodes, edges


def mappings(edges: DataFrame, tenant: str, control: str | None = None, least: float = 0.0, label: str = "SEMANTIC_MATCH") -> DataFrame:
    """Current mapping edges of a control (or of all), of at least this confidence; one without counts as certain."""
    own = edges.where((F.col("tenant_id") == tenant) & (F.col("label") == label) & current())
    if control is not None:
        own = own.where(F.col("source_id") == control)
    own = own.withColumn("confidence", F.coalesce(F.col("props")["confidence"].try_cast("double"), F.lit(1.0)))
    return own.where(F.col("confidence") >= least) if least > 0 else own
