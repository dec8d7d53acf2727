"""Queries of the crosswalk itself: synthesis, similarity, candidates and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import parsers
from cartulary.operators import candidates as C
from cartulary.operators import consensus as V
from cartulary.operators import similarity as S
from cartulary.operators import synthesis as Y
from cartulary.plans import inputs as I


_RANKED = f"""
inputs AS ({I.PAIRS_SQL}), classes AS ({I.CLASSES_SQL}),
joined AS (SELECT i.*, coalesce(s.type,'Unknown') AS source_type, coalesce(s.level,'Tactical') AS source_level,
  coalesce(t.type,'Unknown') AS target_type, coalesce(t.level,'Tactical') AS target_level
  FROM inputs i LEFT JOIN classes s ON s.control_id=i.source_id LEFT JOIN classes t ON t.control_id=i.target_id),
scaled AS (SELECT *, round(score
  * (CASE WHEN source_type=target_type OR source_type='Both' OR target_type='Both' THEN 1.0::DOUBLE
     WHEN source_type IN ('Unknown','None') OR target_type IN ('Unknown','None') THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END)
  * (CASE WHEN abs((CASE source_level WHEN 'Strategic' THEN 0 WHEN 'Operational' THEN 2 ELSE 1 END)
                 - (CASE target_level WHEN 'Strategic' THEN 0 WHEN 'Operational' THEN 2 ELSE 1 END)) <= 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)
  * 100.0::DOUBLE) / 100.0::DOUBLE AS viability FROM joined),
ranked AS (SELECT *, round(viability * (CASE WHEN contribution='INTEGRAL_TO' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) * 100.0::DOUBLE)/100.0::DOUBLE AS viability_weight FROM scaled)
"""
_KEPT = ["pos", "source_id", "target_id", "score", "confidence", "relationship", "source_type", "source_level", "target_type", "target_level", "viability", "viability_weight"]


def ranked(spark, sf):
    return Y.ranked(I.pairs(spark, sf), I.classes(spark, sf))


def synth_rank(spark, sf):
    return ranked(spark, sf).select(*_KEPT)


def synth_filter_cap(spark, sf):
    return Y.capped(Y.confident(ranked(spark, sf), 0.5), 3, F.col("target_id"), F.col("pos")).select(*_KEPT)


def synth_report(spark, sf):
    r = Y.report(ranked(spark, sf))
    rounded = [F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_viability", "iqr")]
    return r.select("total", "viable", *rounded, "no_relationship", "contested", "sources", "covered_sources")


def synth_histogram(spark, sf):
    return ranked(spark, sf).groupBy("relationship").agg(F.count("*").alias("n"))


def synth_diagnostics(spark, sf):
    return Y.diagnostics(Y.report(ranked(spark, sf))).select("name", "level", F.round("value", 6).alias("value"))


def synth_store(spark, sf):
    """Computed weights put into stored pairs."""
    rows = ranked(spark, sf).withColumn("job_id", F.lit("j1")).groupBy("job_id", "source_id", "target_id").agg(F.max("viability_weight").alias("viability_weight"))
    votes = rows.drop("viability_weight")
    return Y.stored(votes, rows.where("source_id <> '1'")).select("source_id", "target_id", "viability_weight")


def _vectors(spark, sf):
    e = I.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vec_allpairs_topk(spark, sf):
    return S.most_similar(_vectors(spark, sf), 50).select("id_a", "id_b", F.round("similarity", 4).alias("similarity"))


def vec_topk_per_source(spark, sf):
    return S.most_similar_of_each(_vectors(spark, sf), 3).select("source_id", "target_id", F.round("similarity", 4).alias("similarity"))


def vec_knn(spark, sf):
    v = _vectors(spark, sf)
    query = v.where("id = 0").first()
    found = S.nearest(v.where("id <> 0"), list(query["vector"]) if query else [1.0], 20)
    return found.select("id", F.round("similarity", 4).alias("similarity"))


def vec_metrics(spark, sf):
    from cartulary.functions import vectors as M

    v = _vectors(spark, sf)
    a = v.select(F.col("id").alias("a"), F.col("vector").alias("va"))
    b = v.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    p = a.join(b, F.col("b") == F.col("a") + 1)
    return p.select("a", "b", F.round(M.cosine("va", "vb"), 4).alias("cosine"), F.round(M.euclidean("va", "vb"), 4).alias("euclidean"), F.round(M.dot("va", "vb"), 4).alias("dot"))


def vec_text(spark, sf):
    """The text form of whole numbers goes there and back."""
    from cartulary.functions import vectors as M

    p = I.table(spark, sf, "part").select("p_partkey", F.array(F.col("p_partkey").cast("float"), F.col("p_size").cast("float")).alias("v"))
    back = M.from_text(M.to_text(F.col("v")))
    return p.select("p_partkey", F.get(back, F.lit(0)).cast("double").alias("x"), F.get(back, F.lit(1)).cast("double").alias("y"))


def _controls(spark, sf):
    """Benchmark items and part of the documents as targets and sources."""
    d = I.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("control_id"), F.col("p_name").alias("text"), F.expr("CASE p_size % 4 WHEN 0 THEN 'Strategic' WHEN 1 THEN 'Tactical' WHEN 2 THEN 'Operational' ELSE '' END").alias("level"))
    s = I.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("control_id"), F.concat(F.lit("Policy "), "s_name").alias("text"), F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'Tactical' WHEN 1 THEN 'Operational' ELSE 'Strategic' END").alias("level"))
    return s, d


def cand_level(spark, sf):
    s, d = _controls(spark, sf)
    return C.Level().classes(s, d).counted("source").groupBy("source_id").agg(F.sum("n").alias("n"))


def cand_keyword(spark, sf):
    s, d = _controls(spark, sf)
    # Part names stand for sources here, supplier texts for targets with a foundational word.
    out = C.Keyword().classes(d, s).counted("target", F.col("metadata")["keywords"].alias("keywords"))
    return out.groupBy("target_id").agg(F.sum("n").alias("n"), F.min("keywords").alias("keywords"))


def _generated(spark, sf):
    p = I.pairs(spark, sf).groupBy("source_id", "target_id").agg(F.max("score").alias("s"), F.max("confidence").alias("c"))
    blank = F.create_map().cast("map<string,string>")
    a = p.where("s >= 40").select("source_id", "target_id", (F.col("s") / 100).alias("score"), F.lit(1.0).alias("weight"), F.lit("semantic").alias("generator"), blank.alias("metadata"))
    b = p.where("c >= 0.3").select("source_id", "target_id", F.col("c").alias("score"), F.lit(0.5).alias("weight"), F.lit("keyword").alias("generator"), blank.alias("metadata"))
    return a.unionByName(b)


_GENERATED = f"""
p AS (SELECT source_id, target_id, max(score) AS s, max(confidence) AS c FROM ({I.PAIRS_SQL}) GROUP BY ALL),
g AS (SELECT source_id, target_id, s/100.0::DOUBLE AS score, 1.0::DOUBLE AS weight, 'semantic' AS generator FROM p WHERE s>=40
 UNION ALL SELECT source_id, target_id, c, 0.5::DOUBLE, 'keyword' FROM p WHERE c>=0.3)
"""


def cand_union(spark, sf):
    u = C.union_first(_generated(spark, sf))
    return u.select("source_id", "target_id", F.round("score", 6).alias("score"), "generator")


def cand_weighted_union(spark, sf):
    u = C.union_weighted(_generated(spark, sf), 0.4)
    return u.select("source_id", "target_id", F.round("score", 6).alias("score"), "generator")


def cand_provenance(spark, sf):
    stored = C.with_provenance(_generated(spark, sf)).withColumn("provenance", F.to_json("provenance"))
    return C.in_order(stored).select("source_id", "target_id", F.round("aggregate_score", 6).alias("aggregate_score"), F.size("provenance").cast("long").alias("n"))


def vote_plurality(spark, sf):
    v = V.plurality(I.votes(spark, sf))
    return v.select("pair_id", "relationship", "contribution", "confidence_fraction", "unanimous", "valid_vote_count", F.size("all_votes").cast("long").alias("n_votes"))


def vote_weighted_binary(spark, sf):
    v = V.weighted_binary(I.votes(spark, sf), min_valid=3, max_error_rate=0.25)
    return v.select("pair_id", "decision", F.round("confidence", 6).alias("confidence"), "unanimous", "valid", "status")


def vote_threshold(spark, sf):
    v = V.weighted_binary(I.votes(spark, sf))
    return v.where(V.meets(F.col("confidence"), 0.6)).select("pair_id", "decision")


def vote_feedback(spark, sf):
    f = I.table(spark, sf, "events").select(F.col("user_id").alias("pair_id"), F.expr("CASE event_id % 5 WHEN 0 THEN 'disagree' WHEN 1 THEN 'refine' ELSE 'agree' END").alias("vote"))
    return V.vote_aggregation(f).select("pair_id", "agree", "disagree", "refine", "escalate", F.round("agreement_score", 6).alias("agreement_score"), "needs_escalation")


def _responses(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id",
        F.expr("concat('Relationship: ', CASE event_id % 4 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'CONTRIBUTES_TO' WHEN 2 THEN 'maybe' ELSE 'partial' END, '\\nCONFIDENCE: ', CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' ELSE 'none' END, '\\nCONTRIBUTION_TYPE: ', CASE event_id % 2 WHEN 0 THEN 'INTEGRAL_TO' ELSE 'x' END)").alias("response"),
        F.expr("CASE event_id % 6 WHEN 0 THEN 'TECHNICAL|OPERATIONAL' WHEN 1 THEN ' None|Strategic.' WHEN 2 THEN 'procedural' WHEN 3 THEN 'both | weird' WHEN 4 THEN '' ELSE 'noise|tactical|x' END").alias("label"),
    )


def parse_relationship(spark, sf):
    p = _responses(spark, sf).select("event_id", parsers.relationship(F.col("response")).alias("r"))
    return p.select("event_id", "r.relationship", "r.contribution", "r.confidence", "r.parse_status")


def parse_classification(spark, sf):
    p = _responses(spark, sf).select("event_id", parsers.classification(F.col("label")).alias("c"))
    return p.select("event_id", F.col("c.type").alias("type"), F.col("c.level").alias("level"))


def _artifact_votes(spark, sf):
    text = F.expr(
        "concat('preamble\\n---\\nARTIFACT_NAME: ', CASE event_id % 3 WHEN 0 THEN 'The Access Policy' WHEN 1 THEN 'Access policy.' ELSE 'Audit log' END, '\\nARTIFACT_TYPE: ', "
        "CASE event_id % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'PROCEDURE' WHEN 2 THEN 'RECORD' ELSE 'unknown' END, '\\nFREQUENCY: NONE\\nRETENTION: ', event_id % 7, ' years\\n---\\nARTIFACTS: NONE')"
    )
    parsed = parsers.artifacts(text)
    e = I.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("control_id"), F.col("event_id").cast("string").alias("vote_key"), parsed.alias("p"))
    return e.select("control_id", "vote_key", F.col("p.parse_status").alias("parse_status"), F.col("p.artifacts").alias("artifacts"))


def parse_artifacts(spark, sf):
    v = _artifact_votes(spark, sf)
    return v.select("vote_key", "parse_status", F.size("artifacts").cast("long").alias("n"), F.get("artifacts", F.lit(0))["type"].alias("type"), F.get("artifacts", F.lit(0))["properties"]["RETENTION"].alias("retention"))


def artifact_consensus(spark, sf):
    a = V.artifact_consensus(_artifact_votes(spark, sf))
    return a.select("control_id", "name", "type", "confidence", "unanimous", F.size("voters").alias("n_voters"))


QUERIES = {
    f.__name__: f
    for f in (
        synth_rank, synth_filter_cap, synth_report, synth_histogram, synth_diagnostics, synth_store, vec_allpairs_topk, vec_topk_per_source, vec_knn, vec_metrics, vec_text,
        cand_level, cand_keyword, cand_union, cand_weighted_union, cand_provenance, vote_plurality, vote_weighted_binary, vote_threshold, vote_feedback,
        parse_relationship, parse_classification, parse_artifacts, artifact_consensus,
    )
}

_SIM = """
pairs AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])*100 AS similarity
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
"""
_S_SQL = "SELECT 's'||s_suppkey AS control_id, 'Policy '||s_name AS text, CASE s_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS at FROM supplier"
_T_SQL = "SELECT 'p'||p_partkey AS control_id, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS at FROM part WHERE p_size % 4 <> 3"
_VALID = "parse_status NOT IN ('PARSE_FAIL','PARSE_ERROR')"
_PRIORITY = "CASE relationship WHEN 'EQUIVALENT' THEN 0 WHEN 'SUPERSET_OF' THEN 1 WHEN 'SUBSET_OF' THEN 2 WHEN 'CONTRIBUTES_TO' THEN 3 WHEN 'COMPLEMENTS' THEN 4 WHEN 'PARTIAL' THEN 5 WHEN 'CONFLICTS_WITH' THEN 6 ELSE 7 END"
_BINARY = f"""
v AS ({I.VOTES_SQL}),
s AS (SELECT pair_id, coalesce(sum(CASE WHEN decision THEN CASE WHEN weight=0 THEN 1.0::DOUBLE ELSE weight END END),0.0::DOUBLE) AS yes,
 coalesce(sum(CASE WHEN NOT decision THEN CASE WHEN weight=0 THEN 1.0::DOUBLE ELSE weight END END),0.0::DOUBLE) AS no, count(decision) AS valid, count(*) AS n FROM v GROUP BY pair_id)
"""

ORACLE = {
    "synth_rank": f"WITH {_RANKED} SELECT {', '.join(_KEPT)} FROM ranked",
    "synth_filter_cap": f"WITH {_RANKED} SELECT {', '.join(_KEPT)} FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY viability_weight DESC, target_id, pos) AS rn FROM ranked WHERE confidence >= 0.5) WHERE rn <= 3",
    "synth_report": f"""WITH {_RANKED}, act AS (SELECT source_id, max(relationship <> 'NO_RELATIONSHIP' AND relationship <> 'CONFLICTS_WITH' AND viability_weight > 0) AS covered FROM ranked GROUP BY source_id)
      SELECT count(*) AS total, count_if(viability_weight>0)::BIGINT AS viable, round(avg(confidence),6) AS avg_confidence, round(avg(viability_weight),6) AS avg_viability,
      round(quantile_cont(score,0.75)-quantile_cont(score,0.25),6) AS iqr, count_if(relationship='NO_RELATIONSHIP')::BIGINT AS no_relationship, count_if(NOT unanimous)::BIGINT AS contested,
      (SELECT count(*) FROM act) AS sources, (SELECT count_if(covered)::BIGINT FROM act) AS covered_sources FROM ranked""",
    "synth_histogram": f"WITH {_RANKED} SELECT relationship, count(*) AS n FROM ranked GROUP BY relationship",
    "synth_diagnostics": f"""WITH {_RANKED}, act AS (SELECT source_id, max(relationship NOT IN ('NO_RELATIONSHIP','CONFLICTS_WITH') AND viability_weight > 0) AS covered FROM ranked GROUP BY source_id),
      m AS (SELECT count(*) AS n, quantile_cont(score,0.75)-quantile_cont(score,0.25) AS iqr, count_if(relationship='NO_RELATIONSHIP')/count(*) AS nr, count_if(NOT unanimous)/count(*) AS ct,
      (SELECT count_if(covered)/count(*) FROM act) AS cv FROM ranked)
      SELECT 'iqr' AS name, CASE WHEN n<4 THEN 'warn' WHEN iqr>=15 THEN 'good' WHEN iqr<5 THEN 'poor' ELSE 'warn' END AS level, round(iqr,6) AS value FROM m WHERE n>0
      UNION ALL SELECT 'no_relationship_rate', CASE WHEN nr>0.9 THEN 'poor' WHEN nr<0.1 THEN 'warn' ELSE 'good' END, round(nr,6) FROM m
      UNION ALL SELECT 'contested_rate', CASE WHEN ct>0.3 THEN 'warn' ELSE 'good' END, round(ct,6) FROM m
      UNION ALL SELECT 'actionable_coverage', CASE WHEN cv<0.5 THEN 'warn' ELSE 'good' END, round(cv,6) FROM m""",
    "synth_store": f"WITH {_RANKED} SELECT source_id, target_id, CASE WHEN source_id <> '1' THEN max(viability_weight) END AS viability_weight FROM ranked GROUP BY source_id, target_id",
    "vec_allpairs_topk": f"WITH {_SIM} SELECT id_a, id_b, round(similarity,4) AS similarity FROM pairs ORDER BY pairs.similarity DESC, id_a, id_b LIMIT 50",
    "vec_topk_per_source": f"""WITH {_SIM}, b AS (SELECT id_a AS source_id, id_b AS target_id, similarity FROM pairs UNION ALL SELECT id_b, id_a, similarity FROM pairs)
      SELECT source_id, target_id, round(similarity,4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id) AS rn FROM b) WHERE rn<=3""",
    "vec_knn": "SELECT b.vec_id AS id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]),4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id=0 AND b.vec_id<>0 ORDER BY list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) DESC, id LIMIT 20",
    "vec_metrics": """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),4) AS cosine,
      round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),4) AS euclidean, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),4) AS dot
      FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1""",
    "vec_text": "SELECT p_partkey, p_partkey::DOUBLE AS x, p_size::DOUBLE AS y FROM part",
    "cand_level": f"SELECT s.control_id AS source_id, count(*) AS n FROM ({_S_SQL}) s JOIN ({_T_SQL}) t ON t.at < s.at GROUP BY s.control_id",
    "cand_keyword": "SELECT 's'||s_suppkey AS target_id, (SELECT count(*) FROM part) AS n, 'policy' AS keywords FROM supplier WHERE (SELECT count(*) FROM part) > 0",
    "cand_union": f"WITH {_GENERATED} SELECT source_id, target_id, round(arg_min(score, generator),6) AS score, min(generator) AS generator FROM g GROUP BY source_id, target_id",
    "cand_weighted_union": f"WITH {_GENERATED} SELECT source_id, target_id, round(sum(score*weight)/sum(weight),6) AS score, min(generator) AS generator FROM g GROUP BY source_id, target_id HAVING sum(score*weight)/sum(weight) >= 0.4",
    "cand_provenance": f"WITH {_GENERATED} SELECT source_id, target_id, round(max(score),6) AS aggregate_score, count(*) AS n FROM g GROUP BY source_id, target_id",
    "vote_plurality": f"""WITH v AS ({I.VOTES_SQL}),
      c AS (SELECT pair_id, relationship, count(*) AS n, count_if(contribution='INTEGRAL_TO') AS i, count_if(contribution='EXAMPLE_OF') AS e, {_PRIORITY} AS p FROM v WHERE {_VALID} GROUP BY pair_id, relationship),
      b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, p) AS rn, sum(n) OVER (PARTITION BY pair_id) AS t FROM c),
      a AS (SELECT pair_id, count(*) AS n_votes FROM v GROUP BY pair_id)
      SELECT a.pair_id, coalesce(relationship,'NO_RELATIONSHIP') AS relationship, CASE WHEN relationship='CONTRIBUTES_TO' THEN CASE WHEN i>0 AND i>=e THEN 'INTEGRAL_TO' WHEN e>0 THEN 'EXAMPLE_OF' ELSE '' END ELSE '' END AS contribution,
      coalesce(round(n/t*1000.0::DOUBLE)/1000.0::DOUBLE,0.0::DOUBLE) AS confidence_fraction, coalesce(n=t,false) AS unanimous, coalesce(t,0)::BIGINT AS valid_vote_count, n_votes
      FROM a LEFT JOIN b ON a.pair_id=b.pair_id AND rn=1""",
    "vote_weighted_binary": f"""WITH {_BINARY} SELECT pair_id, yes>no AS decision, CASE WHEN yes+no>0 THEN round(greatest(yes,no)/(yes+no),6) ELSE 0.0::DOUBLE END AS confidence,
      (yes+no>0 AND least(yes,no)=0) AS unanimous, valid, CASE WHEN valid<3 AND valid>0 THEN 'insufficient' WHEN (n-valid)/n > 0.25 THEN 'errors' ELSE 'ok' END AS status FROM s""",
    "vote_threshold": f"WITH {_BINARY} SELECT pair_id, yes>no AS decision FROM s WHERE yes+no>0 AND greatest(yes,no)/(yes+no) >= 0.6",
    "vote_feedback": """SELECT user_id AS pair_id, count_if(event_id%5>1)::BIGINT AS agree, count_if(event_id%5=0)::BIGINT AS disagree, count_if(event_id%5=1)::BIGINT AS refine, 0::BIGINT AS escalate,
      round(count_if(event_id%5>1)/count(*),6) AS agreement_score, false AS needs_escalation FROM events GROUP BY user_id""",
    "parse_relationship": """SELECT event_id, CASE event_id%4 WHEN 0 THEN 'EQUIVALENT' WHEN 1 THEN 'CONTRIBUTES_TO' WHEN 2 THEN 'NO_RELATIONSHIP' ELSE 'PARTIAL' END AS relationship,
      CASE WHEN event_id%4<>2 AND event_id%2=0 THEN 'INTEGRAL_TO' ELSE '' END AS contribution, CASE WHEN event_id%4=2 THEN 'LOW' ELSE CASE event_id%3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END END AS confidence,
      CASE WHEN event_id%4=2 THEN 'PARSE_FAIL' ELSE 'OK' END AS parse_status FROM events""",
    "parse_classification": """SELECT event_id, CASE event_id%6 WHEN 0 THEN 'Technical' WHEN 1 THEN 'None' WHEN 2 THEN 'Procedural' WHEN 3 THEN 'Both' WHEN 4 THEN NULL ELSE 'None' END AS type,
      CASE event_id%6 WHEN 0 THEN 'Operational' WHEN 1 THEN 'None' WHEN 2 THEN 'Tactical' WHEN 3 THEN 'Tactical' WHEN 4 THEN NULL ELSE 'None' END AS level FROM events""",
    "parse_artifacts": """SELECT event_id::VARCHAR AS vote_key, CASE WHEN event_id%4=3 THEN 'NONE' ELSE 'OK' END AS parse_status, CASE WHEN event_id%4=3 THEN 0 ELSE 1 END::BIGINT AS n,
      CASE event_id%4 WHEN 0 THEN 'POLICY' WHEN 1 THEN 'PROCEDURE' WHEN 2 THEN 'RECORD' END AS type, CASE WHEN event_id%4<>3 THEN (event_id%7)||' years' END AS retention FROM events""",
    "artifact_consensus": """WITH v AS (SELECT user_id::VARCHAR AS control_id, event_id::VARCHAR AS vote_key, CASE event_id%3 WHEN 0 THEN 'The Access Policy' WHEN 1 THEN 'Access policy.' ELSE 'Audit log' END AS name,
        CASE event_id%4 WHEN 0 THEN 'POLICY' WHEN 1 THEN 'PROCEDURE' WHEN 2 THEN 'RECORD' END AS type FROM events),
      n AS (SELECT control_id, count(*) AS total FROM v GROUP BY 1),
      g AS (SELECT control_id, name='Audit log' AS audit, arg_min(name, vote_key) AS name, count(*) AS n_voters, count_if(type='POLICY') AS p, count_if(type='PROCEDURE') AS q, count_if(type='RECORD') AS r FROM v WHERE type IS NOT NULL GROUP BY control_id, audit)
      SELECT control_id, name, CASE WHEN p>=q AND p>=r THEN 'POLICY' WHEN q>=r THEN 'PROCEDURE' ELSE 'RECORD' END AS type, floor(n_voters::DOUBLE/total*1000+0.5)/1000 AS confidence, n_voters=total AS unanimous, n_voters::INTEGER AS n_voters FROM g JOIN n USING (control_id)""",
}
