"""Queries over text: cleaning, structuring, decomposing and searching."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from cartulary.functions import text as X
from cartulary.operators import search as R
from cartulary.operators import similarity as S
from cartulary.operators import structure as Q
from cartulary.plans import inputs as I
from cartulary.sources import catalogs as K
from cartulary.sources import schemas as J


def _dirty(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    return d.select("doc_id", F.concat(F.lit("  {{ insert: param, p1 }}head  of\n\n\n\nVerDate Sep 11 2014\nx Jkt 012345 tail\n"), F.col("raw"), F.lit("\nPO 00000 Frm 00001 end\n")).alias("text"))


_DIRTY = "SELECT doc_id, '  {{ insert: param, p1 }}head  of' || repeat(chr(10),4) || 'VerDate Sep 11 2014' || chr(10) || 'x Jkt 012345 tail' || chr(10) || coalesce(text,'') || chr(10) || 'PO 00000 Frm 00001 end' || chr(10) AS text FROM documents"


def text_clean_tail(spark, sf):
    return _dirty(spark, sf).select("doc_id", F.sha2(X.clean_tails(F.col("text")).cast("binary"), 256).alias("digest"))


def text_clean_line(spark, sf):
    return _dirty(spark, sf).select("doc_id", F.sha2(X.clean_lines(F.col("text")).cast("binary"), 256).alias("digest"))


def text_prepare(spark, sf):
    p = X.prepared(F.col("text"), F.lit("Parent"), 120)
    return _dirty(spark, sf).select("doc_id", F.length(p).cast("long").alias("n"), F.sha2(p.cast("binary"), 256).alias("digest"))


def text_normalize_name(spark, sf):
    n = F.concat(F.lit("The  "), "p_name", F.lit(" ... "))
    return I.table(spark, sf, "part").select("p_partkey", X.normal_name(n).alias("name"))


def fuzzy_match_pairs(spark, sf):
    """Parts of one brand whose names have half of their words in common."""
    p = I.table(spark, sf, "part").select("p_brand", F.lower("p_name").alias("name"), F.col("p_partkey").alias("k"))
    return X.matching_pairs(p, "k", "name", ["p_brand"], 0.5).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))


def keyword_filter(spark, sf):
    lines = I.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    items = lines.select("doc_id", "pos", "text", F.lit("").alias("title"))
    return Q.required_items(items, ("licensed", "stupid")).groupBy("doc_id").agg(F.count("*").alias("n"))


def struct_fallback(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return Q.paragraphs(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


def struct_heading_repeat(spark, sf):
    s = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("pos"), F.col("l_returnflag").alias("title"), F.lit("t").alias("text"))
    return Q.heading_items(s).select("doc_id", "id", "title")


def struct_pattern(spark, sf):
    d = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('intro\\n', CASE o_orderkey % 3 WHEN 0 THEN '1.1 a\\n1.2 b\\n 1.3 c' WHEN 1 THEN '(a) x\\n(b) y\\n(c) z\\n(1) q' ELSE 'Article 1\\nno' END)").alias("text"))
    return Q.pattern_items(d).select("doc_id", "id", "text")


def _clauses(spark, sf):
    words = "one two three four five six seven eight nine ten"
    text = "\n".join(f"({c}) {words} {words}" for c in "abc") + "\n" + "\n".join(f"{i}. {words}" for i in (1, 2, 3))
    return I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("x").alias("id"), F.lit(text).alias("text"))


def decompose_text(spark, sf):
    return Q.decomposed(_clauses(spark, sf)).select("doc_id", "id", "class", "parent_id")


def chunk_text(spark, sf):
    return Q.chunked(I.table(spark, sf, "documents"), 2000).groupBy("doc_id").agg(F.count("*").alias("n"))


def structurer_cascade(spark, sf):
    return Q.structured(I.table(spark, sf, "documents").select("doc_id", "text"), keywords=True).groupBy("doc_id").agg(F.count("*").alias("n"))


def _controls(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select(F.col("lang").alias("catalog_id"), F.concat_ws("/", "lang", "doc_id").alias("control_id"), F.col("doc_id").cast("string").alias("identifier"), F.col("source").alias("title"), F.col("text").alias("statement"))


def control_search(spark, sf):
    """Which controls of two catalogs hold every word that is no stop word, in any form."""
    return R.found(R.indexed(_controls(spark, sf)), "this WORK", ["en", "fr"]).select("control_id")


def _parts(spark, sf):
    """Parts as controls of two words in the title and two in the statement."""
    p = I.table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("catalog_id"), F.format_string("p%08d", "p_partkey").alias("control_id"), F.lit("x").alias("identifier"), F.col("p_name").alias("title"), F.concat("p_type", F.lit(" Rings")).alias("statement"))


def search_ranked(spark, sf):
    """The rank of every part that is small in some way, by postings."""
    return R.ranked(R.postings(R.indexed(_parts(spark, sf))), "the small rings").select("control_id", F.round("rank", 6).alias("rank"))


def search_page(spark, sf):
    """A page of the ranked parts, in order, with the number of all and where the next begins."""
    rows, total, following = R.page(R.found(R.indexed(_parts(spark, sf)), "ringing small"), 20, 10)
    return rows.select("place", "control_id", F.round("rank", 6).alias("rank"), F.lit(total).cast("long").alias("total"), F.lit(following).cast("long").alias("next_offset"))


def hybrid_merge(spark, sf):
    """What words find, then what only the vectors nearest to vector 0 find; a vector belongs to the document of its id."""
    c = _controls(spark, sf)
    words = R.found(R.indexed(c), "this WORK")
    e = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    query = e.where("id = 0").first()
    near = S.nearest(e.where("id <> 0"), list(query["vector"]) if query else [1.0], 100)
    meaning = c.join(near.select(F.col("id").cast("string").alias("identifier")), "identifier").select("control_id")
    return R.merged(words, meaning).groupBy("origin").agg(F.count("*").alias("n"))


#: What a part's document must be like.
PART_SCHEMA = {
    "type": "object", "required": ["id", "title"], "additionalProperties": False,
    "properties": {"id": {"$ref": "#/definitions/token"}, "title": {"type": "string", "maxLength": 11}, "size": {"type": "integer", "maximum": 40}, "kinds": {"type": "array", "items": {"enum": ["SMALL", "LARGE", "PROMO"]}}},
    "definitions": {"token": {"type": "string", "pattern": "^\\p{L}[0-9]+$"}},
}


def catalog_faults(spark, sf):
    """Every fault of a document made of each part, by place and rule."""
    p = I.table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, "9").otherwise(F.concat(F.lit("é"), "p_partkey")).alias("id")
    title = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("title")
    content = F.to_json(F.struct(name, title, F.col("p_size").alias("size"), F.array("p_type", F.lit("SMALL")).alias("kinds"), F.when(F.col("p_partkey") % 11 == 0, 1).alias("extra")))
    docs = p.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 13 == 0, "{").otherwise(content).alias("content"))
    return J.faults(docs, json.dumps(PART_SCHEMA)).select("path", F.col("at").alias("place"), "rule")


def catalog_flatten(spark, sf):
    """A nested catalog for each nation, flattened and decomposed."""

    def tree(batches):
        for b in batches:
            out = []
            for key, name in zip(b["n_nationkey"], b["n_name"], strict=True):
                item = lambda i, parts=(): {"name": "item", "id": f"ac-{key}_smt.{i}", "prose": f"do {{{{ insert: param, p{i} }}}}", "parts": list(parts)}  # noqa: B023, E731
                statement = {"name": "statement", "prose": name, "parts": [item("a"), item("b", [item("b.1"), item("b.2")])]}
                control = {"id": f"ac-{key}", "title": name, "parts": [statement], "params": [{"id": "pa", "label": "weekly"}]}
                out.append(json.dumps({"catalog": {"groups": [{"id": "g", "groups": [{"id": "h", "controls": [control]}]}]}}))
            yield pd.DataFrame({"path": b["n_nationkey"].astype(str), "content": out})

    docs = I.table(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(tree, "path string, content string")
    return K.flatten(docs).select("path", "id", "text", "class", "parent_id", "group_id")


QUERIES = {
    f.__name__: f
    for f in (
        text_clean_tail, text_clean_line, text_prepare, text_normalize_name, fuzzy_match_pairs, keyword_filter, struct_fallback, struct_heading_repeat, struct_pattern, decompose_text,
        chunk_text, structurer_cascade, control_search, search_ranked, search_page, hybrid_merge, catalog_faults, catalog_flatten,
    )
}

_TAILS = r"(\|[-| ]+\||VerDate\s+\S+|Jkt\s+\d+|PO\s+\d{5}|Frm\s+\d+|Fmt\s+\d+|Sfmt\s+\d+|G:\\COMP\\)[^\n]*"


def _collapse(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10)||chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _tail_sql(x: str) -> str:
    return _collapse(rf"regexp_replace(regexp_replace({x}, '\{{\{{[^}}]*\}}\}}', '', 'g'), '{_TAILS}', '', 'g')")


def _line_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '\{{\{{[^\n]*?\}}\}}', '', 'g')"
    for p in (r"\|[-| ]+\|", r"VerDate\s+", r"Jkt\s+\d+", r"PO\s+\d{5}", r"Frm\s+\d+", r"Fmt\s+\d+", r"Sfmt\s+\d+", r"G:\\COMP\\"):
        x = rf"regexp_replace({x}, '(?m)^[^\n]*{p}[^\n]*(\n|\z)', '', 'g')"
    return _collapse(x)


_OVERLAP = "len(list_intersect(list_distinct(string_split(lower(a.p_name),' ')), list_distinct(string_split(lower(b.p_name),' ')))) / least(len(list_distinct(string_split(lower(a.p_name),' '))), len(list_distinct(string_split(lower(b.p_name),' '))))"
_WORK = r"list_has_any(regexp_extract_all(lower(coalesce(text,'')||' '||coalesce(source,'')), '[\p{L}\p{N}]+'), ['work','works','worked','working','workings'])"
#: Positions: 1 and 2 in the title (weight 1), 3 and 4 in the statement (weight 0.4); a rank for each set of hits.
_RANKED = """p AS (SELECT printf('p%08d', p_partkey) AS control_id, p_name LIKE 'small %' AS s1, p_name LIKE '% ring' AS r2, p_type='SMALL' AS s3 FROM part),
      k AS (SELECT control_id, (CASE WHEN s1 AND r2 AND s3 THEN 1 + 2/3.5 + 2/5.0 WHEN s1 AND r2 THEN 1 WHEN s1 AND s3 THEN 2/5.0 WHEN s1 THEN 2/3.5/3 WHEN r2 THEN 2/3.5 + 2/5.0 ELSE 2/5.0 END)::DOUBLE AS rank FROM p WHERE s1 OR s3)"""
ORACLE = {
    "text_clean_tail": f"SELECT doc_id, sha256({_tail_sql('text')}) AS digest FROM ({_DIRTY})",
    "text_clean_line": f"SELECT doc_id, sha256({_line_sql('text')}) AS digest FROM ({_DIRTY})",
    "text_prepare": f"SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM (SELECT doc_id, substring({_tail_sql(chr(39) + '[Parent] ' + chr(39) + '||text')},1,120) AS t FROM ({_DIRTY}))",
    "text_normalize_name": r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS name FROM part",
    "fuzzy_match_pairs": f"SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand=b.p_brand AND a.p_partkey<b.p_partkey WHERE {_OVERLAP} >= 0.5",
    "keyword_filter": "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS t FROM documents), h AS (SELECT doc_id, contains(lower(t),'licensed') OR contains(lower(t),'stupid') AS hit FROM l), a AS (SELECT doc_id, max(hit) AS anyhit FROM h GROUP BY doc_id) SELECT h.doc_id, count(*) AS n FROM h JOIN a USING (doc_id) WHERE hit OR NOT anyhit GROUP BY h.doc_id",
    "struct_fallback": r"SELECT doc_id, count(*) AS n, max(length(t)) AS longest FROM (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text,''), chr(10))), '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t<>'' GROUP BY doc_id",
    "struct_heading_repeat": "SELECT doc_id, id, title FROM (SELECT l_orderkey AS doc_id, 'sec-'||l_linenumber AS id, l_returnflag AS title, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem) WHERE n<=3",
    "struct_pattern": "SELECT o_orderkey AS doc_id, id, text FROM orders JOIN (VALUES (0,'1.1','1.1 a'),(0,'1.2','1.2 b'),(0,'1.3','1.3 c'),(1,'(a)','(a) x'),(1,'(b)','(b) y'),(1,'(c)','(c) z')) v(k,id,text) ON o_orderkey%3=k",
    "decompose_text": "SELECT s_suppkey::VARCHAR AS doc_id, id, class, parent_id FROM supplier, (VALUES ('x.a','requirement',''),('x.b','requirement',''),('x.c','section',''),('x.c.1','requirement','x.c'),('x.c.2','requirement','x.c'),('x.c.3','requirement','x.c')) v(id,class,parent_id)",
    "control_search": f"SELECT lang||'/'||doc_id AS control_id FROM documents WHERE lang IN ('en','fr') AND {_WORK}",
    "search_ranked": f"WITH {_RANKED} SELECT control_id, round(rank,6) AS rank FROM k",
    "search_page": f"WITH {_RANKED}, o AS (SELECT row_number() OVER (ORDER BY rank DESC, control_id) AS place, control_id, round(rank,6) AS rank, count(*) OVER () AS total FROM k) SELECT place::INTEGER AS place, control_id, rank, total, least(total, 30)::BIGINT AS next_offset FROM o WHERE place BETWEEN 11 AND 30",
    "hybrid_merge": f"""WITH w AS (SELECT doc_id FROM documents WHERE {_WORK}),
      s AS (SELECT b.vec_id AS doc_id FROM embeddings a, embeddings b WHERE a.vec_id=0 AND b.vec_id<>0 ORDER BY list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 100)
      SELECT 'text' AS origin, count(*) AS n FROM w HAVING count(*)>0 UNION ALL SELECT 'semantic', count(*) FROM s WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT doc_id FROM w) HAVING count(*)>0""",
    "catalog_flatten": "SELECT n_nationkey::VARCHAR AS path, replace(id,'#','ac-'||n_nationkey) AS id, replace(text,'#',n_name) AS text, class, replace(parent_id,'#','ac-'||n_nationkey) AS parent_id, 'h' AS group_id FROM nation, (VALUES ('#','#','section',''),('#.a','do weekly','requirement','#'),('#.b','do [pb]','section','#'),('#.b.1','do [pb.1]','requirement','#.b'),('#.b.2','do [pb.2]','requirement','#.b')) v(id,text,class,parent_id)",
    "catalog_faults": """WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS path, * FROM part), d AS (SELECT * FROM p WHERE k%13<>0)
      SELECT path, '' AS place, 'json' AS rule FROM p WHERE k%13=0 UNION ALL SELECT path, '/id', 'pattern' FROM d WHERE k%7=0 UNION ALL SELECT path, '', 'required' FROM d WHERE k%5=0
      UNION ALL SELECT path, '/title', 'maxLength' FROM d WHERE k%5<>0 AND length(p_name)>11 UNION ALL SELECT path, '/size', 'maximum' FROM d WHERE p_size>40
      UNION ALL SELECT path, '/kinds/0', 'enum' FROM d WHERE p_type NOT IN ('SMALL','LARGE','PROMO') UNION ALL SELECT path, '/extra', 'additionalProperties' FROM d WHERE k%11=0""",
}
