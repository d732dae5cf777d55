"""Graph lookups with orders as documents, parts as entities and lineitems as mentions.

A line's number is its page; a part's name is the entity's text and its type the entity's type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import entities, graph, trigrams
from ledgerlens.plans import retrieve
from ledgerlens.session import scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = f"WITH {_CTE}{', ' + more if more else ''} {sql}"
        return fn

    return add


_CTE = "entities AS (SELECT p_partkey AS entity_id, p_name AS text, p_type AS type, CAST(p_size AS BIGINT) AS mention_count FROM part), mentions AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey AS document_id, l_partkey AS entity_id, l_linenumber AS page FROM lineitem), d AS (SELECT DISTINCT document_id, entity_id FROM mentions), name5 AS (SELECT p_name AS text, p_type AS type FROM part WHERE p_partkey = 5)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    entities = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("text"), F.col("p_type").alias("type"), F.col("p_size").cast("bigint").alias("mention_count"))
    mentions = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("page"))
    return entities, mentions


def _named(spark: SparkSession, sf_dir: str, key: int = 5) -> tuple[str, str]:
    row = table(spark, sf_dir, "part").where(F.col("p_partkey") == key).select("p_name", "p_type").first()
    return row.p_name, row.p_type


_FROM = "(SELECT e.entity_id FROM entities e JOIN name5 n ON lower(e.text) = lower(n.text))"


@query("graph_documents_mentioning", f"SELECT DISTINCT document_id FROM mentions WHERE entity_id IN {_FROM} ORDER BY 1 LIMIT 100")
def graph_documents_mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.documents_mentioning(*_graph(spark, sf_dir), _named(spark, sf_dir)[0].upper())


@query("graph_documents_fuzzy", "SELECT DISTINCT document_id FROM mentions JOIN entities USING (entity_id) WHERE contains(lower(text), 'ring') ORDER BY 1 LIMIT 50")
def graph_documents_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.documents_mentioning(*_graph(spark, sf_dir), "Ring", fuzzy=True, limit=50)


@query("graph_documents_typed", "SELECT DISTINCT document_id FROM mentions JOIN entities e USING (entity_id) JOIN name5 n ON lower(e.text) = lower(n.text) AND e.type = n.type ORDER BY 1 LIMIT 100")
def graph_documents_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, kind = _named(spark, sf_dir)
    return graph.documents_mentioning(*_graph(spark, sf_dir), text, kind)


@query("graph_document_pages", f"SELECT document_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM mentions WHERE entity_id IN {_FROM} GROUP BY 1 ORDER BY 1 LIMIT 100")
def graph_document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.pages_mentioning(*_graph(spark, sf_dir), _named(spark, sf_dir)[0])
    return rows.select("document_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


_CO = f"SELECT b.entity_id, count(DISTINCT b.document_id) AS n FROM d a JOIN d b ON a.document_id = b.document_id AND a.entity_id <> b.entity_id WHERE a.entity_id IN {_FROM} GROUP BY 1"


@query("graph_related_1hop", f"SELECT c.entity_id, text, type, n AS shared_docs FROM ({_CO}) c JOIN entities USING (entity_id) ORDER BY n DESC, text, c.entity_id LIMIT 50")
def graph_related_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(*_graph(spark, sf_dir), _named(spark, sf_dir)[0])


@query(
    "graph_related_2hop",
    f"SELECT x.entity_id, text, type, n AS shared_docs FROM (SELECT m4.entity_id, count(DISTINCT m4.document_id) AS n FROM mentions m1 JOIN mentions m2 ON m1.document_id = m2.document_id AND m1.entity_id <> m2.entity_id JOIN mentions m3 ON m3.entity_id = m2.entity_id AND m3.edge_id <> m2.edge_id JOIN mentions m4 ON m4.document_id = m3.document_id AND m4.entity_id <> m3.entity_id AND m4.entity_id <> m1.entity_id WHERE m1.entity_id IN {_FROM} GROUP BY 1) x JOIN entities USING (entity_id) ORDER BY n DESC, text, x.entity_id LIMIT 50",
)
def graph_related_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(*_graph(spark, sf_dir), _named(spark, sf_dir)[0], hops=2)


@query("graph_entities_in_document", "SELECT entity_id, text, type, count(*) AS mentions FROM mentions JOIN entities USING (entity_id) WHERE document_id = 7 GROUP BY 1, 2, 3 ORDER BY 4 DESC, 2, 1 LIMIT 100")
def graph_entities_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities_in(*_graph(spark, sf_dir), 7)


@query("graph_cooccurring", f"SELECT c.entity_id, text, type, n AS co_occurrences FROM ({_CO}) c JOIN entities USING (entity_id) WHERE n >= 2 ORDER BY n DESC, text, c.entity_id LIMIT 50")
def graph_cooccurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_occurring(*_graph(spark, sf_dir), _named(spark, sf_dir)[0])


@query("graph_entity_search", "SELECT entity_id, text, type, mention_count FROM entities WHERE contains(lower(text), 'g') ORDER BY mention_count DESC, text, entity_id LIMIT 10")
def graph_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(_graph(spark, sf_dir)[0], "G")


@query("graph_type_summary", "SELECT type, count(*) AS entities FROM entities GROUP BY 1")
def graph_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_type(_graph(spark, sf_dir)[0])


@query("graph_stats", "SELECT (SELECT count(*) FROM entities) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM mentions) AS relationships, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM orders) AS documents, (SELECT count(DISTINCT type) FROM entities) AS types")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(*_graph(spark, sf_dir), table(spark, sf_dir, "orders"))


@query("graph_find_by_text", "SELECT e.entity_id, e.text FROM entities e JOIN name5 n ON e.text = n.text ORDER BY 1 LIMIT 1")
def graph_find_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_exact_text(_graph(spark, sf_dir)[0], _named(spark, sf_dir)[0]).select("entity_id", "text")


@query("graph_of_document", "SELECT text, page, mention_count FROM mentions JOIN entities USING (entity_id) WHERE document_id = 9")
def graph_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_document(*_graph(spark, sf_dir), 9).select("text", "page", "mention_count")


_REACH = "hop1 AS (SELECT DISTINCT b.entity_id FROM d a JOIN d b USING (document_id) WHERE a.entity_id IN (SELECT entity_id FROM entities WHERE text IN (SELECT text FROM name5))), goal AS (SELECT entity_id FROM entities WHERE lower(text) = (SELECT lower(p_name) FROM part WHERE p_partkey = 150)), hop2 AS (SELECT DISTINCT b.entity_id FROM d a JOIN d b USING (document_id) WHERE a.entity_id IN (SELECT entity_id FROM hop1)), hop3 AS (SELECT DISTINCT b.entity_id FROM d a JOIN d b USING (document_id) WHERE a.entity_id IN (SELECT entity_id FROM hop2))"


@query(
    "graph_shortest_path_len",
    "SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM goal WHERE entity_id IN (SELECT entity_id FROM hop1)) THEN 2 WHEN EXISTS (SELECT 1 FROM goal WHERE entity_id IN (SELECT entity_id FROM hop2)) THEN 4 ELSE 6 END AS INTEGER) AS path_length",
    _REACH,
)
def graph_shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_length(*_graph(spark, sf_dir), _named(spark, sf_dir)[0], _named(spark, sf_dir, 150)[0])


@query("merge_entities", "SELECT type, text, CAST(sum(n) AS DOUBLE) AS mention_count FROM (SELECT type, text, mention_count AS n FROM entities UNION ALL SELECT type, text, 1 FROM mentions JOIN entities USING (entity_id)) GROUP BY 1, 2")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions = _graph(spark, sf_dir)
    known = entities.select("type", "text", "mention_count", F.lit("old").alias("source_document"), F.lit(1.0).alias("confidence"))
    found = mentions.join(entities, "entity_id").select("type", "text", F.col("document_id").cast("string").alias("source_document"), F.lit(0.9).alias("confidence"))
    return graph.merged_entities(known, found).select("type", "text", F.col("mention_count").cast("double").alias("mention_count"))


@query("merge_mentions", "SELECT DISTINCT document_id, entity_id, page FROM (SELECT document_id, entity_id, page FROM mentions UNION ALL SELECT m.document_id, e.entity_id, m.page FROM found m JOIN entities e ON e.text = m.text)", "found AS (SELECT c.c_custkey AS document_id, p.p_name AS text, p.p_size AS page FROM customer c JOIN part p ON p.p_partkey = c.c_custkey)")
def merge_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions = _graph(spark, sf_dir)
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    found = c.join(p, c.c_custkey == p.p_partkey).select(F.col("c_custkey").alias("document_id"), F.col("p_name").alias("text"), F.col("p_size").alias("page"))
    return graph.merged_mentions(mentions, entities, found)


@query("delete_document_mentions", "SELECT edge_id FROM mentions WHERE document_id <> 7")
def delete_document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_document(_graph(spark, sf_dir)[1], 7).select("edge_id")


@query("merge_properties", "SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 'a=new' ELSE 'a=old' END || ';b=' || s_name || CASE WHEN s_acctbal < 0 THEN ';c=x' ELSE '' END AS props FROM supplier")
def merge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_suppkey").alias("k"), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("s_name")).alias("props"))
    new = s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"), F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("x")).alias("props"))
    merged = graph.merged_properties(old, new, ["k"])
    return merged.select("k", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("props"))


@query(
    "merge_documents",
    "SELECT s_suppkey AS document_id, CASE WHEN s_suppkey % 3 = 0 THEN 'old' END AS note, CASE WHEN s_suppkey % 2 = 0 THEN coalesce(CASE WHEN s_suppkey % 4 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 0 THEN 'known' END) ELSE 'known' END AS title,"
    " CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 9 END AS created_at, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 9 END AS updated_at FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0",
)
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    known = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("document_id"), F.lit("old").alias("note"), F.lit("known").alias("title"), F.lit(1).alias("created_at"), F.lit(None).cast("int").alias("updated_at"))
    found = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("document_id"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).alias("title"))
    return graph.merged_documents(known, found, F.lit(9))


@query("entity_dedup", "SELECT lower(l_shipmode_like) AS text, count(*) AS mention_count FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag) ELSE lower(l_returnflag) END || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag"))
    found = li.select(F.concat(flag, "l_linestatus").alias("text"), F.lit("Concept").alias("type"), F.lit(1.0).alias("confidence"), "l_orderkey", "l_linenumber")
    return graph.merged_by_text(found, ["l_orderkey", "l_linenumber"]).select(F.lower("text").alias("text"), "mention_count")


#: A question that names two parts, and what the graph knows of them and of the five entities nearest to each.
_KG = f"""
    named AS (SELECT p_name AS text, min(CASE p_partkey WHEN 5 THEN 0 ELSE 1 END) AS seq FROM part WHERE p_partkey IN (5, 12) GROUP BY 1),
    start AS (SELECT DISTINCT n.seq, m.document_id, m.entity_id FROM named n JOIN entities e ON lower(e.text) = lower(n.text) JOIN mentions m USING (entity_id)),
    shared AS (SELECT s.seq, d.entity_id, count(DISTINCT d.document_id) AS shared_docs FROM start s JOIN d ON d.document_id = s.document_id AND d.entity_id <> s.entity_id GROUP BY 1, 2),
    best AS (SELECT s.seq, row_number() OVER w AS n, e.text, e.type, shared_docs FROM shared s JOIN entities e USING (entity_id) WINDOW w AS (PARTITION BY s.seq ORDER BY shared_docs DESC, e.text, entity_id) QUALIFY n <= 5),
    names AS (SELECT seq, 0 AS near, 0 AS n, text, 'Product' AS type, 'direct_mention' AS match_type, NULL AS related_to, NULL AS shared_docs FROM named
        UNION ALL SELECT b.seq, 1, b.n, b.text, b.type, 'related_via', n.text, b.shared_docs FROM best b JOIN named n USING (seq)),
    met AS (SELECT x.*, m.document_id, m.page FROM names x JOIN entities e ON contains(lower(e.text), lower(x.text)) JOIN mentions m USING (entity_id)),
    each AS (SELECT seq, near, n, text, type, match_type, related_to, shared_docs, document_id, list(DISTINCT page) AS pages FROM met GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9),
    first AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY seq, near, n ORDER BY document_id) <= 100)
"""


@query("entity_contains_index", "SELECT 'bolt' AS asked, entity_id, text FROM entities WHERE contains(lower(text), 'd bolt') UNION ALL SELECT 'OL', entity_id, text FROM entities WHERE contains(lower(text), 'ol')")
def entity_contains_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lookups of a stored index of trigrams; the second text is too short for it."""
    folder = scratch(spark, "names")
    trigrams.store_names(_graph(spark, sf_dir)[0], folder)
    first, second = (trigrams.names_with(spark, folder, asked).select(F.lit(name).alias("asked"), "entity_id", "text") for name, asked in (("bolt", "D Bolt"), ("OL", "OL")))
    return first.union(second)


@query(
    "kg_search",
    "SELECT document_id, min_by(text, seq * 100 + near * 10 + n) AS matched_entity, min_by(type, seq * 100 + near * 10 + n) AS entity_type, min_by(match_type, seq * 100 + near * 10 + n) AS match_type,"
    " arg_min_null(related_to, seq * 100 + near * 10 + n) AS related_to, arg_min_null(shared_docs, seq * 100 + near * 10 + n) AS shared_docs, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages FROM first GROUP BY 1",
    _KG,
)
def kg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, mentions = _graph(spark, sf_dir)
    first, second = _named(spark, sf_dir, 5)[0], _named(spark, sf_dir, 12)[0]
    patterns = nodes.select(F.lit("PRODUCT").alias("label"), F.col("text").alias("pattern"), F.lit("token").alias("kind")).distinct()
    corpus = retrieve.Corpus(nodes, nodes, nodes, mentions, patterns)
    found = retrieve.Retriever(corpus).evidence(f"How do the {first} and the {second} compare?", None, True)
    return found.withColumn("pages", F.array_join("pages", ","))


#: Patterns made of the benchmark's items: phrases of three and of two words, and single words in any case.
_WORDS = "regexp_extract_all({}, '[A-Za-z0-9&./-]*[A-Za-z0-9]')"
_ITEM = _WORDS.format("text")
_PATTERNS = f"""
    SELECT DISTINCT 'ORG' AS label, array_to_string(w[k:k + 2], ' ') AS pattern, 'phrase' AS kind, 3 AS n FROM (SELECT {_ITEM} AS w FROM benchmark), (VALUES (1), (2), (6), (11)) v(k) WHERE len(w) >= k + 2
    UNION SELECT DISTINCT 'LAW', array_to_string(w[k:k + 1], ' '), 'phrase', 2 FROM (SELECT {_ITEM} AS w FROM benchmark), (VALUES (2), (4), (9)) v(k) WHERE len(w) >= k + 1
    UNION SELECT DISTINCT 'PRODUCT', lower(w[k]), 'token', 1 FROM (SELECT {_ITEM} AS w FROM benchmark), (VALUES (1), (5), (8), (10)) v(k) WHERE len(w) >= k
"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.expr("regexp_extract_all(text, '[A-Za-z0-9&./-]*[A-Za-z0-9]', 0)")
    items = table(spark, sf_dir, "benchmark").select(w.alias("w"))
    out = None
    for label, kind, n, starts in (("ORG", "phrase", 3, (1, 2, 6, 11)), ("LAW", "phrase", 2, (2, 4, 9)), ("PRODUCT", "token", 1, (1, 5, 8, 10))):
        some = items.select(F.explode(F.array(*map(F.lit, starts))).alias("k"), "w").where(F.size("w") >= F.col("k") + n - 1)
        said = F.array_join(F.slice("w", F.col("k"), n), " ")
        rows = some.select(F.lit(label).alias("label"), (F.lower(said) if kind == "token" else said).alias("pattern"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _apart(n: int, free: str) -> str:
    """Starts of patterns of n words in each document that others have left free, each taking its words, from left to right."""
    greedy = f"list_reduce(list_transform(list_sort(list(i)), lambda x: [x]), lambda a, b: CASE WHEN b[1] >= a[-1] + {n} THEN list_concat(a, b) ELSE a END)"
    return f"SELECT r, unnest({greedy}) AS i, {n} AS n FROM (SELECT h.r, h.i FROM hits h WHERE h.n = {n}{free}) GROUP BY r"


_FREE = " AND NOT EXISTS (SELECT 1 FROM {t} t WHERE t.r = h.r AND t.i < h.i + h.n AND h.i < t.i + t.n)"
_ENTITIES = f"""
    p AS ({_PATTERNS}), read AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    x AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM read),
    hits AS (SELECT DISTINCT r, i, p.n FROM (SELECT r, i, 3 AS n, array_to_string(w[i:i + 2], ' ') AS s FROM x WHERE i + 2 <= len(w) UNION ALL SELECT r, i, 2, array_to_string(w[i:i + 1], ' ') FROM x WHERE i + 1 <= len(w) UNION ALL SELECT r, i, 1, lower(w[i]) FROM x) y JOIN p ON p.n = y.n AND p.pattern = y.s),
    three AS ({_apart(3, "")}), two AS ({_apart(2, _FREE.format(t="three"))}), longer AS (SELECT * FROM three UNION ALL SELECT * FROM two), one AS ({_apart(1, _FREE.format(t="longer"))}),
    found AS (SELECT read.doc_id, t.i - 1 AS position, array_to_string(read.w[t.i:t.i + t.n - 1], ' ') AS raw, CASE n WHEN 3 THEN 'Organization' WHEN 2 THEN 'Regulation' ELSE 'Product' END AS type
        FROM (SELECT * FROM longer UNION ALL SELECT * FROM one) t JOIN read USING (r)),
    kept AS (SELECT * FROM found WHERE length(raw) BETWEEN 2 AND 100)
"""


@query("entity_extraction", "SELECT doc_id, count(*) AS mentions, md5(string_agg(CAST(position AS VARCHAR) || ' ' || type || ' ' || raw, ',' ORDER BY position)) AS digest FROM kept GROUP BY 1", _ENTITIES)
def entity_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    found = entities.found_by_page(pages, _patterns(spark, sf_dir)).where(F.size("hits") > 0)
    # Between an entity's words there may be white space of any kind, which its raw text has.
    words = "IF(h.size = 1, h.raw_text, array_join(regexp_extract_all(h.raw_text, '[A-Za-z0-9&./-]*[A-Za-z0-9]', 0), ' '))"
    said = F.expr(f"transform(hits, h -> struct(h.position AS position, CAST(h.position AS string) || ' ' || h.type || ' ' || {words} AS said))")
    rows = found.groupBy(F.col("document_id").alias("doc_id")).agg(F.sum(F.size("hits")).alias("mentions"), F.sort_array(F.flatten(F.collect_list(said))).alias("all"))
    return rows.select("doc_id", "mentions", F.md5(F.array_join(F.col("all.said"), ",")).alias("digest"))


@query(
    "entity_index_statistics",
    "SELECT (SELECT count(*) FROM documents WHERE doc_id % 4 > 0) AS documents_processed, (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS documents_skipped, (SELECT count(*) FROM documents WHERE doc_id % 4 > 0) AS total_pages,"
    " count(*) AS total_entity_mentions, count(DISTINCT lower(raw)) AS unique_entities, count(DISTINCT (doc_id, lower(raw))) AS relationships_created FROM kept WHERE doc_id % 4 > 0",
    _ENTITIES,
)
def entity_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the documents that the graph doesn't hold: every fourth one is there already."""
    documents = table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id"))
    wanted = entities.needs_entities(documents, documents.where("doc_id % 4 = 0"))
    pages = wanted.select("document_id", F.lit(1).alias("page"), "text")
    found = entities.found_entities(pages, _patterns(spark, sf_dir)).withColumn("text", F.array_join(F.expr("regexp_extract_all(raw_text, '[A-Za-z0-9&./-]*[A-Za-z0-9]', 0)"), " "))
    return entities.indexing_statistics(documents, wanted, pages, found)
