"""Lookups on the property graph of documents that mention entities.

Tables: entities (entity_id, text, type, mention_count), mentions (edge_id, document_id,
entity_id, page) and documents (document_id, ...). Every lookup starts from the few nodes it is asked about and
joins outwards, so what is shuffled are the edges near them; the entity side is small and left to
Spark to broadcast by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many rows lookups return, and the longest path.
DOCUMENTS, RELATED, CO_OCCURRING, FOUND, HOPS = 100, 50, 50, 10, 5


def is_named(text: str, kind: str | None = None, fuzzy: bool = False) -> Column:
    """Entities with a text, or if ``fuzzy`` one that holds it, in any case; of a type, if that is given."""
    own, given = F.lower("text"), F.lower(F.lit(text))
    met = F.contains(own, given) if fuzzy else own == given
    return met & (F.col("type") == kind) if kind else met


def _edges(entities: DataFrame, mentions: DataFrame, text: str, kind: str | None, fuzzy: bool) -> DataFrame:
    return mentions.join(entities.where(is_named(text, kind, fuzzy)).select("entity_id"), "entity_id")


def documents_mentioning(entities: DataFrame, mentions: DataFrame, text: str, kind: str | None = None, fuzzy: bool = False, limit: int = DOCUMENTS) -> DataFrame:
    """(document_id), in order of ids."""
    return _edges(entities, mentions, text, kind, fuzzy).select("document_id").distinct().orderBy("document_id").limit(limit)


def pages_mentioning(entities: DataFrame, mentions: DataFrame, text: str, kind: str | None = None, fuzzy: bool = False, limit: int = DOCUMENTS) -> DataFrame:
    """(document_id, pages), pages in order and without nulls."""
    found = _edges(entities, mentions, text, kind, fuzzy).groupBy("document_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return found.orderBy("document_id").limit(limit)


def _ranked(rows: DataFrame, count: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col(count).desc(), "text", "entity_id").limit(limit)


def co_mentioned(entities: DataFrame, mentions: DataFrame, text: str, kind: str | None = None, fuzzy: bool = False) -> DataFrame:
    """(entity_id, shared_docs): entities mentioned in documents that mention a named one, by nodes, not texts."""
    start = _edges(entities, mentions, text, kind, fuzzy).select("document_id", F.col("entity_id").alias("_from")).distinct()
    others = mentions.select("document_id", "entity_id").distinct().join(start, "document_id").where("entity_id <> _from")
    return others.groupBy("entity_id").agg(F.countDistinct("document_id").alias("shared_docs"))


def related(entities: DataFrame, mentions: DataFrame, text: str, kind: str | None = None, hops: int = 1, limit: int = RELATED) -> DataFrame:
    """(entity_id, text, type, shared_docs): entities one document away or, for any other ``hops``, two.

    Two away goes over a third entity: named -d1- middle -d2- other. All three differ, and the
    two edges of the middle differ, so that one document will do if it mentions the middle twice. Documents d2 are counted, without listing paths.
    """
    if hops == 1:
        found = co_mentioned(entities, mentions, text, kind)
    else:
        found = _two_away(mentions, _edges(entities, mentions, text, kind, False))
    return _ranked(found.join(entities.select("entity_id", "text", "type"), "entity_id"), "shared_docs", limit).select("entity_id", "text", "type", "shared_docs")


def _two_away(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, shared_docs): what lies two documents away from the entities of the ``edges``.

    No path is listed. Of a middle's edges near a start only the least and the greatest are kept: some edge differs from a given one if these two
    differ, or the one there is does. Of a document's middles the same, which tells whether one differs from the end. So there is a row for
    each (start, middle), then for each (start, edge of a middle) and (start, document), and all are added up by tasks before they are shuffled.
    Each join makes many rows of few bytes, which its task adds up in memory, so that its partitions keep their number and aren't put together by size.
    """
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = edges.select(F.col("entity_id").alias("_from"), "document_id").distinct()
    near = mentions.repartition(n, "document_id").join(start.repartition(n, "document_id"), "document_id").where("entity_id <> _from").groupBy("_from", F.col("entity_id").alias("_mid")).agg(F.min("edge_id").alias("_lo"), F.max("edge_id").alias("_hi"))
    beyond = mentions.select(F.col("entity_id").alias("_mid"), "edge_id", "document_id").repartition(n, "_mid").join(near.repartition(n, "_mid"), "_mid").where("_lo <> _hi OR edge_id <> _lo")
    reached = beyond.groupBy("_from", "document_id").agg(F.min("_mid").alias("_first"), F.max("_mid").alias("_last"))
    ends = mentions.select("document_id", "entity_id").distinct().repartition(n, "document_id").join(reached.repartition(n, "document_id"), "document_id").where("entity_id <> _from AND (_first <> _last OR entity_id <> _first)")
    return ends.groupBy("entity_id").agg(F.countDistinct("document_id").alias("shared_docs"))


def co_occurring(entities: DataFrame, mentions: DataFrame, text: str, least: int = 2, limit: int = CO_OCCURRING) -> DataFrame:
    found = co_mentioned(entities, mentions, text).where(F.col("shared_docs") >= least).withColumnRenamed("shared_docs", "co_occurrences")
    return _ranked(found.join(entities.select("entity_id", "text", "type"), "entity_id"), "co_occurrences", limit).select("entity_id", "text", "type", "co_occurrences")


def evidence_of(entities: DataFrame, mentions: DataFrame, asked: DataFrame, near: bool = False, limit: int = DOCUMENTS, most: int = 5) -> DataFrame:
    """What the graph knows of a question's entities (seq, text, type), few of them: documents with their pages, and why they were found.

    (document_id, matched_entity, entity_type, match_type, related_to, shared_docs, pages). A document's first evidence stays: of the first entity that it mentions,
    an entity whose text holds the asked one counting too. With ``near``, ``most`` entities that share documents with an asked one are looked up
    after it. Pages of all evidence are merged. Each entity finds ``limit`` documents at most, in order of ids.
    """
    none = lambda kind: F.lit(None).cast(kind)
    names = asked.select(F.struct(F.col("seq").cast("int"), F.lit(0).alias("near"), F.lit(0).alias("n")).alias("order"), "text", F.col("type"), F.lit("direct_mention").alias("match_type"), none("string").alias("related_to"), none("bigint").alias("shared_docs"))
    if near:
        start = mentions.join(entities.join(F.broadcast(asked.select("seq", F.lower("text").alias("_t"))), F.lower("text") == F.col("_t")).select("entity_id", "seq"), "entity_id")
        start = start.select("seq", "document_id", F.col("entity_id").alias("_from")).distinct()
        others = mentions.select("document_id", "entity_id").distinct().join(start, "document_id").where("entity_id <> _from")
        shared = others.groupBy("seq", "entity_id").agg(F.countDistinct("document_id").alias("shared_docs")).join(entities.select("entity_id", "text", "type"), "entity_id")
        rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.col("shared_docs").desc(), "text", "entity_id"))
        best = shared.withColumn("n", rank).where(F.col("n") <= most).join(F.broadcast(asked.select("seq", F.col("text").alias("related_to"))), "seq")
        names = names.unionByName(best.select(F.struct(F.col("seq").cast("int"), F.lit(1).alias("near"), "n").alias("order"), "text", "type", F.lit("related_via").alias("match_type"), "related_to", "shared_docs"))
    # At most 1 + most names for each asked entity.
    known = entities.select("entity_id", F.lower("text").alias("_own")).join(F.broadcast(names), F.contains("_own", F.lower("text")))
    found = mentions.join(known.drop("_own"), "entity_id")
    why = ["order", "text", "type", "match_type", "related_to", "shared_docs"]
    each = found.groupBy(*why, "document_id").agg(F.collect_set("page").alias("pages"))
    first = F.row_number().over(Window.partitionBy("order").orderBy("document_id"))
    each = each.withColumn("_n", first).where(F.col("_n") <= limit)
    evidence = F.min_by(F.struct(F.col("text").alias("matched_entity"), F.col("type").alias("entity_type"), "match_type", "related_to", "shared_docs"), F.col("order")).alias("e")
    return each.groupBy("document_id").agg(evidence, F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")).select("document_id", "e.*", "pages")


def entities_in(entities: DataFrame, mentions: DataFrame, document_id: object, kind: str | None = None, limit: int = DOCUMENTS) -> DataFrame:
    """(entity_id, text, type, mentions) of one document."""
    counts = mentions.where(F.col("document_id") == document_id).groupBy("entity_id").agg(F.count("*").alias("mentions"))
    own = entities.where(F.col("type") == kind) if kind else entities
    return _ranked(counts.join(own.select("entity_id", "text", "type"), "entity_id"), "mentions", limit).select("entity_id", "text", "type", "mentions")


def search(entities: DataFrame, text: str, limit: int = FOUND) -> DataFrame:
    """Entities whose text holds this one, the most mentioned first."""
    found = entities.where(is_named(text, fuzzy=True)).withColumn("mention_count", F.coalesce("mention_count", F.lit(1)))
    return _ranked(found, "mention_count", limit).select("entity_id", "text", "type", "mention_count")


def by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("entities"))


def stats(entities: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """(nodes, relationships, entities, documents, types), also for a graph without edges."""
    e = entities.agg(F.count("*").alias("entities"), F.countDistinct("type").alias("types"))
    m = mentions.agg(F.count("*").alias("relationships"))
    d = documents.agg(F.count("*").alias("documents"))
    one = [x.withColumn("_k", F.lit(1)) for x in (e, m, d)]
    return one[0].join(one[1], "_k").join(one[2], "_k").select((F.col("entities") + F.col("documents")).alias("nodes"), "relationships", "entities", "documents", "types")


def by_exact_text(entities: DataFrame, text: str) -> DataFrame:
    return entities.where(F.col("text") == text).orderBy("entity_id").limit(1)


def of_document(entities: DataFrame, mentions: DataFrame, document_id: object) -> DataFrame:
    """One row for each edge of a document, by its entity's mention count."""
    rows = mentions.where(F.col("document_id") == document_id).join(entities, "entity_id")
    return rows.orderBy(F.col("mention_count").desc_nulls_last(), "text", "page")


def document_exists(documents: DataFrame, document_id: object) -> bool:
    return not documents.where(F.col("document_id") == document_id).isEmpty()


def path_length(entities: DataFrame, mentions: DataFrame, start: str, end: str, hops: int = HOPS) -> DataFrame:
    """(path_length): edges of a shortest path between two texts, no row if there is none within 2 x ``hops``.

    Breadth first, from the start's nodes: each round joins the newest nodes only, first to documents, then to entities, and
    drops what was reached before. Rounds are checkpointed; only whether the end was reached comes to the driver.
    """
    spark = entities.sparkSession
    frontier = entities.where(is_named(start)).select("entity_id")
    ends = entities.where(is_named(end)).select("entity_id")
    pairs = mentions.select("document_id", "entity_id").distinct()
    schema = "path_length int"
    if not frontier.join(ends, "entity_id", "left_semi").isEmpty():
        return spark.createDataFrame([(0,)], schema)
    seen, read = frontier, pairs.select("document_id").limit(0)
    held: list[DataFrame] = []
    out: list[tuple] = []
    for hop in range(1, min(hops, HOPS) + 1):
        docs = pairs.join(frontier, "entity_id", "left_semi").select("document_id").distinct().join(read, "document_id", "left_anti")
        frontier = pairs.join(docs, "document_id", "left_semi").select("entity_id").distinct().join(seen, "entity_id", "left_anti")
        if spark.sparkContext.getCheckpointDir():
            frontier, docs = frontier.checkpoint(), docs.checkpoint()
        else:
            frontier, docs = frontier.persist(), docs.persist()
            held += [frontier, docs]
        if not frontier.join(ends, "entity_id", "left_semi").isEmpty():
            out = [(2 * hop,)]
            break
        if frontier.isEmpty():
            break
        seen, read = seen.union(frontier), read.union(docs)
    for df in held:
        df.unpersist()
    return spark.createDataFrame(out, schema)


def shortest_path(entities: DataFrame, mentions: DataFrame, start: str, end: str, hops: int = HOPS) -> DataFrame:
    """(position, kind, node): the nodes of a shortest path between two texts, entities and documents in turn; no rows if there is none within 2 x ``hops``.

    Breadth first, each level keeping for every entity found the least document and entity it was reached by; then back, a row a level.
    """
    spark = entities.sparkSession
    schema = "position int, kind string, node string"
    starts, ends = (entities.where(is_named(x)).select("entity_id") for x in (start, end))
    pairs = mentions.select("document_id", "entity_id").distinct()
    frontier = starts.select("entity_id", F.lit(None).cast(pairs.schema["document_id"].dataType).alias("document_id"), F.col("entity_id").alias("came"))
    levels, seen = [frontier], starts
    nodes: list[tuple] = []
    for _ in range(min(hops, HOPS) + 1):
        met = levels[-1].join(ends, "entity_id", "left_semi").orderBy("entity_id").first()
        if met is not None:
            nodes = [("entity", met.entity_id)]
            for level in levels[:0:-1]:
                row = level.where(F.col("entity_id") == nodes[-1][1]).first()
                nodes += [("document", row.document_id), ("entity", row.came)]
            break
        if len(levels) > min(hops, HOPS):
            break
        via = pairs.join(levels[-1].select(F.col("entity_id").alias("came")), pairs.entity_id == F.col("came")).groupBy("document_id").agg(F.min("came").alias("came"))
        found = pairs.join(via, "document_id").join(seen, "entity_id", "left_anti").groupBy("entity_id").agg(F.min(F.struct("document_id", "came")).alias("v")).select("entity_id", "v.document_id", "v.came")
        found = found.checkpoint() if spark.sparkContext.getCheckpointDir() else found.persist()
        levels.append(found)
        seen = seen.union(found.select("entity_id"))
    for level in levels[1:]:
        level.unpersist()
    return spark.createDataFrame([(i, kind, str(node)) for i, (kind, node) in enumerate(reversed(nodes))], schema)


# Writing


def merged_entities(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(type, text, mention_count, source_document, confidence): found mentions added to known entities by type and exact text."""
    new = found.groupBy("type", "text").agg(F.count("*").alias("mention_count"), F.min_by("source_document", "source_document").alias("source_document"), F.max("confidence").alias("confidence"))
    both = entities.select("type", "text", "mention_count", "source_document", "confidence", F.lit(0).alias("_new")).union(new.select("*", F.lit(1).alias("_new")))
    return both.groupBy("type", "text").agg(F.sum("mention_count").alias("mention_count"), F.min_by("source_document", "_new").alias("source_document"), F.min_by("confidence", "_new").alias("confidence"))


#: Finds, and entities, of one text that meet at once, at least and at most; and such meetings, as a multiple of the partitions of a shuffle.
BLOCK, LARGEST, MEETINGS = 2_000, 100_000, 2


def _partitions(rows: DataFrame) -> int:
    """A shuffle's partitions as a number: few bytes make many edges, so that partitions aren't to be put together by size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(found: DataFrame, texts: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``found`` and ``texts`` in blocks (text, _i, _j) of about ``block`` rows, each block of finds as often as its text has blocks of entities, and the other way round.

    ``2 / block`` of all edges is what they have as rows. A fixed block would let that grow with the square of the tables, so blocks grow with the root of the number of edges:
    that many meetings are made as tasks want, and each row is repeated as often in large tables as in small ones. Only above ``LARGEST``, which bounds what a task holds, are there more.
    """
    sizes = found.groupBy("text").agg(F.count("*").alias("_f")).join(texts.groupBy("text").agg(F.count("*").alias("_e")), "text")
    if block is None:
        # Decimals add up to the same in any order, so that both sides have the same blocks.
        edges = F.sum(F.col("_f").cast("decimal(19,0)") * F.col("_e").cast("decimal(19,0)")).cast("double")
        wanted = F.ceil(F.sqrt(edges / (MEETINGS * _partitions(found))))
        sizes = sizes.crossJoin(sizes.agg(F.least(F.greatest(wanted, F.lit(BLOCK)), F.lit(LARGEST)).alias("_block")))
    else:
        sizes = sizes.withColumn("_block", F.lit(block))
    blocks = lambda n: F.ceil(F.col(n) / F.col("_block")).cast("int").alias(n)
    sizes = sizes.select("text", blocks("_f"), blocks("_e"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    left = found.join(sizes, "text").select("document_id", "page", "text", deal("_f", "document_id", "page").alias("_i"), every("_e").alias("_j"))
    return left, texts.join(sizes, "text").select("entity_id", "text", every("_f").alias("_i"), deal("_e", "entity_id").alias("_j"))


def _crossed(found: DataFrame, texts: DataFrame, block: int | None = None) -> DataFrame:
    """(document_id, entity_id, page) of ``found`` (document_id, text, page) and ``texts`` (entity_id, text) of equal text.

    A text with many finds and many entities gives their product. Each block of finds meets each block of entities as a key of its own, so that no text is left to one task;
    the product itself isn't shuffled.
    """
    n, keys = _partitions(found), ["text", "_i", "_j"]
    left, right = (side.repartition(n, *keys) for side in _dealt(found, texts, block))
    return left.join(right, keys).select("document_id", "entity_id", "page")


def merged_mentions(mentions: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, entity_id, page), each once; found ones (document_id, text, page) go to all entities of the text, whatever their type.

    Where many entities have one text, the new edges are far more than what they are made of, and they aren't shuffled: finds and texts are each made
    distinct before they are joined, and known edges that would be made anew are left out by the texts of their entities. Only edges of entities with several texts are made distinct afterwards.
    Known edges are shuffled once, by page, and there made distinct and held against the finds; only those of pages with finds go on to their entities' texts.
    """
    kinds = mentions.select("document_id", "page").union(found.select("document_id", "page")).schema
    place = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]
    finds = found.select(*place, "text").where("text IS NOT NULL").distinct()
    texts = entities.where("text IS NOT NULL").groupBy("entity_id").agg(F.collect_set("text").alias("_texts"))
    one, more = (texts.where(where).select("entity_id", F.explode("_texts").alias("text")) for where in ("size(_texts) = 1", "size(_texts) > 1"))
    new = _crossed(finds, one).union(finds.join(more, "text").select("document_id", "entity_id", "page").distinct())
    at, n = F.xxhash64("document_id", "page"), _partitions(mentions)
    known = mentions.select(*place, "entity_id").repartition(n, at).withColumn("_at", at).distinct()
    pages = finds.repartition(n, at).groupBy(at.alias("_at"), F.col("document_id").alias("_d"), F.col("page").alias("_p")).agg(F.collect_set("text").alias("_found"))
    # Counted, so that a null equals a null while the hash, by which both sides lie already, is the only key of the join.
    met = (known["_at"] == pages["_at"]) & (F.col("document_id").eqNullSafe(F.col("_d")).cast("int") + F.col("page").eqNullSafe(F.col("_p")).cast("int") == 2)
    apart = known.join(pages, met, "left_anti")
    there = known.join(pages, met).select("document_id", "entity_id", "page", "_found")
    named = there.join(texts.select(F.col("entity_id").alias("_id"), "_texts"), F.col("entity_id").eqNullSafe(F.col("_id")), "left")
    kept = named.where(~F.coalesce(F.arrays_overlap("_texts", "_found"), F.lit(False)))
    return apart.select("document_id", "entity_id", "page").union(kept.select("document_id", "entity_id", "page")).union(new)


def without_document(mentions: DataFrame, document_id: object) -> DataFrame:
    """A document's edges go; entities and their counts stay."""
    return mentions.where(~(F.col("document_id") == document_id) | F.col("document_id").isNull())


def merged_properties(old: DataFrame, new: DataFrame, keys: list[str], properties: str = "props") -> DataFrame:
    """Relationships or documents by key with their property maps: new values over old ones."""
    both = old.select(*keys, F.col(properties).alias("_old")).join(new.select(*keys, F.col(properties).alias("_new")), keys, "full")
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("_new", F.create_map().cast("map<string,string>"))), k))
    return both.select(*keys, F.map_concat(kept, F.coalesce("_new", F.create_map().cast("map<string,string>"))).alias(properties))


def merged_documents(documents: DataFrame, found: DataFrame, at: Column, key: str = "document_id") -> DataFrame:
    """Documents with metadata set by those found: new ones get ``created_at``, known ones keep it and get ``updated_at``; metadata that isn't given stays. ``found`` has one row for each key."""
    given = [c for c in found.columns if c != key]
    old = documents.withColumn("_old", F.lit(True))
    new = found.select(key, *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_new"))
    both = old.join(new, key, "full")
    known, met = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    set_ = {c: F.coalesce(f"_new_{c}", *([F.col(c)] if c in documents.columns else [])) for c in given}
    rest = [c for c in documents.columns if c not in (key, *given, "created_at", "updated_at")]
    created = F.when(known, F.col("created_at")).otherwise(at)
    updated = F.when(known & met, at).otherwise(F.col("updated_at"))
    return both.select(key, *rest, *(c.alias(n) for n, c in set_.items()), created.alias("created_at"), updated.alias("updated_at"))


# Entities of one text


def merged_by_text(found: DataFrame, order: list[str], confidence: str = "confidence", kind: str = "type", keys: list[str] | None = None) -> DataFrame:
    """Entities of one text in any case as one: the most confident, of equals the first, with the number of them."""
    keys = [*(keys or []), "_key"]
    rows = found.withColumn("_key", F.lower("text"))
    best = F.min_by(F.struct("text", kind, confidence), F.struct((-F.col(confidence)).alias("c"), *order))
    return rows.groupBy(*keys).agg(best.alias("_b"), F.count("*").alias("mention_count")).select(*keys[:-1], "_b.*", "mention_count")
