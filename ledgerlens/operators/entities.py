"""Entities in texts, by a table of patterns as an automaton and by recognisers.

The patterns are sequences of words, kept as tries over words. All words of many texts go down a trie at once, as arrays: a step takes the places
that are still on a path one word further, so a text costs its words and what begins like a pattern. The automaton is built once, from a table of a checked
size, and broadcast; a larger table is parted into several, whose finds are brought together by page. Of finds that overlap the longer one stays, of equals the earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import entity_text
from ledgerlens.schema import LABELS

#: Words of texts and patterns. Characters that an entity has.
WORD = re.compile(r"[A-Za-z0-9&./-]*[A-Za-z0-9]")
SHORTEST, LONGEST = 2, 100
#: Characters of patterns that one automaton takes: some hundred bytes of Python for each pattern's word while it is built.
AUTOMATON_CHARS = 8 << 20
#: Bytes of texts that are read at a time; a longer text is read by itself.
PART_BYTES = 2 << 20

#: What a byte is to ``WORD``: 2 can end a word, 1 can only stand in it, 0 parts words.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"&./-")] = 1
_CLASS[[b for b in range(128) if chr(b).isalnum()]] = 2
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

Span = tuple[int, int, str]  # first character, character after the last, label


class Recogniser(Protocol):
    """A model that finds spans in texts; it is sent to tasks, and asked for many texts at once."""

    def spans(self, texts: list[str]) -> list[list[Span]]: ...


class Words(NamedTuple):
    """The words of some texts, one text after the other, and where they stand in the texts' joined bytes."""

    data: np.ndarray  # bytes of all texts
    texts: np.ndarray  # first byte of each text, and the end of the last
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after its last
    first: np.ndarray  # first word of each text, and the number of words
    said: pa.StringArray
    lower: pa.StringArray


def words_of(texts: pa.Array) -> Words:
    """What ``WORD`` finds in each of the texts, null having none."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    inside = kind > 0
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    # A text's end parts words too: a run over several texts is cut there.
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    begin = edges[:-1][inside[edges[:-1]]]
    end = edges[1:][inside[edges[:-1]]]
    late = np.flatnonzero(kind[end - 1] < 2)
    if len(late):
        ends = np.concatenate([[-1], np.flatnonzero(kind == 2)])
        stop = np.maximum(begin[late], ends[np.searchsorted(ends, end[late]) - 1] + 1)
        inside[_within(stop, end[late])] = False
        end[late] = stop
        begin, end = begin[end > begin], end[end > begin]
    said = _strings(data[inside], end - begin)
    lower = pa.StringArray.from_buffers(len(said), said.buffers()[1], pa.py_buffer(_LOWER[np.frombuffer(said.buffers()[2], np.uint8)]))
    return Words(data, offsets, begin, end, np.searchsorted(begin, offsets), said, lower)


def _within(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    size = end - begin
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - before, size)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Bytes that follow each other as strings of these sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


class _Trie:
    """Patterns (number of the label, words) as a trie whose edges are sorted by node and word."""

    def __init__(self, patterns: list[tuple[int, list[str]]]):
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in patterns for w in words))}
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, list[int]] = {}
        for label, words in patterns:
            node = 0
            for w in words:
                node = nodes.setdefault((node, vocabulary[w]), len(nodes) + 1)
            if node:
                ends.setdefault(node, []).append(label)
        self.words = pa.array(vocabulary, pa.string())
        keys = np.array([a * len(vocabulary) + w for a, w in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        #: The nodes below the first, by word.
        self.start = np.zeros(len(vocabulary), np.int64)
        for (a, w), n in nodes.items():
            if not a:
                self.start[w] = n
        self.inner = np.zeros(len(nodes) + 1, bool)
        self.inner[[a for a, _ in nodes]] = True
        #: Labels of a node's patterns: ``labels[at[node]:at[node + 1]]``.
        self.at = np.cumsum([0] + [len(ends.get(n, ())) for n in range(len(nodes) + 1)])
        self.labels = np.array([k for n in range(len(nodes) + 1) for k in ends.get(n, ())], np.int64)

    def finds(self, words: pa.StringArray, last: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(first words, number of words, labels) of what is found, by number of words. ``last``: for each word the end of its text."""
        if not len(self.keys):
            return
        ids = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        live = np.flatnonzero(ids >= 0)
        node, n = self.start[ids[live]], 1
        live, node = live[node > 0], node[node > 0]
        while len(live):
            many = self.at[node + 1] - self.at[node]
            total = int(many.sum())
            if total:
                step = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                yield np.repeat(live, many), n, self.labels[np.repeat(self.at[node], many) + step]
            on = self.inner[node] & (live + n < last[live])
            live, node = live[on], node[on]
            on = ids[live + n] >= 0
            live, node = live[on], node[on]
            key = node * len(self.words) + ids[live + n]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            live, node, n = live[on], self.child[at[on]], n + 1


class Automaton:
    """Patterns (label, words, exact): a trie over lower-cased words, and one over words as they are for exact patterns."""

    def __init__(self, patterns: list[tuple[str, list[str], bool]]):
        number = {label: k for k, label in enumerate(dict.fromkeys(label for label, *_ in patterns))}
        self.labels = list(number)
        self.exact = _Trie([(number[label], words) for label, words, exact in patterns if exact])
        self.folded = _Trie([(number[label], [w.lower() for w in words]) for label, words, exact in patterns if not exact])

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, number of the label) of every pattern in the texts, overlapping ones too; exact ones come first."""
        last = np.repeat(words.first[1:], np.diff(words.first))
        steps = [*self.exact.finds(words.said, last), *self.folded.finds(words.lower, last)]
        none = np.zeros(0, np.int64)
        at, labels = (np.concatenate([none, *(s[k] for s in steps)]) for k in (0, 2))
        return at, np.repeat([s[1] for s in steps] or none, [len(s[0]) for s in steps] or none).astype(np.int64), labels

    def finds(self, words: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first word, number of words, label) of every pattern in a text, overlapping ones too."""
        said = pa.array(words, pa.string())
        empty = np.zeros(0, np.int64)
        lower = pa.array(map(str.lower, words), pa.string())
        at, size, label = self.scan(Words(empty, empty, empty, empty, np.array([0, len(words)]), said, lower))
        yield from zip(at.tolist(), size.tolist(), (self.labels[k] for k in label.tolist()), strict=True)


def apart(finds: list[tuple], size: int) -> list[tuple]:
    """Of finds (first, length, ...) over ``size`` places those left when longer ones come first, then earlier ones, and each takes its places."""
    taken, out = bytearray(size), []
    for f in sorted(finds, key=lambda f: (-f[1], f[0])):
        if not any(taken[f[0] : f[0] + f[1]]):
            taken[f[0] : f[0] + f[1]] = b"\1" * f[1]
            out.append(f)
    return sorted(out)


def _blocks(patterns: DataFrame) -> list[list[tuple[str, list[str], bool]]]:
    """The patterns in blocks of at most ``AUTOMATON_CHARS``; equal patterns keep their first label."""
    rows = patterns.select("label", "pattern", "kind").where("pattern IS NOT NULL").groupBy("pattern", "kind").agg(F.min("label").alias("label"))
    out, size = [[]], 0
    for r in rows.orderBy("kind", "pattern").toLocalIterator():
        if size + len(r.pattern) > AUTOMATON_CHARS and out[-1]:
            out.append([])
            size = 0
        out[-1].append((r.label, WORD.findall(r.pattern), r.kind == "phrase"))
        size += len(r.pattern) + 8
    return out


def _left(at: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Which of finds over ``words`` places are left by the rule of ``apart``, in the order of their places; of those of one place and length the first."""
    taken, out = np.zeros(words, bool), []
    for n in np.unique(size)[::-1].tolist():
        own = np.flatnonzero(size == n)
        places, first = np.unique(at[own], return_index=True)
        # What is taken is at least as long, so it takes one of a find's two ends, if any.
        free = ~(taken[places] | taken[places + n - 1])
        places, own = places[free], own[first[free]]
        if n > 1 and (np.diff(places) < n).any():
            stay, end = [], 0
            for k, p in enumerate(places.tolist()):
                if p >= end:
                    stay.append(k)
                    end = p + n
            places, own = places[stay], own[stay]
        for k in range(n):
            taken[places + k] = True
        out.append(own)
    left = np.concatenate(out) if out else np.zeros(0, np.int64)
    return left[np.argsort(at[left])]


#: A find; its label becomes a type when all finds of its page are known.
_FIELDS = "position: int, size: int, {}: string, begin: int, end: int, raw_text: string"
_HITS, _TYPED = (f"array<struct<{_FIELDS.format(name)}>>" for name in ("label", "type"))
_HIT = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]


def _column(offsets: np.ndarray | list[int], fields: list[pa.Array], name: str) -> pa.ListArray:
    """Finds of each page as one column; ``name`` is that of the third field."""
    named = ["position", "size", name, "begin", "end", "raw_text"]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=named))


def _listed(hits: list[list[tuple]], typed: bool) -> pa.ListArray:
    """Hits of each page as one column, made field by field; with types, and without what isn't kept, if ``typed``."""
    if typed:
        hits = [[(p, n, _type(label), b, e, raw) for p, n, label, b, e, raw in page if _type(label) and SHORTEST <= e - b <= LONGEST] for page in hits]
    flat = [h for page in hits for h in page]
    fields = zip(*flat, strict=True) if flat else [()] * len(_HIT)
    return _column([0, *accumulate(map(len, hits))], [pa.array(v, t) for v, t in zip(fields, _HIT, strict=True)], "type" if typed else "label")


def _type(label: str | None) -> str | None:
    return LABELS.get(label.upper()) if label is not None else None


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in slices of some ``PART_BYTES`` of the third column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def found_by_page(pages: DataFrame, patterns: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(document_id, page, hits) of pages (document_id, page, text) by patterns (label, pattern, kind): a page's finds (position, size, type, begin, end, raw_text) by place.

    Patterns of kind ``phrase`` match as they are, those of kind ``token`` in any case; what stands between two words, if it is none, isn't looked at. What a recogniser finds is added where no pattern matched, with a size of 0 words. Entities of
    labels without a type, and of fewer than ``SHORTEST`` or more than ``LONGEST`` characters, are left out. Texts of null have none.
    A find is cut out of its text where it is found, so that texts aren't copied for each of their finds.
    """
    spark = pages.sparkSession
    blocks = _blocks(patterns)
    given = pages.select("document_id", "page", "text")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    whole = len(blocks) == 1
    keys = ["document_id", "page"] + ["text"] * (not whole)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", hits {_TYPED if whole else _HITS}"

    def scan(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Automaton(block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                for part in _parts(batch):
                    hits = _recognised(automaton, part.column(2), recogniser, whole) if recogniser is not None and last else _hits(automaton, part.column(2), whole)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], hits], names=[*keys, "hits"])

        last = block is blocks[-1]
        return given.mapInArrow(run, schema)

    scanned = scan(blocks[0])
    if whole:
        return scanned
    return _together([scanned, *map(scan, blocks[1:])], f"document_id {kinds['document_id']}, page {kinds['page']}, hits {_TYPED}")


def found_entities(pages: DataFrame, patterns: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(document_id, page, raw_text, text, type, position, begin, end): what ``found_by_page`` finds, a row for each find; ``text`` is normalised."""
    each = found_by_page(pages, patterns, recogniser).select("document_id", "page", F.explode("hits").alias("h"))
    found = each.select("document_id", "page", "h.raw_text", "h.type", "h.position", "h.begin", "h.end")
    return found.select("document_id", "page", "raw_text", entity_text(F.col("raw_text"), F.col("type")).alias("text"), "type", "position", "begin", "end")


class _Found(NamedTuple):
    """Finds by place: their text, place and words in it, number of the label, characters and bytes."""

    text: np.ndarray
    position: np.ndarray
    size: np.ndarray
    label: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    raw: pa.StringArray


def _chars(words: Words) -> np.ndarray | None:
    """The number of characters before each byte; none, if each is one."""
    if not len(words.data) or words.data.max() < 128:
        return None
    return np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)])


def _found(automaton: Automaton, words: Words, chars: np.ndarray | None, whole: bool, kept: bool) -> _Found:
    """Finds in the texts: those apart, if this is the ``whole`` of the patterns; only ones with a type and of the right length, if ``kept``."""
    at, size, label = automaton.scan(words)
    order = _left(at, size, len(words.begin)) if whole else np.argsort(at, kind="stable")
    at, size, label = at[order], size[order], label[order]
    text = np.searchsorted(words.first, at, "right") - 1
    begin, end = words.begin[at], words.end[at + size - 1]
    start = words.texts[text]
    first, after = (begin - start, end - start) if chars is None else (chars[begin] - chars[start], chars[end] - chars[start])
    if kept:
        typed = np.array([_type(k) is not None for k in automaton.labels], bool)
        on = (after - first >= SHORTEST) & (after - first <= LONGEST)
        on[on] = typed[label[on]]
        text, at, size, label, begin, end, first, after = (x[on] for x in (text, at, size, label, begin, end, first, after))
    return _Found(text, at - words.first[text], size, label, first, after, _strings(words.data[_within(begin, end)], end - begin))


def _hits(automaton: Automaton, texts: pa.Array, whole: bool) -> pa.ListArray:
    """Finds of each text, with types if this is the ``whole`` of the patterns."""
    words = words_of(texts)
    f = _found(automaton, words, _chars(words), whole, whole)
    names = pa.array([_type(k) for k in automaton.labels] if whole else automaton.labels, pa.string())
    fields = [f.position, f.size, names.take(pa.array(f.label)), f.begin, f.end, f.raw]
    offsets = np.searchsorted(f.text, np.arange(len(texts) + 1))
    return _column(offsets, [pa.array(x, t) if isinstance(x, np.ndarray) else x for x, t in zip(fields, _HIT, strict=True)], "type" if whole else "label")


def _recognised(automaton: Automaton, texts: pa.Array, recogniser: Recogniser, whole: bool) -> pa.ListArray:
    """Finds of each text, and a recogniser's with a size of 0 words."""
    words = words_of(texts)
    chars = _chars(words)
    f = _found(automaton, words, chars, whole, False)
    ruled: list[list[tuple]] = [[] for _ in range(len(texts))]
    for text, *find in zip(f.text.tolist(), f.position.tolist(), f.size.tolist(), (automaton.labels[k] for k in f.label.tolist()), f.begin.tolist(), f.end.tolist(), f.raw.to_pylist(), strict=True):
        ruled[text].append(tuple(find))
    plain, out = [t or "" for t in texts.to_pylist()], []
    for k, (text, spans) in enumerate(zip(plain, recogniser.spans(plain), strict=True)):
        ends = words.end[words.first[k] : words.first[k + 1]]
        ends = (ends - words.texts[k] if chars is None else chars[ends] - chars[words.texts[k]])
        own = [(int(np.searchsorted(ends, b, "right")), 0, label, b, e, text[b:e]) for b, e, label in spans if label.upper() in LABELS]
        out.append(_added(ruled[k], own) if whole else ruled[k] + own)
    return _listed(out, whole)


def _added(ruled: list[tuple], own: list[tuple]) -> list[tuple]:
    """Patterns' finds, and a recogniser's that overlap none of these nor an earlier one of its own."""
    out = list(ruled)
    for f in sorted(own, key=lambda f: (f[3], -f[4])):
        if all(f[4] <= o[3] or f[3] >= o[4] for o in out):
            out.append(f)
    return sorted(out, key=lambda f: f[3])


def _together(scans: list[DataFrame], schema: str) -> DataFrame:
    """Finds of several automata, apart from each other, by page; rows of one page and text are one."""
    union = scans[0]
    for s in scans[1:]:
        union = union.unionByName(s)
    pages = union.groupBy("document_id", "page", "text").agg(F.flatten(F.collect_list("hits")).alias("hits")).drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column(2).to_pylist():
                finds = [(h["position"], h["size"], h["label"], h["begin"], h["end"], h["raw_text"]) for h in hits]
                ruled = sorted({f for f in finds if f[1]})
                out.append(_added(apart(ruled, max((p + n for p, n, *_ in ruled), default=0)), [f for f in finds if not f[1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _listed(out, True)], names=["document_id", "page", "hits"])

    return pages.mapInArrow(run, schema)


def needs_entities(documents: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """The documents that the graph doesn't hold yet; all, if ``force``. ``known`` has their document_id."""
    return documents if force else documents.join(known.select("document_id").distinct(), "document_id", "left_anti")


def indexing_statistics(documents: DataFrame, wanted: DataFrame, pages: DataFrame, found: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """One row: documents processed and skipped, pages, mentions, distinct texts in any case, and relationships made by an indexing run.

    ``documents`` are all, ``wanted`` those to do, ``pages`` and ``found`` what these gave, ``mentions`` the edges; without these there is one for each
    document and text in any case. Finds are read once: counted by text (and document), then the counts are added up.
    """
    count = lambda df, name: df.agg(F.count("*").alias(name))
    sums = lambda name: F.coalesce(F.sum(name), F.lit(0))
    own, text = F.count("*").alias("_n"), F.lower("text").alias("_t")
    if mentions is None:
        texts = found.groupBy("document_id", text).agg(own).groupBy("_t").agg(F.sum("_n").alias("_n"), F.count("*").alias("_edges"))
    else:
        texts = found.groupBy(text).agg(own).withColumn("_edges", F.lit(0))
    finds = texts.agg(sums("_n").alias("total_entity_mentions"), F.count("*").alias("unique_entities"), sums("_edges").alias("relationships_created"))
    if mentions is not None:
        finds = finds.drop("relationships_created").crossJoin(count(mentions, "relationships_created"))
    done, every = count(wanted, "documents_processed"), count(documents, "_all")
    out = done.crossJoin(every).crossJoin(count(pages, "total_pages")).crossJoin(finds)
    skipped = (F.col("_all") - F.col("documents_processed")).alias("documents_skipped")
    return out.select("documents_processed", skipped, "total_pages", "total_entity_mentions", "unique_entities", "relationships_created")
