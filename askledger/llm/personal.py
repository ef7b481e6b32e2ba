"""Personal data: fixed patterns, then terms that give a protected entity away, judged by corpus co-occurrence.

Entities are the values the patterns find (digits only for numbers, lower case for addresses). A term is a word of three
or more letters anywhere in a document that holds an entity. Over all documents,

    information(e) = -log2 p(e)         disclosure(t, e) = log2( p(t, e) / (p(t) p(e)) ) / information(e)

with p(e), p(t) the shares of documents that hold them and p(t, e) the share that holds both, t outside all pattern spans. 1 means that the term
never occurs without the entity. A pair seen in `SUPPORT` or more documents and disclosing `REMOVE` or more is removed,
one disclosing `GENERALISE` or more is generalised to a word class, wherever it stands in documents with that entity.
Pairs seen in fewer documents, and documents without the entity, are left as they are. Pattern spans are
always kept as they are; term spans come in addition, as kinds `removed` and `general`.

Every text is read whole, all counts cover all documents. Texts are not shuffled: a pass notes spans and the words of texts with entities, the
words of entities found in `SUPPORT` or more documents (no other can have such a pair) go through grouping and joins by (entity, term), and each document's spans meet again by a row number.

Defined results: a null text is empty and has no spans; a null or repeated id is carried along, each row for itself; an
empty table gives no rows; an entity found in every document carries no information and discloses nothing; other columns
are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askledger.llm import spans
from askledger.llm.common import sliced, stored

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count: all of the document.
REACH = sys.maxsize
SUPPORT = 2
GENERALISE, REMOVE = 0.6, 0.9
FLUSH_WORDS = 150_000
SLICE_BYTES = 4 << 20

#: The patterns. Digits before a start change nothing, so addresses of numbers start at a run's beginning.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """start, order of kind, kind, end of everything the patterns find."""
    found = [(a, 0, "email", z) for a, z in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def entity_of(kind: str, value: str) -> int:
    """A number that stands for the entity, whatever its spelling."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") - (1 << 63)


def free_terms(text: str, found: list[tuple[int, int, str, int]]) -> Iterator[tuple[str, int, int]]:
    """term, start, end of all words that lie outside all pattern spans."""
    cover = sorted((a, z) for a, _, _, z in found)
    reach = [z for _, z in cover]
    for k in range(1, len(reach)):
        reach[k] = max(reach[k], reach[k - 1])
    inside = lambda a, z: (j := bisect_left(cover, (z,))) > 0 and reach[j - 1] > a
    for m in _WORD.finditer(text):
        if not inside(m.start(), m.end()):
            yield m.group().lower(), m.start(), m.end()


NOTED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int32()), ("order", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))),
        ("entities", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))),
    ]
)
NOTED_SQL = f"row long, doc_id long, base {spans.SPAN}, entities array<long>, terms array<struct<term:string,places:array<struct<start:int,end:int>>>>"


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for b in sliced(batches, 1, SLICE_BYTES):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = base_spans(text or "")
            places: dict[str, list[dict]] = {}
            for term, start, end in free_terms(text, found) if found else ():
                places.setdefault(term, []).append({"start": start, "end": end})
            base = [{"start": a, "order": o, "kind": k, "end": z} for a, o, k, z in found]
            entities = sorted({entity_of(k, text[a:z]) for a, _, k, z in found})
            rows.append({"row": row, "doc_id": doc_id, "base": base, "entities": entities, "terms": [{"term": t, "places": p} for t, p in places.items()]})
            row += 1
        yield pa.RecordBatch.from_pylist(rows, schema=NOTED)


def _word_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word, summed over a stretch of documents at a time."""
    counted: Counter[str] = Counter()

    def flushed():
        out = pa.record_batch([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["term", "documents"])
        counted.clear()
        return out

    for b in batches:
        for text in b.column(0):
            counted.update(set(_WORD.findall((text.as_py() or "").lower())))
            if len(counted) > FLUSH_WORDS:
                yield flushed()
    yield flushed()


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, base and spans (pattern spans, and all spans) for every row."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    noted = stored(texts.mapInArrow(_noted, NOTED_SQL), "noted")
    total = max(1, noted.count())
    holds = noted.select("row", F.explode("entities").alias("entity"))
    entities = holds.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity").between(F.lit(support), F.lit(total - 1)))
    with_terms = noted.where(F.size("entities") > 0).select("row", "terms")
    near = holds.join(entities.select("entity"), "entity").join(with_terms, "row").select("row", "entity", F.inline("terms"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= support)
    words = texts.select("text").mapInArrow(_word_documents, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("with_term"))
    judged = pairs.join(entities, "entity").join(words, "term")
    information = -F.log2(F.col("with_entity") / total)
    shared = F.log2(F.col("together") * total / (F.col("with_entity") * F.col("with_term")))
    verdict = F.when(shared >= remove * information, F.lit("removed")).when(shared >= generalise * information, F.lit("general"))
    flagged = judged.select("entity", "term", verdict.alias("kind")).where("kind IS NOT NULL")
    met = near.join(flagged, ["entity", "term"]).select("row", "kind", F.inline("places"))
    worst = met.groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))
    order = F.when(F.col("kind") == "removed", len(KINDS)).otherwise(len(KINDS) + 1)
    more = worst.groupBy("row").agg(F.collect_list(F.struct("start", order.alias("order"), "kind", "end")).alias("more"))
    every = F.concat("base", F.coalesce("more", F.array().cast(spans.SPAN)))
    return noted.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", every.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the pattern spans, and all spans as text."""
    counts = [spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, ids taken as unique, with every span of `find` replaced by its kind in brackets."""
    kept = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_doc"), F.col("spans").alias("_spans"))
    joined = docs.join(kept, F.col(id_column) == F.col("_doc"), "left")
    text = F.when(F.col("_spans").isNotNull(), spans.rewritten(F.col(text_column), F.col("_spans"))).otherwise(F.col(text_column))
    return joined.withColumn(text_column, text).select(*docs.columns)
