"""Line dedup by content-defined chunks of lines.

The lines of a text are hashed and a rolling hash over the last two line hashes
closes a chunk where it is divisible by DIVISOR, so boundaries depend on nearby
lines only and a passage is cut alike wherever it stands. A line of at least
LONG_WORDS words is a chunk of its own. Chunks of several lines with at least
LEAST_WORDS words, and chunks of one long line, are removed where the same chunk
stands earlier: by document id, then position. Texts of chunks with equal hashes
are compared byte by byte first; should two differ, neither is touched.

dedup_passages() also removes every run of lines with more than PASSAGE_WORDS
words that stands earlier, wherever the chunks are cut. It compares the shortest
such run from each line on and the shortest one up to each line: a repeated run
holds, for each of its lines, one of these that covers it, so what they cover is
all repeated runs whole, edges included. In one document the earlier copy must
end before the later one begins.

Edge cases: null and empty texts are returned as they are; rows that repeat an
id with the same text are one document (all keep the first copy of a chunk);
null ids come first; ties cannot remain, as (doc_id, text hash, position) tells
all occurrences apart; an empty table gives an empty result. All columns of the
documents are kept, n_chars (where there is one) follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

DIVISOR = 3
LONG_WORDS = 40
LEAST_WORDS = 20
PASSAGE_WORDS = 50
_MASK = (1 << 64) - 1
_TURN = 0x9E3779B97F4A7C15


def chunks(text: str) -> list[tuple[int, int]]:
    """Line ranges of the chunks of text; together they hold every line once."""
    found, start, before = [], 0, 0
    for i, line in enumerate(lines := text.split("\n")):
        if len(line) >= 2 * LONG_WORDS - 1 and len(line.encode().split()) >= LONG_WORDS:
            if start < i:
                found.append((start, i))
            found.append((i, i + 1))
            start, before = i + 1, 0
            continue
        value = xxhash.xxh3_64_intdigest(line.encode())
        rolled = (before * _TURN + value) & _MASK
        before = value
        if (rolled >> 20) % DIVISOR == 0:
            found.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        found.append((start, len(lines)))
    return found


def removable(text: str) -> Iterator[tuple[int, str]]:
    """(number of the chunk, its text) of the chunks that are large enough to be removed."""
    lines = text.split("\n")
    for k, (a, b) in enumerate(chunks(text)):
        body = "\n".join(lines[a:b])
        if len(body) >= 2 * LEAST_WORDS - 1:
            n = len(body.encode().split())
            if n >= LONG_WORDS or (b - a > 1 and n >= LEAST_WORDS):
                yield k, body


def _key(body: str) -> int:
    return xxhash.xxh3_64_intdigest(body.encode()) - (1 << 63)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_hash", F.xxhash64("text"))


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, _chunk, _key) of every removable chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, numbers, keys = [], [], [], []
            for i, h, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, body in removable(text):
                    ids.append(i)
                    hashes.append(h)
                    numbers.append(k)
                    keys.append(_key(body))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(keys, pa.int64())], names=["doc_id", "_hash", "_chunk", "_key"])

    texts = _identified(docs.select("doc_id", "text").where("text is not null"))
    return texts.select("doc_id", "_hash", "text").mapInArrow(run, "doc_id long, _hash long, _chunk int, _key long")


def chunk_texts(marked: DataFrame) -> DataFrame:
    """(_key, _body) of the chunks named in marked(text, _chunks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for text, wanted in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                wanted = set(wanted)
                for k, body in removable(text):
                    if k in wanted:
                        keys.append(_key(body))
                        bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.string())], names=["_key", "_body"])

    return marked.select("text", "_chunks").mapInArrow(run, "_key long, _body string")


@F.udf(T.StringType(), useArrow=True)
def _without(text: str | None, removed: list[int] | None) -> str | None:
    """text without the chunks of these numbers; null if nothing remains."""
    if text is None or not removed:
        return text
    lines, gone = text.split("\n"), set(removed)
    kept = [line for k, (a, b) in enumerate(chunks(text)) if k not in gone for line in lines[a:b]]
    return "\n".join(kept) if any(re.search(r"[^\x20\x09-\x0D]", line) for line in kept) else None


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_text")).agg(F.collect_set("_chunk").alias(name))


def _joined(docs: DataFrame, per_document: DataFrame, how: str) -> DataFrame:
    # by merge at every size: a list for each document is no side to broadcast
    return docs.join(per_document.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), how).drop("_id", "_text")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, _chunk) of every occurrence that goes: all but the first of each chunk, byte-equal ones only."""
    place = F.struct("doc_id", "_hash", "_chunk")
    found = stored(chunk_hashes(docs))
    # the first place of each chunk (max of the place differs from it only if the chunk stands in two places)
    twice = found.groupBy("_key").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last").select("_key", "_first")
    repeats = stored(found.join(twice, "_key"))
    marked = _joined(_identified(docs.select("doc_id", "text").where("text is not null")), _by_document(repeats, "_chunks"), "inner")
    bodies = chunk_texts(marked).groupBy("_key", "_body").agg(F.count(F.lit(1)).alias("_n"))
    differing = stored(bodies.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    return repeats.where(place != F.col("_first")).join(differing, "_key", "left_anti").select("doc_id", "_hash", "_chunk")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated chunks; documents of which nothing but white space remains go."""
    return _applied(docs, _by_document(stored(repeated_chunks(docs)), "_removed"), _without)


def _applied(docs: DataFrame, removed: DataFrame, without: Callable) -> DataFrame:
    """docs without what removed(_id, _text, _removed) lists for each document."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    changed = _joined(rows, removed, "left")
    changed = changed.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("_removed"))))
    changed = changed.where("_removed is null or text is not null")
    length = F.when(F.col("_removed").isNull(), F.col("_row.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": length.cast(dict(docs.dtypes)["n_chars"]) if length is not None else None}
    return changed.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def spans(text: str) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, text) of the shortest runs of over PASSAGE_WORDS words from and up to each line, and of the removable chunks that are smaller."""
    raw = text.encode()
    lines = raw.split(b"\n")
    at, sums = [0], [0]  # where lines start, and words before them
    for line in lines:
        at.append(at[-1] + len(line) + 1)
        sums.append(sums[-1] + len(line.split()))
    found, n = set(), len(lines)
    if sums[n] > PASSAGE_WORDS:
        b = 0
        for a in range(n):
            while b <= n and sums[b] - sums[a] <= PASSAGE_WORDS:
                b += 1
            if b > n:
                break
            found.add((a, b))
        a = 0
        for b in range(1, n + 1):
            while sums[b] - sums[a + 1] > PASSAGE_WORDS:
                a += 1
            if sums[b] - sums[a] > PASSAGE_WORDS:
                found.add((a, b))
    if sums[n] >= LEAST_WORDS:
        for a, b in chunks(text):
            words = sums[b] - sums[a]
            if words <= PASSAGE_WORDS and (words >= LONG_WORDS or (b - a > 1 and words >= LEAST_WORDS)):
                found.add((a, b))
    return [(a, b, raw[at[a] : at[b] - 1]) for a, b in sorted(found)]


_SPAN = "doc_id long, _hash long, _from int, _to int, _k1 long, _k2 long"


def _keys(body: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(body)
    return (value >> 64) - (1 << 63), (value & _MASK) - (1 << 63)


def span_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, _from, _to, _k1, _k2) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(6)]
            ids, hashes, starts, stops, first, second = columns
            for i, h, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for a, b, body in spans(text):
                    k1, k2 = _keys(body)
                    ids.append(i)
                    hashes.append(h)
                    starts.append(a)
                    stops.append(b)
                    first.append(k1)
                    second.append(k2)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "_hash", "_from", "_to", "_k1", "_k2"])

    texts = _identified(docs.select("doc_id", "text").where("text is not null"))
    return texts.select("doc_id", "_hash", "text").mapInArrow(run, _SPAN)


def _cover(found: list[tuple]) -> list[tuple]:
    """Of spans (from, to, ...) in order, a few that cover the same lines: each line is in two of them at most."""
    chosen, reach, best = [], 0, None
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if best is not None and span[0] > reach:
            chosen.append(best)
            reach, best = best[1], None
        if span[1] <= reach:
            continue
        if span[0] > reach:
            chosen.append(span)
            reach = span[1]
        elif best is None or span[1] > best[1]:
            best = span
    return chosen if best is None else [*chosen, best]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, _from, _to) of spans that go: they cover all lines of the spans that stand earlier, byte-equal ones only."""
    key, place = ["_k1", "_k2"], F.struct("doc_id", "_hash", "_from", "_to")
    found = stored(span_hashes(docs))
    twice = found.groupBy(*key).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last").select(*key, "_first")
    apart = ~(F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_hash") == F.col("_first._hash"))) | (F.col("_from") >= F.col("_first._to"))
    later = found.join(twice, key).where(apart).select(*found.columns, "_first")

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, listed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows += [{"doc_id": i, "_hash": h, **s} for s in _listed_cover(listed)]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow)

    first = pa.struct([("doc_id", pa.int64()), ("_hash", pa.int64()), ("_from", pa.int32()), ("_to", pa.int32())])
    _arrow = pa.schema([("doc_id", pa.int64()), ("_hash", pa.int64()), ("_from", pa.int32()), ("_to", pa.int32()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("_first", first)])
    listed = later.groupBy("doc_id", "_hash").agg(F.collect_set(F.struct("_from", "_to", *key, "_first")).alias("_spans"))
    cover = stored(listed.mapInArrow(covers, f"{_SPAN}, _first struct<doc_id: long, _hash: long, _from: int, _to: int>"))

    # the texts of the chosen spans and of their first places
    firsts = cover.select("_first.*", *key).distinct()
    places = cover.select(*firsts.columns).unionByName(firsts)
    listed = places.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_text")).agg(F.collect_set(F.struct("_from", "_to", *key)).alias("_spans"))
    marked = _joined(_identified(docs.select("doc_id", "text").where("text is not null")), listed, "inner")
    bodies = span_texts(marked).groupBy(*key, "_body").agg(F.count(F.lit(1)).alias("_n"))
    differing = stored(bodies.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key))
    return cover.join(differing, key, "left_anti").select("doc_id", "_hash", "_from", "_to")


def _listed_cover(listed: list[dict]) -> list[dict]:
    by = {(s["_from"], s["_to"]): s for s in listed}
    return [by[place] for place in _cover(list(by))]


def span_texts(marked: DataFrame) -> DataFrame:
    """(_k1, _k2, _body) of the spans named in marked(text, _spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, bodies = [], [], []
            for text, listed in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                lines = text.split("\n")
                for s in listed:
                    first.append(s["_k1"])
                    second.append(s["_k2"])
                    bodies.append("\n".join(lines[s["_from"] : s["_to"]]))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bodies, pa.string())], names=["_k1", "_k2", "_body"])

    return marked.select("text", "_spans").mapInArrow(run, "_k1 long, _k2 long, _body string")


@F.udf(T.StringType(), useArrow=True)
def _without_spans(text: str | None, removed: list | None) -> str | None:
    """text without the lines of these ranges; null if nothing but white space remains."""
    if text is None or not removed:
        return text
    lines = text.split("\n")
    gone = {k for s in removed for k in range(s["_from"], s["_to"])}
    kept = [line for k, line in enumerate(lines) if k not in gone]
    return "\n".join(kept) if any(re.search(r"[^\x20\x09-\x0D]", line) for line in kept) else None


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs without repeated chunks and repeated runs of over PASSAGE_WORDS words; documents of which nothing but white space remains go."""
    listed = stored(repeated_spans(docs)).groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_text")).agg(F.collect_set(F.struct("_from", "_to")).alias("_removed"))
    return _applied(docs, listed, _without_spans)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")
