"""Ranked lexical search over a length-stratified index.

A term's impact on a document depends on its count there (tf) and on the document's normaliser m, which follows
from the document's length. Documents of equal m are a stratum; within it postings are grouped by tf, so an
impact is computed once for each tf and stratum, in whole numbers, and no document's length is looked up again.

A stratum is cut into shards of some thousand documents (and some million postings), by a hash of the row, so
the sizes are bounded however many documents are of one length. The index has one row for each term of a shard,
its postings in the order of tf, and one row with the empty term that lists the shard's documents in the order of
their ids. Building it shuffles each document's terms once; a shard's lists are made within its task.

A search sends the terms of a block of queries (at most ``QUERIES`` and, unless one query has more,
``QUERY_TERMS``, so their size is bounded; more queries make more blocks) to the tasks. The largest tf of a term in a stratum bounds the score a stratum can
give a query. Strata are visited in the order of these bounds: the first ones, until they hold ``FIRST`` documents,
give the k-th best score so far; of the others only those are visited whose bound reaches it. Whole shards are scored
at once, and each task keeps the k best of each query.

A term is a run of ASCII letters and digits and of anything outside ASCII, with A-Z lowered. NULL and empty texts
have no terms and take no part, as do empty queries. Every row is a document or a query of its own, also
repeated ones. Equal scores are ordered by the document's id, NULL last; rows with the same id in any order. An
empty table gives no rows. Texts of any length are whole; only ids and texts are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tieout.llm.common import blocks
from tieout.session import Kept, stored

#: A shard's documents and postings, on average at most.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
#: Queries and their terms that a task holds, and cells of scores that it fills at once.
QUERIES, QUERY_TERMS, CELLS = 1024, 1 << 18, 1 << 22
#: Rows of (m, number of shards) that are sent to every task; about 16 bytes each.
BROADCAST_STRATA = 1 << 20
#: Documents that the first visits take in.
FIRST = 4096

#: Lower case for A-Z; a space for what stands between terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def normaliser(n: int, docs: int, length: int) -> int:
    return 100 - 75 + 75 * n * docs // length


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each text that has any, space-joined, and their counts as unsigned 32-bit numbers."""
    for batch in blocks(batches, "text"):
        at, n, terms, tfs = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = terms_of(text)
            if found:
                counts = Counter(found)
                at.append(i)
                n.append(len(found))
                terms.append(b" ".join(counts))
                tfs.append(np.fromiter(counts.values(), "<u4", len(counts)).tobytes())
        ids = batch.column("id").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.binary())], ["id", "n", "terms", "tfs"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """The rows of each shard; they come sorted by m and shard."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        m, shard = batch.column("m").to_numpy(), batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero((m[1:] != m[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), len(batch)]
        for begin, end in zip(cuts, cuts[1:]):
            now = (int(m[begin]), int(shard[begin]))
            if key not in (None, now):
                yield *key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(begin, end - begin))
    if held:
        yield *key, pa.Table.from_batches(held)


POSTINGS = pa.schema(
    [("m", pa.int64()), ("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("largest", pa.int64()), ("tfs", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary())]
)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows of each shard."""
    for m, shard, rows in _groups(batches):
        terms = pc.split_pattern(rows.column("terms").combine_chunks(), " ")
        place = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
        coded = pc.dictionary_encode(terms.flatten())
        names = coded.dictionary
        order = pc.sort_indices(names)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        code, tf = rank[coded.indices.to_numpy()], np.frombuffer(b"".join(rows.column("tfs").to_pylist()), "<u4").astype(np.int64)
        by = np.lexsort((place, tf, code))
        code, tf, place = code[by], tf[by], place[by].astype("<u4")
        term = np.flatnonzero(np.diff(code, prepend=-1))
        same_tf = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
        lists = pa.array(np.append(np.searchsorted(same_tf, term), len(same_tf)), pa.int32())
        ends = np.append(term[1:], len(code))
        n, ids = len(term), rows.column("id").combine_chunks()
        columns = [
            pa.array(np.full(n, m)), pa.array(np.full(n, shard)), names.take(order), pa.array(ends - term), pa.array(tf[ends - 1]),
            pa.ListArray.from_arrays(lists, pa.array(tf[same_tf], pa.int32())),
            pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(same_tf, len(code))), pa.int32())),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * np.append(term, len(code))).astype(np.int32)), pa.py_buffer(place)]),
        ]
        head = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        first = pa.RecordBatch.from_pylist([{"m": m, "shard": shard, "term": "", "n": len(ids)}], POSTINGS)
        yield pa.RecordBatch.from_arrays([*first.columns, head], [*POSTINGS.names, "ids"])
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, head.type)], [*POSTINGS.names, "ids"])


@dataclass(frozen=True)
class Index:
    """``rows`` over so many documents with so many terms together.

    A row for each term of a shard: its documents' number (n), the largest tf, every tf in rising order (tfs) and how
    many documents have it (sizes), and the documents' places in the shard as unsigned 32-bit numbers in that order
    (docs). The row with the empty term has the ids of the shard's documents by place."""

    rows: Kept
    docs: int
    length: int


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
    spark = docs.sparkSession
    texts = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = StructField("id", texts.schema["id"].dataType)
    found = texts.mapInArrow(_vectors, StructType([kind, *StructType.fromDDL("n long, terms string, tfs binary").fields]))
    kept = stored(found.withColumn("row", F.monotonically_increasing_id()))
    vectors = kept.read(spark)
    total = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    m = F.expr(f"{100 - 75} + (75 * n * {total.docs}L) div {max(total.length, 1)}L")
    placed = vectors.withColumn("m", m)
    shards = F.greatest(F.ceil(F.count("*") / SHARD_DOCS), F.ceil(F.sum(F.octet_length("tfs")) / (4 * SHARD_POSTINGS)))
    strata = stored(placed.groupBy("m").agg(shards.alias("shards")))
    sizes = strata.read(spark)
    # Few lengths are the rule, and then the rows stay where they are; else the join shuffles them once more.
    if sizes.count() <= BROADCAST_STRATA:
        sizes = F.broadcast(sizes)
    dealt = placed.join(sizes, "m").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    sorted_rows = dealt.select("m", "shard", "id", "terms", "tfs").repartition("m", "shard").sortWithinPartitions("m", "shard", F.col("id").asc_nulls_last())
    postings = "m long, shard long, term string, n long, largest long, tfs array<int>, sizes array<int>, docs binary"
    schema = StructType([*StructType.fromDDL(postings).fields, StructField("ids", ArrayType(kind.dataType))])
    index = Index(stored(sorted_rows.mapInArrow(_inverted, schema)), total.docs, total.length)
    kept.drop(spark)
    strata.drop(spark)
    return index


class Block:
    """The terms of some queries: the entries of query q are those from ``ends[q]`` to ``ends[q + 1]``."""

    def __init__(self, queries: list[dict[str, int]], weights: dict[str, int]):
        kept = [{t: c for t, c in q.items() if weights.get(t, 0) > 0} for q in queries]
        self.codes = {t: i for i, t in enumerate(sorted({t for q in kept for t in q}))}
        self.ends = np.cumsum([0, *map(len, kept)])
        self.code = np.array([self.codes[t] for q in kept for t in q], np.int64)
        self.share = np.array([c * weights[t] for q in kept for t, c in q.items()], np.int64)

    def bounds(self, m: int, largest: np.ndarray) -> np.ndarray:
        """For each query the score that a document can have where ``largest`` has the largest tf of each term."""
        per_term = np.where(largest > 0, impact(largest, m), 0)
        sums = np.concatenate([[0], np.cumsum(self.share * per_term[self.code])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


class Best:
    """The k best documents of each query so far."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors, self.found = k, floors.copy(), [[] for _ in floors]

    def offer(self, scores: np.ndarray, queries: np.ndarray, ids: list) -> None:
        """Scores of a shard's documents by query; documents come in the order of their ids."""
        at, doc = np.nonzero(scores >= self.floors[queries][:, None])
        for i in np.unique(at).tolist():
            q, docs = int(queries[i]), doc[at == i]
            mine = scores[i, docs]
            if len(docs) > self.k:
                first = np.argsort(-mine, kind="stable")[: self.k]
                docs, mine = docs[first], mine[first]
            new = [(-s, ids[d] is None, ids[d]) for s, d in zip(mine.tolist(), docs.tolist())]
            # No two ids that compare are NULL and not NULL, as their flags differ; two NULLs are equal.
            self.found[q] = heapq.nsmallest(self.k, self.found[q] + new, key=lambda r: r[:2] + (() if r[1] else (r[2],)))
            if len(self.found[q]) == self.k:
                self.floors[q] = max(self.floors[q], -self.found[q][-1][0])


def _scored(block: Block, floors: np.ndarray, k: int, id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best documents of each query in the shards of a task; the row of a shard's documents names its visitors."""
    best = Best(k, np.maximum(floors, 1))
    for m, _, rows in _groups(batches):
        names = rows.column("term").to_pylist()
        head = names.index("")
        queries = np.array(rows.column("queries").combine_chunks()[head].as_py(), np.int64)
        ids = rows.column("ids").combine_chunks()[head].as_py()
        use = [i for i, t in enumerate(names) if t]
        if not use:
            continue
        lists = rows.take(pa.array(use)).combine_chunks()
        tfs, sizes = lists.column("tfs").combine_chunks(), lists.column("sizes").combine_chunks()
        tf, place = tfs.flatten().to_numpy().astype(np.int64), np.frombuffer(b"".join(lists.column("docs").to_pylist()), "<u4")
        # One impact for each tf of a term, then one entry for each posting.
        worth = np.repeat(impact(tf, m), sizes.flatten().to_numpy())
        first = np.cumsum([0, *lists.column("n").to_pylist()])
        here = np.full(len(block.codes), -1, np.int64)
        here[[block.codes[names[i]] for i in use]] = np.arange(len(use))
        largest = np.zeros(len(block.codes), np.int64)
        largest[[block.codes[names[i]] for i in use]] = lists.column("largest").to_numpy()
        queries = queries[block.bounds(m, largest)[queries] >= best.floors[queries]]
        step = max(1, CELLS // len(ids))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            scores = np.zeros((len(some), len(ids)), np.int64)
            for i, q in enumerate(some.tolist()):
                entries = slice(block.ends[q], block.ends[q + 1])
                term = here[block.code[entries]]
                share = block.share[entries][term >= 0]
                term = term[term >= 0]
                long = first[term + 1] - first[term]
                take = np.arange(long.sum()) + np.repeat(first[term] - (np.cumsum(long) - long), long)
                np.add.at(scores[i], place[take], worth[take] * np.repeat(share, long))
            best.offer(scores, some, ids)
    rows = [(q, -s, i) for q, found in enumerate(best.found) for s, _, i in found]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], id_type)], ["query", "score", "id"]
    )


def _search_block(spark: SparkSession, index: Index, queries: list[dict[str, int]], k: int) -> DataFrame:
    """The k best documents of each query (its number in the list): query, score, id."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = index.rows.read(spark)
    kind = index.rows.schema["ids"].dataType.elementType
    result = StructType([*StructType.fromDDL("query int, score long").fields, StructField("id", kind)])
    asked = sorted({t for q in queries for t in q})
    wanted = spark.createDataFrame([(t,) for t in asked], "term string")
    matched = rows.join(F.broadcast(wanted), "term", "left_semi")
    stats = stored(matched.groupBy("m", "term").agg(F.max("largest").alias("largest"), F.sum("n").alias("docs")))
    df = {r.term: r.docs for r in stats.read(spark).groupBy("term").agg(F.sum("docs").alias("docs")).toLocalIterator()}
    weights = {t: weight(index.docs, n) for t, n in df.items()}
    block = Block(queries, weights)

    # The bound of every stratum for every query, and the strata by falling bounds.
    entries = spark.createDataFrame(
        [(q, t, c * weights[t]) for q, terms in enumerate(queries) for t, c in terms.items() if weights.get(t, 0) > 0], "query int, term string, share long"
    )
    largest = F.expr("(1000000000L * largest) div (1000L * largest + 8 * m)")
    bounds = stats.read(spark).join(F.broadcast(entries), "term").groupBy("query", "m").agg(F.sum(F.col("share") * largest).alias("bound"))
    sizes = rows.filter("term = ''").groupBy("m").agg(F.sum("n").alias("docs"))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    visits = stored(bounds.join(sizes, "m").withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0))))
    stats.drop(spark)

    terms = spark.createDataFrame([("",), *((t,) for t in block.codes)], "term string")

    def visit(chosen: DataFrame, floors: np.ndarray) -> Kept:
        visitors = chosen.groupBy("m").agg(F.sort_array(F.collect_list("query")).alias("queries"))
        parts = rows.join(F.broadcast(terms), "term", "left_semi").join(visitors, "m")
        parts = parts.withColumn("queries", F.when(F.col("term") == "", F.col("queries")))
        parts = parts.repartition("m", "shard").sortWithinPartitions("m", "shard")
        id_type = to_arrow_type(kind)
        return stored(parts.mapInArrow(lambda batches: _scored(block, floors, k, id_type, batches), result))

    first = visit(visits.read(spark).filter(F.col("before") < FIRST), np.zeros(len(queries), np.int64))
    ranked = first.read(spark).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    floors = np.zeros(len(queries), np.int64)
    for r in ranked.filter(F.col("r") == k).collect():
        floors[r["query"]] = r["score"]
    known = spark.createDataFrame([(q, f) for q, f in enumerate(floors.tolist())], "query int, floor long")
    left = visits.read(spark).filter(F.col("before") >= FIRST).join(F.broadcast(known), "query").filter("bound >= greatest(floor, 1)")
    second = visit(left, floors)
    visits.drop(spark)
    return first.read(spark).unionAll(second.read(spark))


def search(index: Index, queries: DataFrame, k: int = 10, id: str = "item_id", text: str = "text") -> DataFrame:
    """The k documents of each query with the highest scores above 0: query_id, rank, id (of the document), score.

    The terms of all queries pass the driver a block at a time; their documents don't."""
    spark = queries.sparkSession
    asked = queries.select(queries[id].alias("query_id"), queries[text].alias("text"))
    kind = asked.schema["query_id"]
    found: DataFrame | None = None

    def add(ids: list, block: list[dict[str, int]]) -> None:
        nonlocal found
        names = spark.createDataFrame(list(enumerate(ids)), StructType([*StructType.fromDDL("query int").fields, kind]))
        best = _search_block(spark, index, block, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "query").select("query_id", "rank", "id", "score")
        found = best if found is None else found.unionAll(best)

    ids, block, held = [], [], 0
    for row in asked.toLocalIterator():
        terms = Counter(t.decode() for t in terms_of(row["text"]))
        if held and (held + len(terms) > QUERY_TERMS or len(ids) == QUERIES):
            add(ids, block)
            ids, block, held = [], [], 0
        if terms and index.docs:
            ids.append(row["query_id"])
            block.append(dict(terms))
            held += len(terms)
    if block:
        add(ids, block)
    if found is None:
        id_type = index.rows.schema["ids"].dataType.elementType
        return spark.createDataFrame([], StructType([kind, *StructType.fromDDL("rank int").fields, StructField("id", id_type), *StructType.fromDDL("score long").fields]))
    return found


def oracle(k: int = 10) -> str:
    """The same ranking in DuckDB's SQL, of the table ``documents`` for every row of ``benchmark``."""
    term = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with terms as (select row_number() over () as r, doc_id, {term} as t from documents),
docs as (select r, doc_id, len(t)::bigint as n, t from terms where len(t) > 0),
total as (select count(*)::bigint as n_all, sum(n)::bigint as l_all from docs),
counts as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from docs) group by r, term),
weights as (select term, floor(1000 * ln((2 * any_value(n_all) + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, total group by term),
lengths as (select r, doc_id, 25 + (75 * n * n_all) // l_all as m from docs, total),
items as (select row_number() over () as q, item_id, {term} as t from benchmark),
asked as (select q, item_id, term, count(*)::bigint as times from (select q, item_id, unnest(t) as term from items) group by q, item_id, term),
scores as (
  select a.q, a.item_id, l.doc_id, l.r, sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * l.m)))::bigint as score
  from asked a join weights w using (term) join counts c using (term) join lengths l using (r) group by a.q, a.item_id, l.doc_id, l.r
),
ranked as (select item_id, row_number() over (partition by q order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {k}
"""
