"""Exact Jaccard self-join of documents' word-shingle sets, by prefix lists and set relations.

Shingles have one order for all sets, from rare to frequent by a count table over the whole corpus, then by
hash.  Two sets within the threshold share a shingle among the first few of both (the prefixes), which are
grouped as inverted lists.  Two relations between sets keep the lists from being compared pair by pair:

* equal sets are one class, represented by its smallest id;
* a set that is highly similar to an already answered one, its pivot (an equal pair of minhashes, then an
  exact check), takes over the pivot's component, and no pair inside one such component is formed again.
  The pivot of sets with equal minhashes is the one whose shingles are the most common: what copies were
  made from, or the copy nearest to it.  Those it leaves open get a pivot of their own in the next round.
  Only pairs across components are looked for in the lists.

Within a list, entries are sorted by set size and cut into blocks; by the positions at which the shingle
stands in the two sets a whole block is skipped when none of its entries can still reach the threshold.
The pairs left are checked on the full sets, so the links, and the components over them, are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import TEXT_ROWS, Words, arrow_rows, frugal, materialize, mix, slices, small_side, text_bytes
from tracelake.llm.components import components
from tracelake.llm.sketches import count_places, count_table

#: Entries of an inverted list in one block.
LIST_BLOCK = 64
#: Pairs of one set in a part, and sets that go to Python at once, in the exact check.
HUB_PAIRS, CHECK_ROWS = 250, 500
#: Rounds in which pivots answer for sets like them.
PIVOT_ROUNDS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917)


# ---------------------------------------------------------------- sets
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(column: pa.Array) -> pa.Array:
    """A-Z lower-cased, all else unchanged; nulls are empty."""
    data, offsets = text_bytes(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_LOWER[data]))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, sizes): the distinct k-word shingles of each text, sorted within each row.

    A text of fewer than k words has its whole sequence as its one shingle, one without words has none.
    """
    words = Words(lower_ascii(column))
    base = words.hashes()
    at, _ = words.windows(k)
    part = np.zeros(at.size, np.uint64)
    for j in range(k):
        part = mix(part * _ODD + base[at + j])
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = np.empty(short.size, np.uint64)
    for n, r in enumerate(short.tolist()):
        value = np.full(1, words.counts[r], np.uint64)
        for i in range(int(words.begin[r]), int(words.begin[r + 1])):
            value = mix(value * _ODD + base[i : i + 1])
        whole[n] = value[0]
    n = np.maximum(words.counts - k + 1, words.counts > 0).astype(np.int64)
    row = np.repeat(np.arange(n.size), n)
    of_short = (words.counts < k)[row]
    h = np.empty(row.size, np.uint64)
    h[~of_short], h[of_short] = part, whole
    for a, b in _bounds(n):
        h[a:b].sort()
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=len(column)).astype(np.int64)


def _bounds(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the rows of two or more lie."""
    ends = np.cumsum(sizes)
    more = np.flatnonzero(sizes > 1)
    return zip((ends - sizes)[more].tolist(), ends[more].tolist())


def _least_overlap(a, b, num: int, den: int):
    """The intersection from which den * intersection >= num * union."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


_RECORD = "doc_id long, n_shingles long, s1 long, s2 long, central double, prefix binary, m0 long, m1 long, m2 long, m3 long"


def _records(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One narrow row a document: set size, hash of the set, prefix, four pairs of minhashes."""

    def hashes(batches):
        for batch in slices(batches):
            yield shingle_sets(batch.column("text"), k)[0]

    counts = count_table(hashes, docs.select("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, row, sizes = shingle_sets(batch.column("text"), k)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            full = np.flatnonzero(sizes)  # rows with a set
            sums = np.zeros((2, sizes.size), np.uint64)
            mins = np.zeros((4, sizes.size), np.uint64)
            if full.size:
                for i, x in enumerate((h, mix(h ^ np.uint64(_SEEDS[0])))):
                    sums[i, full] = np.add.reduceat(x, begin[full])
                for i in range(4):
                    one, two = (np.minimum.reduceat(mix(h ^ np.uint64(_SEEDS[j])), begin[full]) for j in (2 * i, 2 * i + 1))
                    mins[i, full] = mix(one * _ODD + two)
            level = counts.value[count_places(h)]
            central = np.bincount(row, level, minlength=sizes.size) / np.maximum(sizes, 1)
            order = np.arange(h.size)  # of all shingles: by level, then hash, within each row
            for a, b in _bounds(sizes):
                order[a:b] = a + np.argsort(level[a:b], kind="stable")
            ordered, cut = h[order], prefix_length(sizes, num, den)
            prefix = [ordered[a : a + c].tobytes() for a, c in zip(begin.tolist(), cut.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in sums), pa.array(central), pa.array(prefix, pa.binary()), *(pa.array(x.view(np.int64)) for x in mins)],
                names=[c.split()[0] for c in _RECORD.split(", ")],
            )

    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return materialize(docs.mapInArrow(frugal(describe), _RECORD), "records")


# ---------------------------------------------------------------- exact check
def _dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` as (a, b, part, parts): b is the end in more of them, and its pairs are dealt to parts of HUB_PAIRS or so."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ends = small_side(ends, "ends")
    known = pairs.join(ends.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    turned = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    hub, most = F.when(turned, F.col("a")).otherwise(F.col("b")), F.greatest("na", "nb")
    parts = F.ceil(most / HUB_PAIRS).cast("int")
    other = F.when(turned, F.col("b")).otherwise(F.col("a"))
    return known.select(other.alias("a"), hub.alias("b"), F.pmod(F.xxhash64(other), parts).cast("int").alias("part"), parts.alias("parts"))


def _checked(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are within the threshold.

    The sets of all ``a`` of one ``b`` follow the set of ``b``, which is sent once to each part of its pairs, so
    that many sets near one are held against it in many tasks, one at a time.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, _, sizes = shingle_sets(batch.column("text"), k)
            begin = np.concatenate(([0], np.cumsum(sizes))).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([h[x:y].tobytes() for x, y in zip(begin, begin[1:])], pa.binary())], names=["doc_id", "shingles"]
            )

    def within(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate((x, y))
        both.sort(kind="stable")  # merges two sorted runs
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return den * common >= num * (both.size - common)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, of_hub = None, []
        for batch in batches:
            found = []
            for b, part, a, raw in zip(batch.column("b").to_pylist(), batch.column("part").to_pylist(), batch.column("a").to_pylist(), batch.column("shingles")):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if key != (b, part):
                    key, of_hub = (b, part), []
                if a is None:
                    if not any(np.array_equal(x, y) for y in of_hub):  # a doc_id may have several texts
                        of_hub.append(x.copy())
                elif any(within(x, y) for y in of_hub):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    dealt = materialize(_dealt(materialize(pairs, "found", narrow=True)), "pairs", narrow=True)
    needed = small_side(dealt.select(F.col("a").alias("doc_id")).union(dealt.select("b")).distinct(), "needed")
    full = docs.join(needed, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(frugal(sets), "doc_id long, shingles binary")
    with arrow_rows(docs.sparkSession, CHECK_ROWS):
        full = materialize(full, "sets")
        hubs = dealt.groupBy("b").agg(F.max("parts").alias("parts")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        first = hubs.join(full.withColumnRenamed("doc_id", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "shingles")
        members = dealt.join(full.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "shingles")
        rows = first.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
        return materialize(rows.mapInArrow(frugal(check), "a long, b long").distinct(), "checked", narrow=True)


# ---------------------------------------------------------------- pivots
def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return keys.withColumn("label", F.col("doc_id"))
    named = labels.select(F.col("id").alias("doc_id"), "component")
    return keys.join(named, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def _answered_by_pivots(rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) of sets with the pivots of their minhash groups: at most one pair a set, key and round."""
    keys = classes.select("doc_id", "central", F.posexplode(F.array("m0", "m1", "m2", "m3")).alias("j", "m"))
    links, labels = None, None
    for n in range(PIVOT_ROUNDS):
        labelled = _labelled(keys, labels)
        best = F.max_by(F.struct("doc_id", "label"), F.struct("central", -F.col("doc_id"))).alias("p")
        grouped = labelled.groupBy("j", "m").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").select("j", "m", "p")
        pivots = small_side(grouped, "pivots")  # written first, so that the sets of a large group need not meet for the join
        met = labelled.join(pivots, ["j", "m"])
        near = met.where("label <> p.label").select(F.col("doc_id").alias("a"), F.col("p.doc_id").alias("b")).distinct()
        checked = _checked(rows, near, k, num, den)
        links = checked if links is None else links.unionByName(checked)
        labels = components(links)
        if n + 1 < PIVOT_ROUNDS:  # what the pivot's component hasn't taken in stays open
            group = pivots.select("j", "m", F.col("p.doc_id").alias("doc_id"))
            reached = _labelled(group, labels).select("j", "m", F.col("label").alias("pivot_label"))
            left = _labelled(keys, labels).join(reached, ["j", "m"]).where("label <> pivot_label")
            keys = materialize(left.select("doc_id", "central", "j", "m"), "open", narrow=True)
    return links, labels


# ---------------------------------------------------------------- inverted lists
def list_pairs(rep: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list, sorted by n, that differ in label and pass the size and position bounds."""
    rest = n - pos
    values, counts = np.unique(label, return_counts=True)
    main = values[np.argmax(counts)]
    probes = np.flatnonzero(label != main)  # pairs inside the main component need not be formed
    starts = np.arange(0, n.size, LIST_BLOCK)
    low, high = n[starts], n[np.minimum(starts + LIST_BLOCK, n.size) - 1]
    reach = np.maximum.reduceat(rest, starts)
    left, right = [], []
    for i in probes.tolist():
        # a block is skipped if its sizes are out of range, or if even its best position leaves too little
        open_ = (den * high >= num * n[i]) & (num * low <= den * n[i]) & (np.minimum(reach, rest[i]) >= _least_overlap(n[i], low, num, den))
        for s in starts[open_].tolist():
            j = np.arange(s, min(s + LIST_BLOCK, n.size))
            ok = (label[j] != label[i]) & ((label[j] == main) | (j > i)) & (np.minimum(rest[j], rest[i]) >= _least_overlap(n[i], n[j], num, den))
            j = j[ok]
            left.append(np.full(j.size, rep[i]))
            right.append(rep[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _short_lists(token, rep, n, pos, label, num: int, den: int):
    """The same for many short lists at once: compares entries at distance 1, 2, ... while lists last."""
    rest, i, d = n - pos, np.arange(token.size), 1
    left, right = [], []
    while True:
        i = i[i + d < token.size]
        i = i[(token[i + d] == token[i]) & (num * n[i + d] <= den * n[i])]  # sizes only grow within a list
        if not i.size:
            break
        j = i + d
        ok = (label[i] != label[j]) & (np.minimum(rest[i], rest[j]) >= _least_overlap(n[i], n[j], num, den))
        left.append(rep[i[ok]])
        right.append(rep[j[ok]])
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole lists; a list that goes on in the next batch is carried over."""
    carried: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if columns[0][0] == columns[0][-1] and carried and carried[-1][0][-1] == columns[0][0]:
            carried.append(columns)  # one long list: joined once, when it ends
            continue
        columns = [np.concatenate(c) for c in zip(*carried, columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield tuple(c[:cut] for c in columns)
        carried = [[c[cut:] for c in columns]]
    if carried:
        yield tuple(np.concatenate(c) for c in zip(*carried))


def _candidates(records: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of representatives in different components that share a prefix shingle."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            size = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in prefix], np.int64)
            token = np.frombuffer(b"".join(x.as_py() or b"" for x in prefix), np.int64)
            begin = np.concatenate(([0], np.cumsum(size)[:-1])) if size.size else size
            columns = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), size) for c in ("doc_id", "n_shingles", "label")]
            pos = np.arange(token.size) - np.repeat(begin, size)
            for s in range(0, token.size, 100_000):
                part = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[part]), pa.array(columns[0][part], pa.int64()), pa.array(columns[1][part].astype(np.int32)), pa.array(pos[part].astype(np.int32)), pa.array(columns[2][part], pa.int64())],
                    names=["token", "rep", "n", "pos", "label"],
                )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, rep, n, pos, label in _list_rows(batches):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            sizes = np.diff(np.append(starts, token.size))
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            found = []
            of_row = np.repeat(mixed & (sizes <= 2 * LIST_BLOCK), sizes)
            if of_row.any():
                found.append(_short_lists(*(c[of_row] for c in (token, rep, n, pos, label)), num, den))
            for s, z in zip(starts[mixed & (sizes > 2 * LIST_BLOCK)].tolist(), sizes[mixed & (sizes > 2 * LIST_BLOCK)].tolist()):
                found.append(list_pairs(*(c[s : s + z] for c in (rep, n, pos, label)), num, den))
            for a, b in found:
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    labelled = records.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    labelled = labelled.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("label"), "prefix")
    lists = labelled.mapInArrow(frugal(entries), "token long, rep long, n int, pos int, label long")
    lists = lists.repartition("token").sortWithinPartitions("token", "n", "pos", "rep")
    return lists.mapInArrow(frugal(pairs), "a long, b long").distinct()


def similar_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Rows link when den * intersection >= num * union of their sets of k-word shingles over words with A-Z
    lower-cased.  component_id is the smallest doc_id reachable by links, itself included.  Texts that are
    null or have no word have an empty set and no link; a null doc_id takes no part and has a null
    component.  Repeated rows are equal sets.  Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    records = _records(rows, k, num, den)
    usable = records.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "s1", "s2"]
    classes = usable.groupBy(same).agg(
        F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"), F.first("central").alias("central"), *[F.first(m).alias(m) for m in ("m0", "m1", "m2", "m3")]
    )
    classes = materialize(classes, "classes")
    member = usable.join(classes.select(*same, F.col("doc_id").alias("b")), same).where("doc_id <> b")
    equal = materialize(member.select(F.col("doc_id").alias("a"), "b").distinct(), "equal", narrow=True)

    answered, labels = _answered_by_pivots(rows, classes, k, num, den)
    across = _checked(rows, _candidates(classes, labels, num, den), k, num, den)
    found = components(answered.unionByName(across).unionByName(equal))
    return records.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their group, with their own columns.

    Rows without a link, without a word or without doc_id all stay; rows that repeat the smallest doc_id stay too.
    """
    found = similar_components(docs.select("doc_id", "text"), k, num, den)
    gone = small_side(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # columns of any name pass in it
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
