"""Merkle manifest of a dataset: a leaf a row, a tree a language, a tree over the languages' roots.

Nodes are numbered within their tree by a range sort and prefix sums of small counts, then dealt in blocks of
``FAN ** LEVELS`` nodes.  Inside a block every level is a set of windows of fixed offsets: ``lag`` and ``lead``
columns over the first-child rows, masked by a node's slot and the length of its run, are its siblings, and the
row of a first child hashes the parent.  What a block leaves goes on to the next, ``FAN ** LEVELS`` times
smaller table.  On the way back each row gets the siblings of its ancestors, so that its proof is hashed and
its leaf folded to the root in place.  No tree, language or level is ever one task's; only hashes travel.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, small_side

#: Children a node (a fixed value of the manifest), levels that one shuffle serves.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIDES = "array<struct<left:string,right:string>>"


def sha(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts set one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Each value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    return sha(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def without_capitals(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its tree by ``order``, from 0, and ``size``, the rows of its tree.

    A range sort deals the rows, equal ones too; each range numbers its own and the counts of ranges before it
    are added.  The result is written, as the ranges' bounds come from samples.
    """
    spread = rows.withColumn("__nth", F.monotonically_increasing_id())
    keys = ["tree", *order, "__nth"]
    sorted_ = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__nth").withColumn("__row", F.monotonically_increasing_id())
    placed = materialize(sorted_, "sorted").withColumn("__range", F.shiftright("__row", 33))
    counts = placed.groupBy("tree", "__range").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = counts.select("tree", "__range", (before - F.col("first")).alias("__shift"), F.sum("n").over(tree).alias("size"))
    return (
        placed.join(small_side(starts, "starts"), ["tree", "__range"])
        .withColumn("at", F.col("__row") + F.col("__shift"))
        .drop("__range", "__row", "__shift")
    )


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, at, size, node, ...) with ``top``, ``LEVELS`` levels up, and the siblings met on the way.

    ``top`` is the hash of the block's root, or of the tree's where that comes first, on the block's first row
    and null on others.  ``sides`` has the texts to the left and right of a row's ancestors, lowest first, for
    those levels only that the tree has.
    """
    block = Window.partitionBy("tree", "block").orderBy("at")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("__0", F.col("node"))
    sides = []
    for level in range(LEVELS):
        step, own = FAN**level, f"__{level}"
        slot = F.floor(F.col("at") / step) % FAN
        left_over = F.ceil(F.col("size") / step) - F.floor(F.col("at") / step)  # nodes of the level from this one on
        begins, many = F.col("at") % step == 0, F.col("size") > step
        lags = [F.when(slot >= k, F.lag(own, k * step).over(block)) for k in range(FAN - 1, 0, -1)]
        leads = [F.when((slot + k < FAN) & (left_over > k), F.lead(own, k * step).over(block)) for k in range(1, FAN)]
        around = F.struct(F.concat_ws("", *lags).alias("left"), F.concat_ws("", *leads).alias("right"))
        out = out.withColumn(f"__s{level}", F.when(begins & many, around))
        side = F.col(f"__s{level}") if not level else F.last(f"__s{level}", ignorenulls=True).over(so_far)
        sides.append(F.when(many, side))
        parent = F.when(many, sha(F.col(own), F.col(f"__s{level}.right"))).otherwise(F.col(own))
        out = out.withColumn(f"__{level + 1}", F.when(F.col("at") % (step * FAN) == 0, parent))
    out = out.withColumn("sides", F.array_compact(F.array(*sides)).cast(_SIDES)).withColumn("top", F.col(f"__{LEVELS}"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def blocks_of(climbed: DataFrame) -> DataFrame:
    """The next table of nodes: one a block."""
    return climbed.where("top is not null").select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("node"))


def _joined(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of blocks with the ``upper`` sides and ``root`` of their block's node; a long path weighs more."""
    weight = F.lit(1) + F.floor(F.size("upper") * F.lit(FAN * 64 / 256))
    side = above.select("tree", F.col("at").alias("block"), F.col("sides").alias("upper"), "root")
    return rows.join(small_side(side, "above", weight=weight), ["tree", "block"]).withColumn("sides", F.concat("sides", "upper")).drop("upper")


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (tree, at, size, node, ...) with ``sides`` up to the root of their tree, and that ``root``; the roots alone."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels = [nodes]
    while most > BLOCK:
        levels.append(materialize(blocks_of(climb(levels[-1])), "blocks"))
        most = -(-most // BLOCK)
    top = climb(levels[-1])
    out = top.withColumn("root", F.max("top").over(Window.partitionBy("tree", "block")))
    for below in reversed(levels[:-1]):
        out = _joined(climb(below), out)
    return out, top.where("top is not null").select("tree", F.col("top").alias("root"))


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """A row for each of ``docs``: ``order``, leaf, subroot, root, proof (siblings, level by level), proof_sha256, folded_root, verified.

    ``tree`` names the column whose values have a tree each (null is a value); ``order`` sorts its leaves, null
    first, equal ones by their hash, so repeated rows stand side by side and the manifest doesn't depend on the
    order of the input.  ``tampered``: leaf digests to fold instead of the rows' own (null: the own one); rows are
    verified against the siblings of the original.  Further columns of ``docs`` are not read.  Without rows there
    is no root and no row.
    """
    own = leaf_digest([F.col(f) for f in fields])
    forged = F.lit(None).cast("string") if tampered is None else tampered
    value = F.col(tree).cast("string")
    leaves = docs.select(
        F.col(order).alias("key"),
        F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value)).alias("tree"),  # keeps the order, null first
        own.alias("node"),
        forged.alias("forged"),
    )
    rows, roots = grown(numbered(leaves.withColumn("forged", F.nullif("forged", "node")), ["key", "node"]))
    both = rows.withColumnRenamed("root", "subroot").join(_subroots(roots), "tree")
    sides = F.concat("sides", "upper")
    proof = F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate(sides, F.coalesce("forged", "node"), lambda node, s: sha(s["left"], node, s["right"]))
    return (
        both.select(F.col("key").alias(order), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof"), folded.alias("folded_root"))
        .withColumn("proof_sha256", F.sha2("proof", 256))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def _subroots(roots: DataFrame) -> DataFrame:
    """tree, upper sides, root: the tree over the subroots in order of ``tree``, built in the same way."""
    heads = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    top, _ = grown(numbered(heads, ["name"]))
    return small_side(top.select(F.col("name").alias("tree"), F.col("sides").alias("upper"), "root"), "subroots", weight=F.lit(1) + 2 * F.size("upper"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [without_capitals(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, tampered=F.when(chosen, leaf_digest(fields))).drop("proof")


# ---------------------------------------------------------------- SQL
def _tree_sql(name: str, source: str, levels: int) -> str:
    """CTEs ``name0 .. nameL``: nodes (tree, pos, node, size) of each level; a finished tree stays as it is."""
    ctes = [f"{name}0 AS ({source})"]
    for k in range(1, levels + 1):
        hashed = "sha256(string_agg(node, '' ORDER BY pos))"
        ctes.append(
            f"{name}{k} AS (SELECT tree, pos // {FAN} AS pos, CASE WHEN max(size) > 1 THEN {hashed} ELSE max(node) END AS node,"
            f" CAST(ceil(max(size) / {FAN}.0) AS BIGINT) AS size FROM {name}{k - 1} GROUP BY tree, pos // {FAN})"
        )
    return ",\n".join(ctes)


def _sides_sql(name: str, levels: int, start: str) -> str:
    """CTEs ``name_up0 .. name_upL``: start's rows (id, tree, pos, folded, proof) led up the levels."""
    ctes = [f"{name}_up0 AS ({start})"]
    for k in range(levels):
        ctes.append(f"""{name}_s{k} AS (
  SELECT u.id, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (WHERE n.pos < u.pos), '') AS l,
         coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (WHERE n.pos > u.pos), '') AS r, max(n.size) AS size
  FROM {name}_up{k} u JOIN {name}{k} n ON n.tree = u.tree AND n.pos // {FAN} = u.pos // {FAN} GROUP BY u.id),
{name}_up{k + 1} AS (
  SELECT u.id, u.tree, u.pos // {FAN} AS pos, CASE WHEN s.size > 1 THEN sha256(s.l || u.folded || s.r) ELSE u.folded END AS folded,
         u.proof || s.l || s.r AS proof FROM {name}_up{k} u JOIN {name}_s{k} s ON s.id = u.id)""")
    return ",\n".join(ctes)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_TEXTS = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")
_LOWERED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: CRC-32 (its fixed polynomial) of ASCII text: a byte at a time, a bit at a time.
_CRC_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda s: ascii(s)::UBIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"
)
#: Levels that the SQL writes out: 8 ** 8 rows a language, 8 ** 3 languages.
_DEEP, _WIDE = 8, 3

OP11_SQL = f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree,
         sha256({" || ".join(_field_sql(t) for t in _TEXTS)} || {_field_sql("text")}) AS leaf,
         CASE WHEN {_CRC_SQL} % 3 = 0 THEN sha256({" || ".join(_field_sql(t) for t in _TEXTS)} || {_field_sql(_LOWERED)}) END AS forged
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
{_tree_sql("t", "SELECT tree, pos, leaf AS node, size FROM placed", _DEEP)},
subroots AS MATERIALIZED (SELECT tree AS name, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM t{_DEEP}),
{_tree_sql("r", "SELECT '' AS tree, pos, node, size FROM subroots", _WIDE)},
{_sides_sql("t", _DEEP, "SELECT id, tree, pos, coalesce(forged, leaf) AS folded, '' AS proof FROM placed")},
{_sides_sql("r", _WIDE, f"SELECT u.id, '' AS tree, s.pos, u.folded, u.proof FROM t_up{_DEEP} u JOIN subroots s ON s.name = u.tree")}
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.node AS verified
FROM placed p JOIN r_up{_WIDE} u ON u.id = p.id JOIN subroots s ON s.name = p.tree CROSS JOIN r{_WIDE} r
"""
