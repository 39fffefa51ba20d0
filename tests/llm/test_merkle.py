"""The Merkle manifest against a plain tree of hashes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and of each leaf the texts left and right of its ancestors."""
    sides, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            sides[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level, at = [_sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], sides


def _expected(rows: list[tuple]) -> list[tuple]:
    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, _leaf(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {x: _tree([leaf for *_, leaf, _ in sorted(trees[x], key=lambda r: r[:3])]) for x in names}
    root, upper = _tree([below[x][0] for x in names])
    out = []
    for x, above in zip(names, upper):
        for (*_, leaf, row), own in zip(sorted(trees[x], key=lambda r: r[:3]), below[x][1]):
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                folded = _leaf((row[0], lowered, *row[2:]))
            for left, right in (path := own + above):
                folded = _sha(left + folded + right)
            out.append((row[0], leaf, below[x][0], root, _sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def _got(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.op11_merkle(spark, str(folder)).select(names).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [64, 65, 7, 1, 1, 1, 1, 8, 9], [4097, 512, 513]])
def test_trees_of_all_shapes(spark, tmp_path, sizes):
    rows, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            n += 7
            rows.append((n, f"Text {n} OF é\n{'A' if n % 2 else 'b'}", None if k == 2 else f"l{k}", f"S{n % 3}", n))
    assert _got(spark, rows[::-1], tmp_path) == _expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, "No id", "en", "s", 5), (None, None, None, None, None), (3, None, "en", "s", None), (3, "TWO", "en", "s", 3), (3, "ONE", "en", "s", 3), (3, "TWO", "en", "s", 3),
        (-4, "", "", "", 0), (5, "ÀB", "é", "-", 1), (6, "B" * 1_200_000, "Z", None, 2), (12, "UPPER İ", "z", "x", 7), *[(900 + i, "SAME Text", "de", "s", 9) for i in range(600)],
        *[(77, "Same row", "de", "s", 8)] * 700,
    ]
    got = _got(spark, rows, tmp_path)
    assert got == _expected(rows)
    assert {r[-1] for r in got} == {True, False}


def test_empty_table_and_further_columns(spark, tmp_path):
    assert _got(spark, [], tmp_path) == []
    names = ["tree", "node", "key", "at", "size", "root", "block", "top", "sides", "upper", "leaf", "forged", "__row", "proof"]
    rows = [(i, f"t{i}", "en" if i % 3 else None, "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = merkle.manifest(docs)
    clashing = merkle.manifest(docs.withColumns({x: F.lit(1) for x in names}))
    assert clashing.columns == plain.columns
    assert sorted(map(tuple, clashing.collect())) == sorted(map(tuple, plain.collect()))
    assert all(r.verified for r in plain.collect())
    assert [len(r.proof) % 64 for r in plain.collect()] == [0] * 20
