"""The licence scan against a plain search of all texts."""

import re

from pyspark.sql import functions as F

from tracelake.llm import licenses
from tracelake.llm.licenses import LEAST_SHARE, MEET, PROBES, SLACK, words_of

SCHEMA = "doc_id long, text string"


def _expected(rows):
    """Every template at every place of every text."""
    templates = licenses.standard_templates()
    texts = [words_of(t or "") for _, t in rows]
    vocabulary = sorted({w for t in templates for w in t.words})
    import math

    idf = {w: math.log((len(rows) + 1) / (sum(w in set(x) for x in texts) + 1)) + 1 for w in vocabulary}
    out = []
    for (doc_id, _), words in zip(rows, texts):
        base, found = [], []
        for t in templates:
            n = len(t.words)
            probes = sorted(set(t.words), key=lambda w: (-idf[w], w))[:PROBES]
            for at in range(-n + 1, len(words)):
                here = [words[at + j] if 0 <= at + j < len(words) else None for j in range(n)]
                if t.exact:
                    if here == list(t.words):
                        base.append((at, t.label))
                        found.append((t.label, 1.0))
                    continue
                if sum(any(here[j] == w for j in range(n) if t.words[j] == w) for w in probes) < min(MEET, len(probes)):
                    continue
                keyed = True
                for begin, size in t.keys:
                    places = range(max(0, at + begin - SLACK), at + begin + SLACK + 1)
                    keyed &= any(words[p : p + size] == list(t.words[begin : begin + size]) for p in places)
                if keyed:
                    near = [j for j, w in enumerate(t.words) if w in words[max(0, at + j - SLACK) : max(0, at + j + SLACK + 1)]]
                    share = sum(idf[t.words[j]] for j in near) / sum(idf[w] for w in t.words)
                    if share >= LEAST_SHARE:
                        found.append((t.label, share))
        join = lambda x: ",".join(sorted(set(x)))
        starts = [at for at, _ in base]
        score = max((s for _, s in found), default=0.0)
        out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), join(x for _, x in base), join(x for x, _ in found), round(score, 9)))
    return sorted(out, key=str)


def _got(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9)]
    return sorted((tuple(r) for r in licenses.op13_licenses(spark, str(folder)).select(names).collect()), key=str)


MIT = licenses.TEMPLATES[1][2]
APACHE = licenses.TEMPLATES[3][2]
ROWS = [
    (1, None), (2, ""), (3, " \n\t--"), (4, "All rights reserved."), (5, "ALL RIGHTS RESERVED all rights-reserved; All Rights all rights reserved"), (6, "all rights\nreserve d cc by general public"),
    (7, "CC BY"), (8, "cc-by-nc 4.0, Licensed under CC BY-NC 4.0."), (9, "the cc, by_all"), (10, "Released under the MIT License."), (11, "mit license"), (12, "the MIT man has a license"),
    (13, "x " * 50 + MIT + " y" * 3), (14, MIT.replace("copy,", "copy and also").replace("Software", "Work")), (15, "# " + APACHE.replace(" ", "\n# ")), (16, APACHE[: len(APACHE) // 2]),
    (17, "GNU Lesser General Public License under the terms of the GNU Lesser General Public License as published by"), (18, "This work is licensed under the GNU General Public License, version 3."),
    (19, "éé CC BY é"), (20, "ccéby cc by"), (21, "CC\x00BY cc\x7fby cc{by}"), (21, "cc by sa licensed under cc by sa"), (None, "all rights reserved"), (None, "general public license"),
    (22, "permission to use " * 40 + "copy modify and or distribute"), (23, "rights reserved all"), (24, "reserved. All rights reserved"), (25, "İ CC BY K"), (26, "released under"), (27, "mit license released under the"),
]


def test_query_against_all_places(spark, tmp_path):
    assert _got(spark, ROWS, tmp_path) == _expected(ROWS)
    by_id = {r[0]: r for r in _expected(ROWS)}
    assert by_id[5][2] == 3 and by_id[10][6] == "mit" and by_id[13][6] == "mit" and by_id[14][6] == "mit" and by_id[15][6] == "apache" and by_id[12][6] == "" and by_id[8][5:7] == ("cc-by", "cc-by,cc-by-nc")


def test_documents_empty_and_long(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _got(spark, rows, tmp_path) == _expected(rows)
    assert _got(spark, [], tmp_path) == []
    words = 400_000
    long = [(1, "All rights reserved " + "word " * words + "CC BY"), (2, "a" * 3_000_000), (3, "all " * 1000 + "rights reserved")]
    assert [r[1:7] for r in _got(spark, long, tmp_path)] == [(words + 5, 2, 0, words + 3, "cc-by,reserved", "cc-by,reserved"), (1, 0, None, None, "", ""), (1002, 1, 999, 999, "reserved", "reserved")]


def test_spans_clashing_columns_and_words(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "labels", "score", "spans", "n_words", "code", "n")})
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [(s.label, s.first_word, s.n_words, s.share) for s in got[24].spans] == [("reserved", 1, 3, 1.0)]
    assert got[13].spans[0].first_word == 50 and got[13].spans[0].share > 0.999
    text = "".join(map(chr, range(1, 0x250))) + "Ａ İK"
    assert words_of(text) == re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
