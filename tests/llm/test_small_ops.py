"""Each operator against brute force on small, awkward tables."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from tracelake.llm import common, exact_dedup, jaccard_join, language_id, mixing, packing, quality, substring_dedup, token_counts, token_files, warc
from tracelake.llm.components import components
from tracelake.llm import encoding
from tracelake.llm.encoding import ChunkEncoder
from tracelake.llm.sketches import bitmap

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
public_tokenizers = pytest.importorskip("public_tokenizers")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "ünï", "a,b", "#x"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(6)]
    rows = []
    for i, b in enumerate(base):
        rows.append(b)
        rows.append(b)  # exact copy
        w = b.split()
        w[60] = "edited"
        rows.append(" ".join(w))  # near copy
        rows.append("\n".join(w[5:70]) + f" tail{i} " + "\t".join(base[(i + 1) % 6].split()[10:75]))  # shared passages
    rows += [None, "", "   \n", "one", "one two", "ONE TWO", None, "  x", "…", "1 2 3 4", "\x1c\x85 nbsp in", "dup line\nother\ndup line", "a b c " * 40]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["s0", "s1", None, "s3"][i % 4], ["en", "de", None][i % 3], "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# ---------------------------------------------------------------- helpers
def test_words_and_hashes(texts):
    w = common.Words(pa.array(texts, pa.string()))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    h, by = w.hashes(block=64), {}
    assert (h == w.hashes()).all()
    for t, (a, b) in zip(texts, zip(w.begin, w.begin[1:])):
        for word, x in zip(words(t), h[a:b].tolist()):
            assert by.setdefault(word, x) == x
    assert len(set(by.values())) == len(by)
    at, row = w.windows(5)
    seen = {}
    for i, x in zip(at.tolist(), common.window_hashes(h, at, 5).tolist()):
        seen.setdefault(tuple(h[i : i + 5].tolist()), set()).add(x)
    assert all(len(s) == 1 for s in seen.values()) and len({next(iter(s)) for s in seen.values()}) == len(seen)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (999, 999), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---------------------------------------------------------------- 8
def test_exact_dedup(spark, docs, texts, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, hash_all=True).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].full_hash) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "b"), (3, None)], "doc_id long, text string")
    kept = exact_dedup.drop_exact_copies(twice).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "a"), (2, "b"), (3, "")]
    nobody = spark.createDataFrame([(None, "c", 2), (None, "c", 1), (None, None, 3)], "doc_id long, text string, n int")
    assert sorted(r.n for r in exact_dedup.drop_exact_copies(nobody).collect()) == [1, 3]
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns and exact_dedup.drop_exact_copies(empty).count() == 0


# ---------------------------------------------------------------- 9
def test_targets_water_fill(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(rng.randint(1, 9))]
        names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        weights = [[5, 2, 1][i % 3] for i in range(len(sizes))]
        capped, total = set(), sum(sizes)
        while True:
            free = [i for i in range(len(sizes)) if i not in capped]
            rest = total - sum(3 * sizes[i] for i in capped)
            target = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
            over = {i for i in free if target[i] > 3 * sizes[i]}
            if not over:
                break
            capped |= over
        for i, n in enumerate(names):
            assert got[n] == pytest.approx(target[i] if i in target else 3 * sizes[i])


def sample_keys(rows, seed=mixing.SEED):
    """The operator's keys, recomputed: hashes in a chain, a uniform draw, an exponential key scaled by quality."""
    import math

    import xxhash

    out = []
    for doc_id, text in rows:
        h = xxhash.xxh64_intdigest(seed.encode(), 42)
        if doc_id is not None:
            h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
        h = xxhash.xxh64_intdigest((text or "").encode(), h)
        draw = ((h >> 11) + 0.5) / 2**53
        n = len(text or "")
        quality = 1.5 - len(regex.sub(r"[\p{L}\t\n\x0b\f\r ]+", "", text)) / n if n else 0.5
        out.append(1 - math.exp(math.log(draw) / quality))
    return out


@pytest.mark.parametrize("bins", [1 << 10, 2])
def test_mixing(spark, docs, texts, empty, bins):
    one, two = (sorted(map(tuple, mixing.mix_sources(docs, bins=bins).collect()), key=repr) for _ in range(2))
    assert one == two and len(one) == len(texts)
    by, keys = {}, dict(enumerate(sample_keys(list(enumerate(texts)))))
    for doc_id, source, size, source_size, target, copies, taken in one:
        assert size == len(words(texts[doc_id])) and taken == copies * size <= 3 * size
        by.setdefault(source, []).append((size, source_size, target, taken, keys[doc_id], doc_id, copies))
    for rows in by.values():
        total, target = sum(r[0] for r in rows), rows[0][2]
        assert {r[1] for r in rows} == {total}
        assert abs(sum(r[3] for r in rows) - target) <= max(r[0] for r in rows) / 2 + 1e-6
        epochs, upto = int(target / total), 0
        for size, _, _, _, _, _, copies in sorted(rows, key=lambda r: (r[4], r[5])):
            upto += size
            assert copies == epochs + (size > 0 and upto - size / 2 <= target - epochs * total)
    assert sum(r[0][2] for r in by.values()) == pytest.approx(sum(len(words(t)) for t in texts))
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(docs, bins=bins)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(r[6] for r in one)


def test_mixing_ties_and_nulls(spark):
    rows = [(None, "a b c", "x")] * 30 + [(7, "a b c d", "x")] * 4 + [(i, None, "x") for i in range(3)] + [(i, "w " * i, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(docs, weights=(1.0, 3.0), bins=4).collect()
    assert len(got) == len(rows)
    for source in ("x", None):
        rows = [r for r in got if r.source == source]
        alike = {}
        for r in rows:
            alike.setdefault((r.doc_id, r.size), set()).add(r.copies)
        assert all(len(c) == 1 for c in alike.values())  # equal rows are taken together
        most = max(sum(r.size for r in rows if (r.doc_id, r.size) == k) for k in alike)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= most / 2 + 1e-6


# ---------------------------------------------------------------- 1
def brute_links(texts, k, num, den):
    sets = []
    for t in texts:
        w = [regex.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp)]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard(docs, texts, empty, k, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, k, num, den).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts, k, num, den)
    if k == 5:
        assert jaccard_join.similar_components(empty, k, num, den).count() == 0
        kept = jaccard_join.one_of_each_group(docs, k, num, den)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}


@pytest.mark.parametrize("seed,num,den", [(1, 4, 5), (2, 3, 5)])
def test_groups_of_near_copies_lose_no_link(spark, seed, num, den):
    rng, texts = random.Random(seed), []
    for _ in range(6):
        base = [f"g{rng.randint(0, 40)}" for _ in range(24)]
        for _ in range(14):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(24)] = f"g{rng.randint(0, 40)}"
            texts.append(" ".join(edited))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, 1, num, den).collect()}
    want = brute_links(texts, 1, num, den)
    assert [got[i] for i in range(len(texts))] == want and len({c for _, c in want}) > 1


def test_lists_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(60):
        z = int(rng.integers(2, 400))
        n = np.sort(rng.integers(20, 60, z))
        pos, label, rep = rng.integers(0, 8, z), rng.integers(0, int(rng.integers(1, 30)), z), np.arange(z)
        a, b = jaccard_join.list_pairs(rep, n, pos, label, 4, 5)
        c, d = jaccard_join._short_lists(np.zeros(z, np.int64), rep, n, pos, label, 4, 5)
        want = {
            (i, j) for i in range(z) for j in range(i + 1, z)
            if label[i] != label[j] and 5 * n[i] >= 4 * n[j] and min(n[i] - pos[i], n[j] - pos[j]) >= jaccard_join._least_overlap(n[i], n[j], 4, 5)
        }
        pairs = list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
        assert set(pairs) == want == set(zip(c.tolist(), d.tolist())) and len(pairs) == len(want)


# ---------------------------------------------------------------- 10
def spark_ones(hashes):
    """So many hashes that a bitmap of one chunk is full."""
    return hashes.sparkSession.range(1 << 24).selectExpr("xxhash64(id) as h")


def test_substring_dedup_of_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(5, passage), (5, "x " + passage), (9, passage + " y"), (9, "z " * 55), (None, passage), (7, "q " * 120), (5, passage)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(5, 60, 0), (5, 61, 0), (9, 61, 60), (9, 55, 0), (None, 60, 0), (7, 120, 0), (5, 60, 0)], key=repr)


@pytest.mark.parametrize("window,full", [(50, False), (6, False), (6, True)])
def test_substring_dedup(docs, texts, empty, window, full, monkeypatch):
    if full:  # a bitmap that lets everything through, one hash at a time, two occurrences a task
        monkeypatch.setattr(substring_dedup, "bitmap", lambda h, c, n: bitmap(spark_ones(h), c, 1 << 24, 1))
        monkeypatch.setattr(substring_dedup, "GATHERED", 1)
        monkeypatch.setattr(substring_dedup.remove_repeats, "__defaults__", (window, (2, 3), 2))
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, window).collect()}
    gone_any = 0
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        gone_any += len(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert gone_any > 500 and substring_dedup.remove_repeats(empty, window).count() == 0


# ---------------------------------------------------------------- 2
def test_quality_counts(docs, texts, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(texts):
        w, seen = words(t), {}
        for a in range(len(w) - 2):
            seen.setdefault(tuple(w[a : a + 3]), []).append(a)
        covered = {x + j for v in seen.values() if len(v) > 1 for x in v for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_quality_verdict_by_brute_force(spark, sf):
    from collections import Counter

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    counted = {lang: Counter(w for r in rows if r.lang == lang for w in words(r.text)) for lang in {r.lang for r in rows} - {None}}
    common_ = {lang for lang in counted if sum(r.lang == lang for r in rows) >= 20}
    learned = {w for lang in common_ for w, _ in sorted(counted[lang].items(), key=lambda x: (-x[1], x[0]))[:12]}
    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", quality.SPACE, ".,;:!?'\"()-", quality.SYMBOLS]

    def histograms(text):
        w, n = words(text), np.zeros(8)
        for c in text or "":
            n[next((i for i, x in enumerate(classes) if c in x), 6 if ord(c) > 127 else 7)] += 1
        common = Counter(x if x in learned else "" for x in w)
        return n, np.array([common[x] for x in sorted(learned)] + [common[""]], float), len(w)

    def distance(n, q):
        p = n / max(1, n.sum())
        m, kl = (p + q) / 2, lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m) if u)
        return np.sqrt((kl(p) + kl(q)) / 2)

    every = [histograms(r.text) for r in rows]
    totals = {lang: [sum(h[i] for h, r in zip(every, rows) if r.lang == lang) for i in (0, 1)] for lang in counted}
    shares = {lang: [x / x.sum() for x in t] for lang, t in totals.items()}
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows)).collect()}
    kept = 0
    for r, (c, w, n) in zip(rows, every):
        g = got[r.doc_id]
        if not n:
            continue
        far, near = min((distance(c, q[0]) + distance(w, q[1]), lang) for lang, q in shares.items() if lang in common_ or lang == r.lang)
        assert g.character_distance + g.word_distance == pytest.approx(far, abs=1e-9)
        a, b = distance(c, shares[g.language][0]), distance(w, shares[g.language][1])
        assert (g.character_distance, g.word_distance) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))
        limit = quality.WORD_LIMIT + quality.SHORT_SLACK * max(0, n**-0.5 - quality.STEADY_WORDS**-0.5)
        if min(abs(a - quality.CHARACTER_LIMIT), abs(b - limit)) > 1e-9:
            assert g.kept == (not g.base_failed and (a <= quality.CHARACTER_LIMIT or len(r.text) < quality.LEAST_CHARACTERS) and b <= limit)
        kept += g.kept
    assert 0 < kept < len(rows)


def test_quality_judges_short_texts(spark):
    rng, common = random.Random(5), "the of and to in a is that it for was with".split()
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    often = [1 / (i + 1) for i in range(len(common))]  # as frequent words are in prose
    text = lambda n, share: " ".join(rng.choices(common, often)[0] if rng.random() < share else rng.choice(rare) for _ in range(n))
    rows = [(i, text(600, 0.4), "en") for i in range(20)]
    sizes = (55, 70, 90, 119, 150)
    rows += [(100 + n, text(n, 0.4), "en") for n in sizes] + [(1000 + n, text(n, 0.0), "en") for n in sizes]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    # at 55 words good texts and the limit lie within a sampling error of each other: only junk is sure
    assert all(got[100 + n].kept for n in sizes[1:]) and not any(got[1000 + n].kept for n in sizes)


def test_quality_of_any_language(spark):
    """A language that no list names has its own reference; a text without a language goes with the nearest."""
    rng, rows = random.Random(9), []
    for lang in ("xx", "yy", "zz"):
        common = ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(12)]
        rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
        for i in range(30):
            text = " ".join(rng.choices(common, [1 / (j + 1) for j in range(12)])[0] if rng.random() < 0.4 else rng.choice(rare) for _ in range(400))
            rows.append((len(rows), text, lang if i else None))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.kept for r in got) and {r.language for r in got} == {"xx", "yy", "zz"}
    own = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=1000)  # each by its own alone
    assert own.where("not kept and not base_failed").count() == 0


@pytest.mark.parametrize("size", [1, 5, 19, 20])
def test_quality_of_a_rare_language(spark, sf, size):
    """Good documents of a language with few of them, beside the common ones, are judged by their own language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id", "left_semi")
    letters = str.maketrans("aeiourstnlbcdfghm", "áéíóúřšťňľbčďfghm")
    good = [r for r in docs.where("lang = 'en' and length(text) > 600").orderBy("doc_id").limit(size).collect()]
    rare = [(10**6 + r.doc_id, r.text.translate(letters), "xx") for r in good]
    found = quality.quality(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rare, "doc_id long, text string, lang string")))
    mine = found.where("doc_id >= 1000000").collect()
    assert len(mine) == len(rare) > 0 and all(r.kept or r.base_failed for r in mine)
    alone = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert {r.doc_id: r.kept for r in found.where("doc_id < 1000000").collect()} == alone or size == 20


# ---------------------------------------------------------------- 3
def test_warc(spark, tmp_path):
    htmls = ["<p>a</p>", None, "", "<p>a</p>", "ü" * 1000, "<p>b</p>\r\n\r\nWARC/1.1", "<p>a</p>"] + [f"p{i}" * 50 for i in range(40)]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i}\r\nX: y ü", h, "clash") for i, h in enumerate(htmls)] + [(None, "u", "<p>a</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_bundles(pages, "file://" + str(tmp_path / "w"), frame_bytes=700, bundle_bytes=3000)
    got = {r.page_id: r for r in warc.read_bundles(manifest).collect()}
    best = {}
    for i, h in enumerate(htmls):
        best[h or ""] = i
    for i, h in enumerate(htmls):
        raw, f = (h or "").encode(), best[h or ""]
        assert tuple(got[i])[1:] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    assert got[None].record_type == "response" and manifest.count() > 1
    for path in [r.path for r in manifest.collect()]:
        from tracelake.llm.files import open_file

        with open_file(path) as s:
            bundle = warc.Bundle(s)
            assert len(bundle.sizes) >= 1
            for identifier in bundle.ids:
                fields, payload = warc.parse_record(bundle.record(identifier))
                assert fields["WARC-Record-ID"] == identifier and "\n" not in fields.get("WARC-Target-URI", "")
    assert warc.read_bundles(warc.write_bundles(pages.where("false"))).count() == 0
    plain = warc.read_bundles(warc.write_bundles(pages, min_revisit_bytes=5000)).where("record_type = 'revisit'")
    assert plain.count() == 0


# ---------------------------------------------------------------- 4, 6, 7
ODD = ["", None, " ", "\n\n a  b\t\tc \n", "<|endoftext|> x<|startoftext|>", "it's I'll WE'VE 's", "a b　c\x85d\x1cE", "é ́x", "ΑΣ ΣΑΣ. ß ﬁ İI", "\x01 a\x01b", "123 45a6 ١٢٣ ½²", "日本語 テスト", "a" * 5000 + " b", "👩‍👧 🇩🇪", "﻿a", "\x00a \x00", "Ünïcödé, Ærø!  ÿŸ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding(name, texts, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    alphabet = list("aZ9' ,\n\t\u00a0") + ["'s", "'ve", "<|endoftext|>", "<|startoftext|>", "é", "ŉ", "½", "ß", "İ", "語", "\u3000", "́", "😀", "  ", "\x1c"]
    many = texts + ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(1500)]
    for special in (True, False):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        plain.encode_special_tokens = not special
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in many]
        for limit in (1 << 20, 40):
            monkeypatch.setattr(encoding.pieces, "__defaults__", (limit,))
            for ids, x, t in zip(ChunkEncoder(public_tokenizers.path(name), special).encode(many + many), want + want, many + many):
                assert ids.tolist() == x, t


@pytest.mark.parametrize("covered", [0.5, 0.9, 1.0])
def test_blocks(covered):
    rng = np.random.default_rng(1)
    for ids in (np.ones(1), rng.integers(0, 50257, 1500), np.r_[rng.integers(0, 300, 5000), [2**32 - 1]], np.full(512, 7), np.arange(513)):
        ids = ids.astype(np.int64)
        data, starts = token_files.encode_blocks(ids, covered)
        assert (token_files.decode_blocks(data.tobytes(), starts, ids.size) == ids).all()


def test_token_file_random_access():
    rng, out = np.random.default_rng(2), io.BytesIO()
    out.close, close = lambda: None, out.close
    parts = [rng.integers(0, 60000, int(n)) for n in rng.integers(0, 3000, 80)]
    writer = token_files.TokenFileWriter(out)
    for i, p in enumerate(parts):
        writer.add(None if i == 3 else i, p)
    writer.close()
    file, whole = token_files.TokenFile(pa.BufferReader(out.getvalue())), np.concatenate(parts)
    assert file.null[3] and file.sizes.tolist() == list(map(len, parts))
    for _ in range(50):
        a, b = sorted(rng.integers(0, whole.size, 2).tolist())
        assert (file.read(a, b) == whole[a:b]).all()
    close()


def test_token_files_and_packing(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        ids = [np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in texts]
        if end == 0:
            got, start = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(docs, path)).collect()}, 0
            for i, x in enumerate(ids):
                assert tuple(got[i]) == (i, start, x.size, zlib.crc32(x.tobytes()))
                start += x.size
            assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0
        else:
            rows, pieces, sequences = packing.pack(docs, path, window=64).collect(), {}, {}
            for r in rows:
                pieces.setdefault(r.doc_id, []).append(r)
                sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for i, x in enumerate(ids):
                at = 0
                for r in sorted(pieces[i], key=lambda r: r.start):
                    assert (r.start, r.doc_tokens, r.ids_crc32) == (at, x.size, zlib.crc32(x[at : at + r.length].tobytes()))
                    at += r.length
                assert at == x.size
            for v in sequences.values():
                at = 0
                for offset, length in sorted(v):
                    assert offset == at
                    at += length
                assert at <= 64
            assert packing.pack(empty, path).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        c = int(rng.integers(5, 60))
        lengths = rng.integers(1, c + 1, int(rng.integers(0, 60)))
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [(f, k) for k, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits)[1]] -= n
            else:
                free.append(c - n)
        window, _, n = packing.best_fit(lengths, c)
        fill = np.bincount(window, lengths, minlength=n) if n else np.zeros(0)
        assert sorted(c - fill.astype(int)) == sorted(free)


def test_token_counts(docs, texts, empty):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.zipf_pieces(path)
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        assert got[i].n_pretokens == len(w)
        if all(c in pieces for c in "".join(w)):
            assert got[i].n_tokens == sum(len(plain.encode(token_counts.MARK + x).ids) for x in w)
    assert token_counts.token_counts(empty, path).count() == 0
    counter = token_counts.TrieCounter({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, token_counts.MARK: -1.0})
    assert counter.counts(["ab", "abb", "é", token_counts.MARK + "aab"]) == {"ab": 1, "abb": 2, "é": 2, token_counts.MARK + "aab": 3}


def pieces_of(word, pieces, floor):
    """Pieces on the best path, by trying every split: of equal scores the shorter last piece counts."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(end - 1, -1, -1):
            if word[start:end] in pieces:
                ways.append((best[start][0] + pieces[word[start:end]], best[start][1] + 1))
        if word[end - 1] not in pieces:
            size = len(word[end - 1].encode())
            ways.append((best[end - 1][0] + size * floor, best[end - 1][1] + size))
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1][1]


LONG = " ".join(f"{w} longword{i}" for i, w in enumerate(["alpha", "beta", "the", "Ünï", "語"] * 14_000))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids and texts, an empty and a very long text (1.2 MB), columns with the names of results."""
    rows = [(None, "a b c d"), (None, "a b c d"), (None, None), (1, "x y z " * 30), (1, "x y z " * 30), (1, "other text"), (2, None), (3, ""), (4, LONG), (5, LONG), (6, "a b c d"), (7, "ALPHA beta 語 ☃ zz")]
    named = "n_words long, start long, size long, kept boolean, h long, tag int, label long, score double"
    return spark.createDataFrame([(*r, "en", "s", 1, 2, 3, True, 4, 5, 6, 0.5) for r in rows], f"doc_id long, text string, lang string, source string, {named}").repartition(3)


def test_awkward_rows(spark, awkward):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    order = lambda xs: sorted(xs, key=repr)
    # 1: equal and near sets are one component; rows without id take no part
    sizes = {t: n for (_, t), (n, _) in zip(rows, brute_links([t for _, t in rows], 3, 9, 10))}
    component = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    got = jaccard_join.similar_components(awkward, 3, 9, 10).collect()
    assert order(map(tuple, got)) == order((i, sizes[t], component[i]) for i, t in rows)
    # 2: each row by itself
    got = quality.quality(awkward, least=2).collect()
    assert order((r.doc_id, r.n_words) for r in got) == order((i, len(words(t))) for i, t in rows)
    # 4, 6
    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        crc = lambda x: zlib.crc32(x.tobytes())
        ids = {t: np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in {t for _, t in rows}}
        if end == 0:
            got = token_files.read_token_files(token_files.write_token_files(awkward, path)).collect()
            assert order((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == order((i, ids[t].size, crc(ids[t])) for i, t in rows)
            at = 0
            for r in sorted(got, key=lambda r: r.start):
                assert r.start == at
                at += r.n_tokens
            seen = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
            assert seen == [None] * 3 + sorted(x for x in seen if x is not None)
        else:
            got = packing.pack(awkward, path).collect()
            want = [(i, k, crc(ids[t][k : k + 4096])) for i, t in rows for k in range(0, ids[t].size, 4096)]
            assert order((r.doc_id, r.start, r.ids_crc32) for r in got) == order(want)
    # 7: any character, by trying every split
    pieces = token_counts.zipf_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    floor = min(pieces.values()) - token_counts.BYTE_PENALTY
    n = {t: sum(pieces_of(token_counts.MARK + w, pieces, floor) for w in words(t)) for t in {t for _, t in rows} - {LONG}}
    got = token_counts.token_counts(awkward, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert order((r.doc_id, r.n_pretokens, r.n_tokens) for r in got if r.doc_id not in (4, 5)) == order((i, len(words(t)), n[t]) for i, t in rows if i not in (4, 5))
    # 10: the smaller id keeps the long text
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(awkward).where("doc_id >= 4").collect()}
    assert got == {4: 0, 5: len(words(LONG)), 6: 0, 7: 0}


# ---------------------------------------------------------------- 5
def test_codewords():
    for n in (2, 3, 4, 6, 12):
        code = language_id.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert len({tuple(r) for r in code}) == n and apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


@pytest.mark.parametrize("n", [5, 10])
def test_every_language_is_fitted(spark, n):
    rng, names = random.Random(n), [f"l{i:02}" for i in range(n)]
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for _ in names]
    for a, b in zip(vocabulary[::5], vocabulary[1::5]):
        a[:9] = b[:9]  # a language that isn't fitted is taken for its neighbour
    rows = [(i, " ".join(rng.choices(vocabulary[i % n], k=30)), names[i % n]) for i in range(30 * n)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=20)
    assert model.languages == names
    fresh = [(i, " ".join(rng.choices(vocabulary[i % n], k=30)), names[i % n]) for i in range(10 * n)]
    got = language_id.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()
    right = {name: sum(r.lang == name == r.lang_pred for r in got) for name in names}
    assert min(right.values()) >= 9, right


def test_weighing_is_by_language():
    for n in (4, 5, 10):
        assert language_id.weighing(np.tile(np.arange(n), 20)).reshape(20, n).sum(axis=0).tolist() == [4] * n
    assert not language_id.weighing(np.array([0, 1, 2, 0, 1, 2])).any()
    assert language_id.weighing(np.array([0, 0, 1, 0, 0, 0])).tolist() == [False] * 5 + [True]


def test_language_id(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op5_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    model = language_id.fitted(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 …!"), (4, "The of and that with this for"), (None, "x")], "doc_id long, text string")
    said = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [said[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and said[1].score == 0.0
    assert language_id.fitted(empty) is None and language_id.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    kept = language_id.known_language(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_decoding_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fitted(docs)
    got = {r.doc_id: r for r in language_id.predictions(docs, model).collect()}
    odd, full = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def place(gram):
        h = 0
        for c in gram:
            h = (h * odd + c + 1) & full
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & full
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & full
        h ^= h >> 31
        return (h >> (64 - language_id.BUCKET_BITS)) + (len(gram) - 1) * language_id.BUCKETS

    def folded(c):
        return c + 32 if 65 <= c < 91 else 48 if 48 <= c < 58 else 32 if 9 <= c < 14 else c

    for r in docs.orderBy("n_chars").limit(40).collect():
        data = [folded(c) for c in (r.text or "").encode()]
        grams = [place(data[i : i + n]) for n in language_id.ORDERS for i in range(len(data) - n + 1)]
        logits = sum((model.coefficients[g].astype(float) for g in grams), np.zeros(model.bias.size)) / max(1, len(grams)) + model.bias
        losses = [sum(w * np.log1p(np.exp(-x * c)) for w, x, c in zip(model.weight, logits, code)) for code in model.code]
        chances = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        if regex.search(r"\p{L}", r.text or ""):
            assert got[r.doc_id].score == pytest.approx(chances.max(), abs=1e-5)
            assert got[r.doc_id].lang_pred == model.languages[int(chances.argmax())] or np.ptp(np.sort(chances)[-2:]) < 1e-5
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)


def test_language_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    model = language_id.Model(["a", "b"], language_id.codewords(2).astype(float), np.ones(1), rng.normal(size=(language_id.DIMENSIONS, 1)).astype(np.float32), np.zeros(1))
    data, offsets = common.text_bytes(pa.array(["é123 ABC", None, "", "x", "ab\ncd", "1 2"] * 30))
    want, letters = model.logits(data, offsets), language_id.has_letter(data, offsets)
    monkeypatch.setattr(language_id.gram_places, "__defaults__", (5,))
    monkeypatch.setattr(language_id.has_letter, "__defaults__", (1,))
    assert np.allclose(want, model.logits(data, offsets), atol=1e-5) and (letters == language_id.has_letter(data, offsets)).all()
    assert letters[:6].tolist() == [True, False, False, True, True, False]


def test_long_text_needs_few_arrays():
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from tracelake.llm import common, language_id as L
model = L.Model(["a", "b"], L.codewords(2).astype(float), np.ones(1), np.ones((L.DIMENSIONS, 1), np.float32), np.zeros(1))
column = pa.array(["some words of a long text " * (60_000_000 // 26)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
data, offsets = common.text_bytes(column)
model.decode(model.logits(data, offsets)), L.has_letter(data, offsets)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(used.stdout) < 300, used.stdout


def test_clashing_columns(spark):
    names = ["kept", "keep_id", "group_size", "full_hash", "kept_rows", "same", "row", "gone", "__gone", "__id", "__copies", "copies", "name", "size", "key", "lang_pred", "score", "ambiguous", "c0", "c1"]
    text = "one language has these words in it and some more of them follow here"
    rows = [(i, f"{text} {i // 2}" if i else None, "s", "en", *[f"{n}{i}" for n in names]) for i in range(12)]
    rows += [rows[3], (None, text, None, None, *["x"] * len(names)), (None, text, None, None, *["a"] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string, lang string", *(f"{n} string" for n in names)]))
    given = sorted(map(tuple, docs.collect()), key=repr)

    exact = sorted(map(tuple, exact_dedup.drop_exact_copies(docs).collect()), key=repr)
    assert exact == sorted({r for r in given if r[0] in (0, 1, 3, 5, 7, 9, 11) or r[4] == "a"}, key=repr)
    near = sorted(map(tuple, jaccard_join.one_of_each_group(docs, 3, 1, 1).collect()), key=repr)
    assert near == sorted([r for r in given if r[0] is None or r[0] in (0, 1) or r[0] % 2 == 0], key=repr)
    said = sorted(map(tuple, language_id.known_language(docs).collect()), key=repr)
    assert said == [r for r in given if r[1]]
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix_sources(docs).collect()}
    mixed = sorted(map(tuple, mixing.mixed_documents(docs).collect()), key=repr)
    assert mixed == sorted([r for r in given for _ in range(copies[r[0], len(words(r[1]))])], key=repr)

