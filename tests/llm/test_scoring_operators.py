"""Lattice scores, centroid clusters and fill-in-the-middle against brute force, and their odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import centroids, infill, lattice
from riskweave.llm.queries import op11_lm_scoring
from riskweave.llm.training import fold

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, block string, n long"  # with names that the operators use themselves


# --- lattice ------------------------------------------------------------------------------------------------------------
def tiny_pieces():
    raw = {(256,): 3, (256, 97): 5, (256, 97, 98): 4, (97,): 2, (98,): 3, (97, 98): 2, (98, 97, 98): 1, (256, 98, 97): 1}
    return {k: v / 21 for k, v in raw.items()}


def paths(symbols, pieces):
    """Probability and pieces of every segmentation."""
    if not symbols:
        yield 1.0, []
    for n in range(1, len(symbols) + 1):
        if symbols[:n] in pieces:
            for p, rest in paths(symbols[n:], pieces):
                yield pieces[symbols[:n]] * p, [symbols[:n], *rest]


@pytest.mark.parametrize("long", [95, 2])
def test_marginals_and_expected_counts_equal_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(lattice, "LONG", long)
    pieces = tiny_pieces()
    walker, logs, names = lattice.Lattice(list(pieces)), np.log(list(pieces.values())), list(pieces)
    words = [bytes(w) for n in range(1, 6) for w in itertools.product(b"ab", repeat=n)]
    expected, wanted = np.zeros(len(names)), Counter()
    found = walker.log_marginals(words, logs, expected)
    for word, got in zip(words, found, strict=True):
        every = list(paths((256, *word), pieces))
        total = math.fsum(p for p, _ in every)
        assert math.isclose(math.exp(got), total, rel_tol=1e-9)
        for p, used in every:
            for piece in used:
                wanted[piece] += p / total
    assert np.allclose(expected, [wanted[n] for n in names])
    assert sum(math.exp(x) for x in walker.log_marginals([bytes(w) for n in range(1, 13) for w in itertools.product(b"ab", repeat=n)], logs)) <= 1


def test_pieces_of_a_file_cover_every_byte_and_sum_to_one():
    import public_tokenizers

    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert math.isclose(math.fsum(pieces.values()), 1.0) and all(min(w for w in [pieces.get((b,), 0)]) > 0 for b in range(256) if b not in lattice.SPACES and not 65 <= b <= 90)
    assert not any(65 <= s <= 90 or s in lattice.SPACES for piece in pieces for s in piece)


def lattice_rows(spark, rows, pieces):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    return lattice.lattice_scores(docs, pieces, held_out=F.col("doc_id") % 3 == 2, learned=F.col("doc_id") % 3 != 2).collect()


def test_scores_of_texts_equal_brute_force(spark):
    pieces = tiny_pieces()
    rows = [(0, "ab AB ba"), (1, " a\tab\nb "), (2, "ab bb"), (3, ""), (4, None), (None, "ab"), (3, ""), (5, "aabab zzz")]
    pieces |= {(b"z"[0],): 1e-3}
    found = lattice_rows(spark, rows, pieces)
    assert len(found) == len(rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    train = [words(t) for i, t in rows if i is not None and i % 3 != 2]
    c, ends = Counter(w for ws in train for w in ws), len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = once / (once + 2 * twice)
    first = np.array(list(pieces.values()))
    weights = dict(pieces)
    for _ in range(3):
        used = Counter()
        for w in c:
            every = list(paths((256, *w.encode()), weights))
            for p, path in every:
                for piece in path:
                    used[piece] += p / math.fsum(x for x, _ in every)
        weights = {k: (used[k] + lattice.PRIOR * f) / (sum(used.values()) + lattice.PRIOR) for k, f in zip(pieces, first, strict=True)}
    marginal = lambda w: math.fsum(p for p, _ in paths((256, *w.encode()), weights))
    wanted = []
    for i, t in rows:
        ws = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        score = sum(math.log10((max(c[w] - d, 0) + (d * len(c) + 0.5) * marginal(w)) / (n + 1)) for w in ws) + math.log10((ends + 0.5) / (n + 1))
        wanted.append((i, i is not None and i % 3 == 2, len(ws) + 1, sum(w in c for w in ws) + 1, n, base, score))
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(wanted, key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_lattice_scores_of_odd_tables(spark):
    pieces = tiny_pieces()
    assert lattice_rows(spark, [], pieces) == []
    alone = lattice_rows(spark, [(2, "ab"), (2, None)], pieces)  # nothing to learn from
    assert [r.train_tokens for r in alone] == [0, 0] and all(math.isfinite(r.score) and r.n_known == 0 for r in alone)
    long = lattice_rows(spark, [(0, "ab" * 100_000), (2, "ab" * 100_000 + " a"), (1, "b " * 200_000)], pieces)
    assert sorted(r.n_tokens for r in long) == [2, 3, 200_001] and all(math.isfinite(r.score) for r in long)


def test_query_scores_every_document_and_learning_helps_held_out_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op11_lm_scoring(spark, SF).collect()}
    assert sorted(found) == sorted(d.doc_id for d in docs)
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d in docs if not held[d.doc_id] for w in words(d.text))
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    for d in docs:
        r, ws = found[d.doc_id], words(d.text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d.doc_id], len(ws) + 1, sum(w in c for w in ws) + 1, n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)), rel_tol=1e-9)
    import public_tokenizers

    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    unfitted = lattice.lattice_scores(spark.read.parquet(f"{SF}/documents.parquet"), pieces, held_out=fold("doc_id", 7) == 2, learned=fold("doc_id", 7) != 2, rounds=0).where("held_out").agg(F.sum("score")).first()[0]
    assert sum(r.score for r in found.values() if r.held_out) > 0.9 * unfitted


def test_blocks_meet_their_words(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = lambda: {r.doc_id: round(r.score, 6) for r in lattice.lattice_scores(docs.repartition(3), tiny_pieces() | {(b,): 1e-4 for b in range(33, 256)}, held_out=fold("doc_id", 7) == 2, learned=fold("doc_id", 7) != 2, rounds=1).collect()}
    whole = score()
    monkeypatch.setattr(lattice, "BLOCK", 5_000)
    assert score() == whole


# --- centroids -----------------------------------------------------------------------------------------------------------
def lloyd(rows, k, rounds, scale=64):
    grid = [(i, [math.floor(scale * v) for v in x]) for i, x in rows]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), g) for i, g in grid if i is not None)[:k]
    c = [g for _, g in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(g, m), j) for j, m in enumerate(c)) for _, g in grid]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [g for (_, g), (_, i) in zip(grid, at, strict=True) if i == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(grid, assign(), strict=True)], c


def clustered(spark, rows, **options):
    table = spark.createDataFrame([(i, x, 7, 1) for i, x in rows], "vec_id long, embedding array<double>, cluster int, raw int")
    return centroids.hamerly_clusters(table, **options)


@pytest.mark.parametrize("spread", [1.0, 0.02, 3e4, 1e120])
def test_clusters_equal_plain_rounds(spark, spread):
    random = np.random.default_rng(3)
    centres = random.normal(size=(7, 5)) * spread
    rows = [(i, (centres[i % 7] + random.normal(size=5) * spread / 9).tolist()) for i in range(300)]
    rows += [(i % 9, rows[i % 9][1]) for i in range(40)]  # repeated rows, so equal first centroids and ties
    found = clustered(spark, rows, clusters=9, rounds=5, width=5).collect()
    wanted, c = lloyd(rows, 9, 5)
    fits = lambda v: v if v < 1 << 63 else None
    assert sorted((r.vec_id, r.cluster, r.distance is None, r.distance or 0) for r in found) == sorted((i, j, fits(d) is None, fits(d) or 0) for i, j, d in wanted)
    for r in found:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
        mine = [d for _, j, d in wanted if j == r.cluster]
        assert r.cluster_inertia == (sum(mine) if max(mine) < 1 << 63 and sum(mine) < 1 << 63 else None)
    if spread == 1.0:
        assert sum(r.scans for r in found) < 0.6 * 6 * len(rows)  # bounds spare most full scans


def test_vectors_on_bounds_and_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (None, [0.25, 0.25])]
    odd = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 1.0, 1.0])]
    wanted, _ = lloyd(rows, 2, 3)
    assert sorted(map(str, [(r.vec_id, r.cluster, r.distance) for r in clustered(spark, rows + odd, clusters=2, width=2).collect()])) == sorted(map(str, wanted))
    assert clustered(spark, odd, width=2).collect() == [] and clustered(spark, [], width=2).collect() == []
    alone = clustered(spark, [(1, [1.0, 2.0])], width=2).collect()
    assert [(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in alone] == [(0, 0, 0, 0)]
    few = clustered(spark, rows[:3], clusters=16, width=2).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.distance for r in few} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=3, max_size=40), st.integers(2, 4))
def test_bounds_never_change_a_result(points, k):
    import pandas as pd

    x = np.array(points, dtype=np.int64)
    c = [list(map(int, p)) for p in x[:k]]
    state, before = pd.DataFrame({"cluster": -1, "upper": 0.0, "lower": 0.0, "scans": 0}, index=range(len(x))), None
    for _ in range(6):
        state = centroids._assigned(state, x, centroids._Centroids(c, before))
        plain = centroids.squared(x, np.array(c))
        assert state["cluster"].tolist() == plain.argmin(axis=1).tolist()
        before, c = c, [[int(v) for v in x[plain.argmin(axis=1) == j].sum(axis=0) // max((plain.argmin(axis=1) == j).sum(), 1)] if (plain.argmin(axis=1) == j).any() else c[j] for j in range(len(c))]


# --- fill-in-the-middle ---------------------------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=2000))
def test_rank_and_select_equal_counting(bits):
    found = infill.Boundaries(np.array(bits, dtype=bool))
    ones = [i + 1 for i, b in enumerate(bits) if b]
    assert found.total == len(ones) and [found.select(k) for k in range(len(ones) + 1)] == [0, *ones]
    assert [found.rank(i) for i in range(len(bits) + 1)] == [0, *np.cumsum(bits).tolist()]
    with pytest.raises(IndexError):
        found.select(len(ones) + 1)


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.text(alphabet="ab \t\n\x1cé😀", max_size=60))
def test_boundaries_are_those_of_tokens(text):
    found = infill.Boundaries.of(text.encode())
    ends = np.cumsum([len(t.encode()) for t in TOKEN.findall(text)]).tolist()
    assert [found.select(k + 1) for k in range(found.total)] == ends


def test_texts_are_cut_and_put_together_again(spark):
    texts = ["", None, " ", "one", "two words", "  lead and trail  ", "é😀 ü\tñ", "has <S> mark", "< P> <", "<<P ends in <", "x" * 300_000, "a b " * 100_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts * 20)] + [(None, "no id at all", "x", 1)] * 2 + [(5, "same id", "x", 1)] * 2
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, output string, _raw long"))
    found = made.select("*", infill.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert {r.form for r in found} == {"plain", "spm", "psm"} and len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        same = [r for r in by_id[i] if r.again == (text or "")]
        assert same
        tokens, h = TOKEN.findall(text or ""), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50
        form = "plain" if plain else "spm" if h4 % 100 < 80 else "psm"
        output = text or "" if plain else f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
        assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (len(tokens), form, None if plain else len(p), None if plain else len(m), output) for r in same)
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
