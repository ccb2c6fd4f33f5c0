"""Whole-document packing, tokenizer alignment and vector codes against brute force, libraries and SQL."""

import bisect
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fahrwerk.llm import best_fit, token_alignment, vector_codes
from fahrwerk.llm.vocab import vocabulary_path

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "one", "  a  b \n c\t d  ", "▁x y", "日本語 テキスト 🙂🙂 ünï <|endoftext|> <s></s> <0x41>", "x" * 5000, "a  b\x1c c\x00 d 　 e", "\n\n  \n", "don't  'll  it's\r\n  ok", "again ", "again "]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and doc_ids, white space, and columns whose names the operators use."""
    rows = [(10_000 + i, t, "x", 1, i, 2) for i, t in enumerate(TEXTS)] + [(10_003, "one more", "y", None, None, 3), (10_003, "one", "x", 1, 3, 2), (None, "no id here", None, None, None, None), (20_000, "word and " * 9000, "z", 0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, slice string, pair long, rank long, cell int")


@pytest.fixture(scope="module")
def documents(spark, odd):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))


# Packing


def word_ids(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_documents_are_packed(documents):
    rows = documents.collect()
    want = collections.Counter()
    for r, ids in zip(rows, word_ids([r.text for r in rows]), strict=True):
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    got = best_fit.pack_whole(documents).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1


def test_packing_is_the_same_in_any_partitioning(documents):
    rows = [sorted(map(tuple, best_fit.pack_whole(documents.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert rows[0] == rows[1]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert best_fit.pack_whole(none).count() == 0
    assert token_alignment.alignment_figures(none).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_patterns_are_all_that_fill_a_window():
    have = np.array([1, 2, 3, 5, 7, 10, 11, 12, 19])
    want = {(0, a, b) for a in have for b in have if a <= b and a + b == 20} | {(a, b, c) for a in have for b in have for c in have if a <= b <= c and a + b + c == 20}
    assert set(map(tuple, best_fit.patterns(have, 20).tolist())) == want


def test_counts_are_a_non_negative_least_squares_fit():
    rng = np.random.default_rng(2)
    rows = best_fit.patterns(np.arange(1, 64), 64)
    true = np.zeros(len(rows))
    true[rng.choice(len(rows), 30, replace=False)] = rng.integers(50, 4000, 30)
    matrix = np.zeros((65, len(rows)))
    for column in rows.T:
        np.add.at(matrix, (column, np.arange(len(rows))), 1)
    matrix[0] = 0
    weight = np.sqrt(np.arange(65) / 64)
    for target in (matrix @ true, matrix @ true + rng.integers(0, 3000, 65) * (np.arange(65) > 0)):
        x = best_fit.Fit(rows, target).run()
        assert x.min() >= 0
        # Projected gradient steps from there must not find anything much better.
        y, a, b = x.copy(), matrix * weight[:, None], target * weight
        rate = 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(3000):
            y = np.maximum(y - rate * (a.T @ (a @ y - b)), 0)
        error = [float(((a @ z - b) ** 2).sum()) for z in (x, y)]
        assert error[0] <= error[1] + 1e-3 * float((b**2).sum())


def test_best_fit_takes_the_least_room_that_holds():
    rng = random.Random(4)
    for _ in range(40):
        window = rng.choice([10, 50, 400])
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(1, 120))), reverse=True)
        rooms, want = [], 0
        for n in lengths:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            else:
                want += 1
            rooms.append((min(fits) if fits else window) - n)
        found = list(best_fit.best_fit(dict(collections.Counter(lengths)), window))
        used = collections.Counter()
        for pattern, times in found:
            assert sum(n * k for n, k in pattern.items()) <= window
            used.update({n: k * times for n, k in pattern.items()})
        assert used == collections.Counter(lengths) and sum(times for _, times in found) <= want


def test_plans_place_every_rank_once():
    rng = np.random.default_rng(6)
    histogram = dict(collections.Counter(np.minimum(4096, rng.gamma(1.2, 700, 30_000).astype(int) + 1).tolist()))
    made = best_fit.plan(histogram)
    length = np.repeat(np.array(list(histogram)), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, offset = made.place(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, end = sequence[order], offset[order], (offset + length)[order]
    first = np.diff(sequence, prepend=-1) != 0
    assert (offset[first] == 0).all() and (offset[~first] == end[:-1][~first[1:]]).all() and end.max() <= 4096
    assert len(np.unique(sequence)) == made.sequences <= -(-int(length.sum()) // 4096) + 2


# Alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    both = token_alignment.aligner()
    found = []
    for doc, text in rows:
        raw = f" {text}".encode()
        a, b = a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text or "")
        bytes_a, bytes_b = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append((doc, [], [], 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        links = []
        for k, end in enumerate(ends_a):
            begin = ends_a[k - 1] if k else 0
            m = bisect.bisect_right(ends_b, begin)
            while m < len(b) and (ends_b[m - 1] if m else 0) < end:
                links.append((a[k], b[m]))
                m += 1
        found.append((doc, a, b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = collections.Counter(p for f in found for p in set(f[4]))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return collections.Counter((d, len(a), len(b), g, len(l), sum(count[p] == best[p[0]] for p in l), sum(count[p] for p in l), h) for d, a, b, g, l, h in found)


def test_alignment_equals_brute_force(documents, monkeypatch):
    want = brute_alignment([(r.doc_id, r.text) for r in documents.collect()])
    for parts in (1, 7):
        got = token_alignment.alignment_figures(documents.repartition(parts))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert collections.Counter(map(tuple, got.collect())) == want


def test_small_slices_give_the_same(spark, documents, monkeypatch):
    rows = documents.limit(60).collect()
    batches = list(token_alignment._slices(token_alignment.FIRST, token_alignment.SECOND)([documents.limit(60).toArrow().combine_chunks().to_batches()[0]]))
    monkeypatch.setattr(token_alignment, "SLICE", 500)
    more = list(token_alignment._slices(token_alignment.FIRST, token_alignment.SECOND)([documents.limit(60).toArrow().combine_chunks().to_batches()[0]]))
    total = lambda bs: {p: n for p, n in sum((collections.Counter(dict(zip(b["pair"].to_pylist(), b["n"].to_pylist(), strict=True))) for b in bs if b["kind"][0].as_py() == 0), collections.Counter()).items()}
    assert total(batches) == total(more) and sum(b["kind"][0].as_py() for b in more) > 20 and len(rows) == 60


def test_groups_are_whole(documents):
    want = {r.groups_sha256 for r in token_alignment.alignment_figures(documents).collect()}
    for r in token_alignment.aligned_groups(documents).collect():
        text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (hashlib.sha256(text.encode()).hexdigest() if r.groups else "") in want


def test_galloping_and_overlaps_equal_brute_force():
    rng = random.Random(8)
    for _ in range(100):
        lists, firsts, base = [[], []], [[0], [0]], 0
        wants = [[], [], []]
        for _ in range(rng.randint(1, 5)):
            n = rng.choice([1, 3, 40, 300])
            own = [sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2)]
            spans = [list(zip([0, *x[:-1]], x, strict=True)) for x in own]
            at = [len(x) for x in lists]
            wants[0] += [(at[0] + own[0].index(x), at[1] + own[1].index(x)) for x in sorted(set(own[0]) & set(own[1]))]
            wants[1] += [(at[0] + i, at[1] + j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
            wants[2] += [at[1] + bisect.bisect_left(own[1], x) for x in own[0]]
            for k in (0, 1):
                lists[k] += [base + x for x in own[k]]
                firsts[k].append(len(lists[k]))
            base += n
        a, b, first_a, first_b = map(np.array, (*lists, *firsts))
        chunk = np.repeat(np.arange(len(first_a) - 1), np.diff(first_a))
        assert token_alignment.gallop(a, b, first_b[:-1][chunk], first_b[1:][chunk]).tolist() == wants[2]
        both_a, both_b, link_a, link_b = token_alignment.align_ends(a, b, first_a, first_b)
        assert list(zip(both_a.tolist(), both_b.tolist(), strict=True)) == wants[0]
        assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == wants[1]


def test_a_full_cache_starts_anew(documents, monkeypatch):
    rows = [r.text for r in documents.limit(80).collect()]
    both = token_alignment.aligner()
    both.forget()
    whole = [b";".join(both.groups[k] for k in numbers[r].tolist()) for numbers, found in [both.chunks(rows)] for r in found]
    both.forget()
    monkeypatch.setattr(token_alignment, "CACHE_LIMIT", 300)
    for text, want in zip(rows, whole, strict=True):
        numbers, (r,) = both.chunks([text])
        assert b";".join(both.groups[k] for k in numbers[r].tolist()) == want
    both.forget()


# Vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted([r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])], key=lambda r: (r[0] is None, r[0], list(r[1])))
    whole = [[int(np.floor(float(x) * 1024)) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        at = [[min((sum((x - y) ** 2 for x, y in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]
        for p in range(parts if step < rounds else 0):
            for i in range(len(books[p])):
                own = [v[p] for v, a in zip(cut, at, strict=True) if a[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    total = collections.Counter()
    for r, a in zip(kept, at, strict=True):
        total[r[2]] += sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return collections.Counter((r[0], bytes(i for _, i in a).hex(), sum(d for d, _ in a), total[r[2]], digest) for r, a in zip(kept, at, strict=True))


def rows_of(frame):
    return collections.Counter(map(tuple, frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.op13_sql()})").fetchall()
    for parts in (1, 6):
        assert rows_of(vector_codes.vector_codes(spark.read.parquet(f"{SF}/embeddings.parquet").repartition(parts))) == collections.Counter(want)


def test_codes_of_odd_rows_equal_brute_force(spark):
    rng = random.Random(9)
    for many, scale in ((30, 1.0), (330, 0.01), (40, 1e30)):
        rows = [(i, [rng.choice([-1, 1]) * rng.random() * scale for _ in range(8)], rng.choice([None, 1, 2])) for i in range(many)]
        rows += [rows[3], (3, rows[4][1], 1), (None, rows[5][1], None), (900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, 2)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("taken")).withColumn("entry", F.lit(1))
        got = rows_of(vector_codes.vector_codes(frame))
        if scale > 1:  # beyond the limit of integers: held to it
            held = [(i, v and [None if x is None else x if not np.isfinite(x) else max(-(2.0**30), min(2.0**30, x)) for x in v], k) for i, v, k in rows]
            want = collections.Counter()
            for (i, code, error, both, digest), n in brute_codes(held).items():
                want[i, code, min(error, 2**63 - 1), min(both, 2**63 - 1), digest] += n
            assert {k[:2] + k[4:] for k in got} == {k[:2] + k[4:] for k in want}
        else:
            assert got == brute_codes(rows)


def test_vectors_of_other_lengths_are_dropped(spark):
    rows = [(i, [0.1 * i] * 8, 1) for i in range(5)] + [(9, [0.5] * 4, 1), (10, [], 1)]
    assert {r.vec_id for r in vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()} == set(range(5))
    rows = [(i, [0.5 * i] * 6, None) for i in range(4)]
    assert {r.code for r in vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()} >= {"00000000"}


def test_search_equals_a_look_at_all_entries():
    rng = np.random.default_rng(3)
    for k, width, spread in ((1, 3, 5), (7, 1, 3), (256, 16, 900), (256, 2, 40), (100, 4, 2)):
        entries = rng.integers(-spread, spread, (k, width)).astype(float)
        parts = rng.integers(-spread, spread, (500, width)).astype(float)
        at, best = vector_codes.Book(entries).nearest(parts)
        all_ = ((parts[:, None] - entries) ** 2).sum(axis=2)
        assert (at == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()


def test_search_passes_over_entries_beyond_twice_the_distance():
    rng = np.random.default_rng(5)
    centres = rng.integers(-20_000, 20_000, (256, 8)).astype(float)
    parts = centres[rng.integers(0, 256, 400)] + rng.integers(-5, 5, (400, 8))
    measured = []
    real, vector_codes.squared = vector_codes.squared, lambda x: (measured.append(len(x)), real(x))[1]
    try:
        book = vector_codes.Book(centres)
        measured.clear()
        book.nearest(parts)
    finally:
        vector_codes.squared = real
    assert sum(measured) < 400 * 256 / 2


def test_codes_are_decoded(spark):
    rows = usable = vector_codes.usable(spark.read.parquet(f"{SF}/embeddings.parquet"))
    books = vector_codes.fit(rows, rounds=1)
    back = books.decode(vector_codes.encode(usable, books, ["vec_id", "embedding"]))
    for r in back.limit(50).collect():
        whole = np.floor(np.array(r.embedding, np.float64) * 1024)
        assert r.error == ((whole - np.round(np.array(r.decoded) * 1024)) ** 2).sum()
