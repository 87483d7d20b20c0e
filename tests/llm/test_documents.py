"""Operators on documents against brute force, with nulls, empties, repeats and clashing columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import language, mixing, packing, quality, simhash, sstable, substring
from vellum.session import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, fp string, `key` string, size int, _unit int, kept string"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 1, "f", "k", 2, 3, "z")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        row(1, f"alpha beta {PASSAGE} gamma"),
        row(2, f"{PASSAGE} delta\n\tepsilon  zeta"),
        row(3, "only here and nowhere else", None, None),
        row(4, None, None, "b"),
        row(5, "", "xx", None),
        row(6, "   \n\t "),
        row(7, f"alpha beta {PASSAGE} gamma"),
        row(7, f"alpha beta {PASSAGE} gamma"),  # a repeated row
        row(8, "ha " * 70, "en", "b"),
        row(None, f"{PASSAGE} for nobody", "de", "b"),
        row(9, LONG, "de", "c"),
        row(10, LONG + " tail", "de", "c"),
        row(11, "Ünïcode wörds, with spaces and É", "fr", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id = -1")


def rows_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# --- SimHash -------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = text.lower().split() if isinstance(text, bytes) else (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, seed=42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and root[b] < root[a]:
                    root[a] = root[b]
                    changed = True
    return root


def test_simhash_on_odd_rows(odd, none):
    got = rows_of(simhash.simhash_groups(odd), "doc_id", "fingerprint", "component_id")
    texts = [(r.doc_id, slow_fingerprint(r.text)) for r in odd.collect()]
    assert all(len({f for d, f in texts if d == i}) == 1 for i in {d for d, _ in texts})
    prints = {d: f for d, f in texts if d is not None}
    root = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    of_null = {root[d] for d in prints if (prints[d] ^ dict(texts)[None]).bit_count() <= 3}
    want = [(d, f, root[d] if d is not None else min(of_null, default=None)) for d, f in texts]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((d, int(fp, 16), comp) for d, fp, comp in got), key=key) == sorted(want, key=key)
    assert rows_of(simhash.simhash_groups(none), "doc_id") == []
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert {4, 3, 11, None} <= {r.doc_id for r in kept.collect()} and 5 not in {r.doc_id for r in kept.collect()}
    assert simhash.simhash_dedup(none).count() == 0


def test_simhash_of_any_ids(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(high, "one two three four"), (high - 1, "one two three four"), (low, "five six seven"), (2**62, "five six seven"), (2**62 + 5, "alone in here"), (None, "nobody has this"), (None, "five six seven")]
    rows += [(77, "two texts"), (77, "of one id")]
    got = sorted(rows_of(simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id"), key=repr)
    want = [(high, high - 1), (high - 1, high - 1), (low, low), (2**62, low), (2**62 + 5, 2**62 + 5), (None, None), (None, low), (77, 77), (77, 77)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("block", [simhash.BLOCK, 50])
def test_ball_links_all_within_three(spark, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:25]:  # chains and clusters at distances of up to four
        for k in (1, 2, 3, 4):
            x = int(b)
            for bit in rng.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    for i in range(300):  # a group of near copies that all share a half
        prints.append(0xABCDEF0100000000 | int(rng.integers(0, 1 << 9)))
    p = np.array(list(dict.fromkeys(prints)), np.uint64)
    signed = p.view(np.int64)
    edges = simhash.ball_links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), block=block)
    if block == simhash.BLOCK:
        assert len(rows_of(edges, "a", "b")) < 6 * len(p)  # a forest for each bucket, not all pairs
    from vellum.operators.graph import connected_components, local_forest

    got = dict(rows_of(connected_components(edges), "node", "component"))
    x, y = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3)
    node, root = local_forest(signed[x], signed[y])
    want = dict(zip(node.tolist(), root.tolist()))
    assert all(got.get(i, i) == want.get(i, i) for i in signed.tolist())


def near_copies():
    """(id, text) of originals and copies of them with one to ten places changed, and of strangers."""
    rng, out = np.random.default_rng(8), []
    passage = [f"common{k}" for k in range(40)]
    for base in range(30):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(30, 300)))] + (passage if base % 2 else [])
        out.append(words)
        for changes in (1, 2, 3, 5, 10):
            copy = list(words)
            for at in rng.choice(len(copy), min(changes, len(copy) // 2), replace=False):
                copy[at] = f"new{rng.integers(0, 10**9)}"
            out.append(copy)
    base = [f"hot{k}" for k in range(120)]
    for k in range(80):  # a large group, of which some are alike
        out.append([f"{w}x{k}" if at in set(rng.choice(120, 1 + k % 4).tolist()) else w for at, w in enumerate(base)])
    out += [["few", "words"], ["few", "Words"], ["five", "words", "and", "no", "more"], []]
    return [(i + 1, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("small", [False, True])
def test_dedup_finds_all_near_copies(spark, monkeypatch, small):
    from vellum.llm import near

    docs = near_copies()
    sets = {}
    for i, text in docs:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = list(sets)
    alike = {(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(alike) > 100
    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs}
    assert sum((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in alike) < len(alike) / 2  # three bits would miss most
    root = components(ids, lambda a, b: (min(a, b), max(a, b)) in alike)
    rows = docs + [(10_000 + i, t) for i, t in docs for _ in range(2)] + [(None, docs[0][1])]
    if small:  # buckets, ranges and blocks of pairs are cut, and joins shuffle
        for name, value in dict(BLOCK=7, HOT=3, HELD=500, CELL_BYTES=2048, BLOCK_BYTES=4096, BROADCAST_ENDS=0, SMALL=4).items():
            monkeypatch.setattr(near, name, value)
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {i for i in ids if root[i] == i} | {None}


def test_parities_accept_only_what_is_alike():
    """Verdicts on pairs around the threshold against sets; nothing is left open when sets are compared."""
    import pyarrow as pa

    from vellum.llm import near

    rng = np.random.default_rng(2)
    names, pairs, want = {}, [], []
    for k in range(120):
        n = int(rng.integers(3, 3000))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - int(n * rng.uniform(0, 0.2))], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.15)), dtype=np.uint64)])
        names[2 * k], names[2 * k + 1] = np.unique(a), np.unique(b)
        pairs.append((2 * k, 2 * k + 1))
        shared = len(np.intersect1d(a, b))
        want.append(5 * shared >= 4 * len(np.union1d(a, b)))
    for whole in (False, True):
        blob = lambda x: near._squeezed(x) if whole else (x if len(x) <= near.SMALL else near.parities(x, 1 << max(0, int(near.CLASSES * len(x) - 1).bit_length() - 3))).tobytes()
        ends = pa.table({"node": list(names), "n": [len(x) for x in names.values()], "blob": [blob(x) for x in names.values()]})
        got = near._try(whole)(pa.table({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}), ends).column("verdict").to_numpy()
        assert all(g == 2 or g == w for g, w in zip(got, want)) and (not whole or 2 not in got)
        assert (got == 1).sum() > 15 and (got == 0).sum() > 15


# --- substring dedup ---------------------------------------------------------------------------


def slow_substring(texts, window=20):
    seen, out = set(), []
    for text in texts:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((len(words), sum(gone), b" ".join(kept).decode()))
    return out


@pytest.mark.parametrize(("unit_bytes", "crowded"), [(4096, 4096), (2000, 1), (1 << 22, 4096)])
def test_substring_matches_brute_force(spark, unit_bytes, crowded):
    rng = np.random.default_rng(unit_bytes)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choice(vocabulary, 30)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(2)]
        texts.append(parts[0] + " " + shared[int(rng.integers(5))] * int(rng.integers(0, 2)) + "\n" + parts[1])
    texts += texts[:7] + ["ha " * 50, "x y " * 30, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring.substring_dedup(docs, unit_bytes=unit_bytes, crowded=crowded)
    got = sorted(rows_of(got, "_c0", "n_words", "n_removed", "kept"))
    assert [g[1:] for g in got] == slow_substring(texts)


def test_substring_odd_rows(odd, none):
    found = substring.substring_dedup(odd).collect()
    assert len(found) == odd.count()
    by = defaultdict(list)
    for r in found:
        by[r._c0].append(r)
    assert by[None][0].n_removed == 0  # a null id precedes all, so its passage stays
    assert by[1][0].n_removed == 60 and by[1][0].kept == "alpha beta gamma"
    assert sorted(r.n_removed for r in by[7]) == [63, 63] and [r.begin for r in by[1][0].spans] == [2]
    assert by[10][0].kept.split()[-1] == "tail" and by[4][0].n_words == 0
    clean = substring.substring_clean(odd)
    assert clean.schema == odd.schema
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert 7 not in texts and texts[3] == "only here and nowhere else" and texts[6] == "   \n\t " and texts[4] in (None, "")
    assert substring.substring_dedup(none).count() == 0 and substring.substring_clean(none).count() == 0


# --- mixing --------------------------------------------------------------------------------------


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        votes, most, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 12, n), int(rng.integers(0, 40))
        got = np.zeros(n, int)
        for _ in range(int(min(seats, most[votes > 0].sum()))):
            q = np.where((got < most) & (votes > 0), votes / (2 * got + 1), -1)
            got[int(q.argmax())] += 1
        mine = mixing.sainte_lague(votes, seats, most)
        assert mine.sum() == got.sum() and (mine <= most).all()
        ordered = lambda g: sorted(v / (2 * k + 1) for v, c in zip(votes, g) for k in range(c))
        assert np.allclose(ordered(mine), ordered(got))


def test_targets_share_everything_below_their_caps():
    size = np.array([10.0, 1000, 0, 500, 3])
    target = mixing.fill_targets(size, np.resize([5.0, 2, 1], 5))
    assert np.isclose(target.sum(), size.sum()) and (target <= 3 * size + 1e-9).all() and target[0] == 30


def test_mix_odd_rows(odd, none):
    plan = mixing.mix_plan(odd, block_words=4, shard_words=1000).collect()
    again = mixing.mix_plan(odd.repartition(5), block_words=4, shard_words=1000).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert len(plan) == odd.count() and sorted(map(key, plan)) == sorted(map(key, again))
    size = defaultdict(int)
    for r in odd.collect():
        size[r.source] += len((r.text or "").encode().split())
    assert {r.source_size for r in plan} == set(size.values())
    by = defaultdict(lambda: [0, 0.0])
    for r in plan:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert np.isclose(sum(t for _, t in by.values()), sum(size.values()))
    for taken, target in by.values():
        assert abs(taken - target) <= max(150, 0.02 * target)
    mixed = mixing.mix_documents(odd, block_words=4, shard_words=1000)
    assert mixed.schema.simpleString() == odd.schema.simpleString() and all(r.text and r.n_chars == len(r.text) for r in mixed.collect())
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mix_takes_of_every_row_what_the_plan_does(spark):
    from collections import Counter

    rows = []
    for i in range(240):  # ids that two sources share, and none
        id_ = None if i % 4 == 0 else i // 6
        rows.append((id_, " ".join(f"r{i}w{k}" for k in range(5 + i * 7 % 90)), "ab"[i % 2] if i % 5 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = dict(block_words=4, shard_words=400)
    plan = Counter((r.doc_id, r.taken) for r in mixing.mix_plan(docs, **options).collect() if r.taken)
    got = [(r.doc_id, r.source, r.text) for r in mixing.mix_documents(docs, **options).collect()]
    assert Counter((d, len(t.split())) for d, _, t in got) == plan
    again = mixing.mix_documents(docs.repartition(7), **options).collect()
    assert Counter(got) == Counter((r.doc_id, r.source, r.text) for r in again)


def test_mix_with_many_groups_of_shards(spark, monkeypatch):
    """`taken` against the words that the mixed texts hold, with several levels of apportionment."""
    from collections import Counter

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(rng.integers(0, 60)))), "abc"[int(rng.integers(0, 3))]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    options = dict(block_words=5, shard_words=200)
    plan = mixing.mix_plan(docs, **options).collect()
    texts = {r.doc_id: Counter(r.text.split()) for r in mixing.mix_documents(docs, **options).collect()}
    own = {i: set(t.split()) for i, t, _ in rows}
    by = defaultdict(lambda: [0, 0.0])
    for r in plan:
        words = texts.get(r.doc_id, Counter())
        assert sum(words.values()) == r.taken and set(words) <= own[r.doc_id] and max(words.values(), default=0) <= 3
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert all(abs(t - want) <= max(60, 0.03 * want) for t, want in by.values()) and len(by) == 3


def test_mix_near_targets(spark, data):
    rows = mixing.mix_plan(read_table(spark, data, "documents")).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= max(200, 0.05 * r.target) for r in rows)


# --- tokens: packing and shards ------------------------------------------------------------------


def test_packing_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack_documents(odd, path).collect()
    want = []
    for r in odd.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(r.doc_id), k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


def test_search_of_bins_with_many_pieces():
    rng = np.random.default_rng(3)
    lengths = np.r_[rng.integers(1, 4, 900), np.full(40, 70), rng.integers(55, 75, 60)]
    bins = packing.pack(lengths, 100)
    assert np.bincount(bins, lengths).max() <= 100 and bins.max() + 1 == 100  # as many as are over half
    counts = packing.Counter([5, 5, 3, 2, 2, 2])
    assert sorted(packing._pairs(counts)) == [(2, 2), (3, 2), (5, 2), (5, 3), (5, 5)]


def test_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])
    assert packing.pack(lengths, 10).max() + 1 == 3
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(60):
        lengths = rng.integers(260, 420, 60)
        bins = packing.pack(lengths, 1000)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 1000 and (fill > 0).all() and len(bins) == 60
        search, packing._search = packing._search, lambda state: None
        plain = packing.pack(lengths, 1000).max()
        packing._search = search
        assert bins.max() <= plain
        better += bins.max() < plain
    assert better > 0


def test_shards_round_trip(spark, odd, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = sstable.write_shards(odd, path, f"file://{tmp_path}/sst", shards=3)
    digest = sstable.read_digest(manifest).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, digest), key=lambda r: r[1]) == want
    for m in manifest.collect():
        fs, name = sstable._open(m.path)
        with fs.open_input_file(name) as file:
            reader = sstable.Reader(file)
            for doc, _, n, crc in want:
                ids = reader.get(sstable.key_of(doc))
                if ids is not None:  # of an id that repeats any row's
                    assert (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) in {(n_, c) for d, _, n_, c in want if d == doc}
            assert reader.get(sstable.key_of(999)) is None
    assert sstable.read_digest(sstable.write_shards(none, path, f"file://{tmp_path}/empty")).count() == 0
    with pytest.raises(ValueError, match="scheme"):
        sstable.write_shards(odd, path, f"{tmp_path}/plain")


def test_shards_split_an_id_of_many_rows(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(sstable, "SHARD_BYTES", 2000)
    rows = [(5, f"{k:04d} of one id") for k in range(600)] + [(None, f"{k} of none") for k in range(300)] + [(9, None), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = sstable.write_shards(docs, path)
    assert manifest.count() > 4 and max(r.entries for r in manifest.collect()) < 450
    library, at, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, sstable.read_digest(manifest).collect()), key=lambda r: r[1]) == want


def test_shard_of_many_blocks(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "x")) as out:
        writer = sstable.Writer(out, block_bytes=200)
        for i in range(500):
            writer.add(sstable.key_of(3 * i - 700), np.arange(i % 7, dtype=np.int32) + 70_000 * (i % 2))
        writer.finish()
        with pytest.raises(ValueError, match="ascend"):
            writer.add(b"\0", np.empty(0, np.int32))
    with fs.open_input_file(str(tmp_path / "x")) as file:
        reader = sstable.Reader(file)
        assert len(reader.index) > 20 and reader.entries == 500
        for i in range(500):
            assert reader.get(sstable.key_of(3 * i - 700)).tolist() == (np.arange(i % 7) + 70_000 * (i % 2)).tolist()
            assert reader.get(sstable.key_of(3 * i - 699)) is None


# --- language and quality ----------------------------------------------------------------------


def test_language_fuses_evidence(spark):
    import random

    rng = random.Random(3)
    words = {"en": ["the", "and", "with", "house", "weather"], "de": ["und", "nicht", "für", "straße", "wetter"]}
    page = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, page(k, 40), k, f"www.{k}.example.{'de' if k == 'de' else 'com'}") for i, k in enumerate(["en", "de"] * 60)]
    rows += [(1000, page("de", 40), "en", "www.en.example.com")]  # the text outweighs what is declared
    rows += [(1001, "wetter", None, "www.de.example.de"), (1002, "12345 67890 #### 999", "en", None), (1003, None, "en", None), (1004, "", None, None)]
    rows += [(1005, "zzqx xqzz " * 60, None, None), (None, page("en", 30), "en", "www.en.example.com")]
    df = spark.createDataFrame(rows, "id_ long, text string, lang string, host string")
    got = {r.id: r for r in language.identify(df, "id_", F.col("text"), F.col("lang"), F.col("host")).collect()}
    assert all(got[i].language == ("de" if i % 2 else "en") and got[i].accepted for i in range(120))
    assert got[1000].language == "de" and got[1001].language == "de" and got[None].language == "en"
    assert not any(got[i].accepted for i in (1002, 1003, 1004)) and got[1002].language == "und"
    assert not got[1005].accepted
    assert language.identify(df.where("id_ < 0"), "id_", F.col("text"), F.col("lang")).count() == 0


def test_rare_languages_stay_in_a_large_corpus(spark):
    rng = np.random.default_rng(3)
    common = [f"the{k} and house of water".replace(str(k), "") for k in range(3)] + ["there was with that other thing which"]
    rare = ["qazxu vyjq kxoqy", "zuxqa jyqvu oxkqz", "xyqzu kvajq uqoxz"]
    few = ["אבג דהו זחט", "יכל מנס עפצ"]
    text = lambda of: " ".join(of[x] for x in rng.integers(0, len(of), 12))
    rows = [(i, text(common), "en") for i in range(15_000)]
    rows += [(20_000 + i, text(rare), "qx") for i in range(12)] + [(30_000 + i, text(few), "he") for i in range(3)]
    rows += [(40_000, "12 34 56", "he"), (40_001, text(few), "nocode")]
    docs = spark.createDataFrame([(i, t, c, "a") for i, t, c in rows], "doc_id long, text string, lang string, source string")
    found = {r.id: r for r in language.identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).where("id >= 20000").collect()}
    assert all(found[20_000 + i].language == "qx" and found[20_000 + i].accepted for i in range(12))  # 0.08 % of the rows
    assert all(found[30_000 + i].language == "he" and found[30_000 + i].accepted for i in range(3))
    assert not found[40_000].accepted and not found[40_001].accepted
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert {i for i, _, c in rows if c in ("qx", "he") and i < 40_000} <= kept


def test_host_priors_are_smoothed_by_level(spark):
    text = [0.0, 0.0, -50.0]
    rows = [(i, None, "a.site.de", [5.0, 0.0, -50.0], True) for i in range(200)] + [(900, None, "new.site.de", text, True), (901, None, "x.other.fr", text, True)]
    rows += [(300 + i, None, "b.other.fr", [0.0, 5.0, -50.0], True) for i in range(200)]
    scored = spark.createDataFrame(rows, "id long, declared string, host string, text array<double>, letters boolean")
    got = {r.id: r for r in language._fuse(scored, ["de", "fr"], 0.5).collect()}
    assert got[900].language == "de" and got[900].posterior > 0.9 and got[901].language == "fr"


def test_language_keeps_clean_documents(spark, odd, none, data):
    docs = read_table(spark, data, "documents")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    assert language.keep_identified(odd).schema == odd.schema and language.keep_identified(none).count() == 0


def test_language_judges_rows_that_share_an_id(spark):
    page = "the weather and the house with that water was there"
    rows = [(i, page, "en", "a") for i in range(40)] + [(7, "123 456 ### 789", "en", "a"), (None, page, "en", "a"), (None, "0 1 2", "en", "a"), (3, page, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_row", F.lit(1))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(i, page) for i in range(40)] + [(None, page), (3, page)], key=repr)


def slow_language(rows, codes):
    """(language, posterior, accepted) of (text, code, host) rows, value by value."""
    import math
    import re

    trigrams = []
    for text, _, _ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        trigrams.append([int(b) for b in language._trigrams(language._LOWER[raw])] if len(raw) > 2 else [])
    counts = {c: defaultdict(float) for c in codes}
    for (_, code, _), found in zip(rows, trigrams):
        for b in found:
            if code in counts and b:
                counts[code][b] += 1
    share = {c: {b: math.log((counts[c][b] + language.TRIGRAM_PRIOR) / (sum(counts[c].values()) + language.TRIGRAM_PRIOR * (language.BUCKETS - 1))) for b in range(1, language.BUCKETS)} for c in codes}
    texts, best, letters = [], [], []
    for (text, _, _), found in zip(rows, trigrams):
        own = [b for b in found if b]
        weight = language.TEMPER * math.sqrt(len(own))
        texts.append([(sum(share[c][b] for b in own) / len(own) * weight if own else 0.0) for c in codes] + [-math.log(language.BUCKETS) * weight if own else 0.0])
        best.append(texts[-1].index(max(texts[-1])))
        letters.append(any(ch.isalpha() for ch in text or ""))
    n, size = len(rows), len(codes)
    sure = [i for i in range(n) if best[i] < size and letters[i]]
    prior = [(sum(best[i] == k for i in sure) + 1.0) / (len(sure) + size) for k in range(size)]
    parts = [(h.split(".")[-1] if h and "." in h else None, ".".join(h.split(".")[-2:]) if h and h.count(".") > 1 else None, h) for _, _, h in rows]
    said = {c: [sum(best[i] == k and rows[i][1] == c for i in sure) for k in range(size)] for c in codes if any(rows[i][1] == c for i in sure)}
    whole = [sum(v[k] for v in said.values()) + language.EVIDENCE_PRIOR * size for k in range(size)]
    out = []
    for i, (text, code, _) in enumerate(rows):
        level = prior
        for at in range(3):
            same = [j for j in sure if parts[i][at] is not None and parts[j][at] == parts[i][at]]
            level = [(sum(best[j] == k for j in same) + language.HOST_PRIOR * level[k]) / (len(same) + language.HOST_PRIOR) for k in range(size)]
        terms = [texts[i][k] + (math.log((said[code][k] + language.EVIDENCE_PRIOR) / whole[k]) if code in said else 0.0) + math.log(level[k]) for k in range(size)]
        terms.append(texts[i][size] + (-math.log(size) if code in said else 0.0) + math.log(language.UNKNOWN_PRIOR))
        top = terms.index(max(terms))
        posterior = 1 / sum(math.exp(t - terms[top]) for t in terms)
        name = ([*codes, "und"][top]) if letters[i] else "und"
        accepted = top < size and posterior >= 0.5 and letters[i]
        if letters[i] and code and re.fullmatch("[a-z]{2,3}", code) and code not in codes and not accepted:
            name, posterior, accepted = code, 0.0, True
        out.append((name, round(posterior, 9), accepted))
    return out


def test_language_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    words = {"en": ["the", "and", "with", "house", "weather", "water"], "de": ["und", "nicht", "haus", "wetter", "wasser", "der"], "fr": ["le", "maison", "avec", "temps", "eau", "dans"]}
    rows = []
    for i in range(160):
        c = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice(words[c] if rng.random() < 0.9 else words["en"], int(rng.integers(1, 30))))
        rows.append((text, c if rng.random() < 0.8 else ["en", None, "xx"][i % 3], [f"a{i % 4}.site.{c}", f"one.{c}", "plain", None][i % 4]))
    rows += [(None, "en", None), ("", None, None), ("12 34", "de", "one.de"), ("qzx wvk " * 20, None, "plain"), ("die Haus", "zz", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, text string, code string, host string").repartition(3)
    codes = ["de", "en", "fr"]
    got = {r.id: (r.language, round(r.posterior, 9), r.accepted) for r in language.identify(df, "k", F.col("text"), F.col("code"), F.col("host"), codes).collect()}
    want = slow_language(rows, codes)
    assert all((got[i][0], got[i][2]) == (w[0], w[2]) and abs(got[i][1] - w[1]) < 1e-5 for i, w in enumerate(want))
    assert {w[0] for w in want} >= {"de", "en", "fr", "und"}


def test_rule_weights_are_lasso_optimal():
    """No change of a weight by the subgradient conditions, and scores as the rules say."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) | (rng.random(400) < 0.1)).astype(float)
    names = list("abcd")
    z = np.stack([x[:, 0] > 0.2, x[:, 1] < 0.5, x[:, 2] > 0, x[:, 3] < 1], axis=1).astype(float)
    for penalty in (0.05, 0.01):
        b, w = quality.lasso_logistic(z, y, penalty, steps=4000)
        p = 1 / (1 + np.exp(-(z @ w + b)))
        slope = ((z - z.mean(0)) / (z.std(0) + 1e-9)).T @ (p - y) / len(y)
        assert abs((p - y).mean()) < 1e-5 and (np.abs(slope) <= penalty + 1e-5).all()
        live = np.abs(w) > 1e-9
        assert live.any() and np.allclose(slope[live], -penalty * np.sign(w[live]), atol=1e-5)
    model = quality.fit_rules(x, y, names)
    assert {n for r, _ in model.rules for n, _, _ in r} >= {"a", "b"}


def test_compiled_score_is_the_rules(spark, data):
    docs, labels = read_table(spark, data, "documents"), read_table(spark, data, "labels")
    scored, model = quality.quality_scores(docs, labels)
    stats = docs.select("doc_id", *(c.alias(n) for n, c in quality.text_statistics(F.col("text")).items())).collect()
    got = {r.doc_id: (r.score, r.predicted) for r in scored.collect()}
    for r in stats:
        total = model.bias + sum(w for rule, w in model.rules if all((r[n] > t) if above else (r[n] <= t) for n, above, t in rule))
        want = 1 / (1 + np.exp(-total))
        assert abs(got[r.doc_id][0] - want) < 1e-9 and got[r.doc_id][1] == (want >= 0.5)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    scored, model = quality.quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    rank, y = rows.score.rank().to_numpy(), rows.quality.to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.95 and (rows.predicted == y).mean() > 0.9
    assert 0 < len(model.rules) < 120
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows.itertuples())
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_scores(docs, other)[0]
    assert again.exceptAll(scored).count() == 0  # held-out labels and other columns change nothing


def test_quality_of_few_labels(spark, data):
    docs, labels = read_table(spark, data, "documents"), read_table(spark, data, "labels")
    scored = quality.quality_scores(docs, labels)[0].join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert good and (not bad or np.mean(good) > np.mean(bad))


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(odd, labels)[0].collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert quality.quality_scores(none, labels)[0].count() == 0
    x, y = np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0.0, 0, 1, 1])
    for rows in (slice(0, 4), slice(1, 3), slice(2, 4), slice(0, 0)):
        assert np.isfinite(quality.fit_rules(x[rows], y[rows], ["words"]).bias)
    assert quality.quality_scores(odd, labels.where("quality = 7"))[0].count() == odd.count()


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, data, tmp_path):
    import corpus_pipeline

    docs = read_table(spark, data, "documents")
    before, words = docs.count(), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns and out.count() <= before
            if k == 2:
                assert sum(n for _, n, _ in slow_substring([r.text for r in out.orderBy("doc_id").collect()])) == 0
            if k == 3:
                words = sum(len(r.text.encode().split()) for r in out.collect())
                was = sum(len(r.text.encode().split()) for r in docs.collect())
                assert abs(words - was) < 0.05 * was
        before, docs = out.count(), out
    assert docs.agg(F.count_distinct("sequence_id")).first()[0] > 0
    digest = lambda df: sorted(hashlib.sha256(repr(sorted(r.asDict().items())).encode()).hexdigest() for r in df.drop("sequence_id", "offset").collect())
    assert digest(docs) == digest(corpus_pipeline.run(spark, data))
