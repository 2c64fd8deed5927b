"""Near-duplicate operators against brute force."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import texts
from kinsieve.llm import bktree, common, components, lattice, neardup, simhash, suffixes


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def with_ids(spark):
    return texts.edge_docs(spark).where("doc_id is not null")


def test_simhash_groups_match_brute_force(spark):
    docs = with_ids(spark).dropDuplicates(["doc_id"])
    want = brute.simhash_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = simhash.simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_simhash_takes_repeats_nulls_empty_tables_and_clashing_names(spark):
    got = simhash.simhash_groups(texts.clashing(texts.edge_docs(spark)))
    assert got.count() == len(texts.edge_rows())
    by_id = {r.doc_id: r.component_id for r in got.collect()}
    assert by_id[None] == 1 and by_id[2] == 1 and by_id[6] == by_id[5] == by_id[7] == 5
    assert simhash.simhash_groups(texts.empty_docs(spark)).count() == 0


def test_bk_forest_finds_all_pairs_in_the_radius():
    rng = np.random.default_rng(0)
    value = np.unique(rng.integers(0, 1 << 12, 700, np.uint64) * np.uint64(0x1F))
    shard = np.sort(rng.integers(0, 5, len(value)))
    shard = np.unique(shard, return_inverse=True)[1]
    forest = bktree.build(shard, value)
    got = {(int(a), int(b)) for q, n in bktree.search(forest, shard, value, 3) for a, b in zip(q, n, strict=True)}
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 3
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near & (shard[:, None] == shard[None, :])), strict=True)}
    assert got == want


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_fingerprints_within_the_radius_agree_under_a_mask(blocks):
    masks, rng = simhash.block_masks(3, blocks), np.random.default_rng(blocks)
    for _ in range(200):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_components_of_chains_stars_and_repeats(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (9, 8), (130, 131)]
    got = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    label = {r.node: r.root for r in got.collect()}
    assert len({label[k] for k in range(41)}) == 1 and len({label[k] for k in range(100, 130)}) == 1
    assert len({label[0], label[100], label[130]}) == 3
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def digest_rows(df):
    return [tuple(r) for r in df.selectExpr("doc_id", "n_bytes", "aggregate(spans, 0L, (n, s) -> n + s.stop - s.start) n", "size(spans) k", "sha2(kept, 256) h").collect()]


def test_suffix_removal_matches_brute_force(spark):
    docs = with_ids(spark)
    want = brute.remove_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(digest_rows(suffixes.remove_repeats(docs))) == sorted(want)


@pytest.mark.parametrize("frequent", [1, 3, 256])
def test_suffix_removal_over_many_packs_and_buckets(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT_PACKS", frequent)
    monkeypatch.setattr(suffixes, "PACK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    rows = [(k, texts.prose(k % 7, 50) + texts.prose(50 + k, 30) + "-" * (k * 9)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(digest_rows(suffixes.remove_repeats(docs))) == sorted(brute.remove_repeats(rows))


def test_contexts_of_frequent_tokens_stay_small():
    """A token that many packs have costs a few times its contexts, not one string for each place in them."""
    import pyarrow as pa
    import zstandard

    raw = [texts.prose(k, 60).encode() for k in range(40)]
    values, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    rest, sink = pa.table({"doc_id": pa.array(range(40), pa.int64())}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as w:
        w.write_table(rest)
    blobs = [zstandard.ZstdCompressor().compress(values.tobytes()), suffixes.squeeze(np.diff(at).astype(np.int32)), sink.getvalue().to_pybytes()]
    ones = b"\xff" * len(values)
    size = {}
    for often in (b"\0" * len(values), ones):
        bits = pa.array([[{"bucket": 0, "bits": ones, "often": often}]])
        batch = pa.record_batch([pa.array([1]), *[pa.array([x], pa.binary()) for x in blobs], bits], ["pack", "texts", "lens", "rest", "bits"])
        out = list(suffixes._contexts("doc_id", 100, 1, 1, [], 2)(iter([batch])))
        size[often] = sum(len(suffixes.unsqueeze(x, np.uint8, np.int32, np.int32, np.int64, np.int32)[0]) for b in out for x in b.column(2).to_pylist())
    assert 0 < size[ones] <= 2.5 * size[b"\0" * len(values)]


@pytest.mark.parametrize("ranges", [1, 3])
def test_suffix_removal_where_ranges_are_cut_by_a_hash(spark, monkeypatch, ranges):
    monkeypatch.setattr(suffixes, "MOST_RANGES", ranges)
    monkeypatch.setattr(suffixes, "PACK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1000)
    rows = [(k, texts.prose(k % 7, 50) + texts.prose(50 + k, 30) + "-" * (k * 9)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(digest_rows(suffixes.remove_repeats(docs))) == sorted(brute.remove_repeats(rows))


def test_suffix_removal_takes_null_ids_empty_tables_and_clashing_names(spark):
    got = suffixes.remove_repeats(texts.clashing(texts.edge_docs(spark)))
    assert got.count() == len(texts.edge_rows()) and got.where("doc_id is null").first().spans == []
    assert got.where("doc_id = 12 and size(spans) > 0").count() == 0  # rows of one id remove nothing from one another
    assert suffixes.remove_repeats(texts.empty_docs(spark)).count() == 0


def test_spans_of_whole_characters_leave_text(spark):
    a, b = "é" + "ü" * 60, "x" + "ü" * 60 + "ñ"
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    got = suffixes.remove_repeats(docs, 50, characters=True).where("doc_id = 2").first()
    assert bytes(got.kept).decode() == "xñ"


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 5000).astype(np.uint8)
    text[1000:3000] = text[:2000]
    words = np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))
    pos = np.arange(len(text) - 64)
    got = suffixes.multikey_quicksort(words, pos, 7, np.uint64(0xFFFF000000000000), small=64)
    keys = [text[p : p + 50].tobytes() for p in got]
    assert keys == sorted(keys) and sorted(got.tolist()) == pos.tolist()


def vector_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    out = [(k, [float(x) for x in base[k]], k % 3) for k in range(40)]
    out += [(100 + k, [float(x) for x in base[k] + rng.normal(size=16) * 0.08], k % 3) for k in range(40)]
    out += [(200 + k, out[3][1], 0) for k in range(5)]  # copies
    return out + [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None] + [0.0] * 14, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1), (305, out[0][1], None), (306, [1.0, 2.0], 1), (307, [], 1), (308, [2.0, 4.0], 1)]


def test_lattice_links_match_brute_force(spark):
    rows = vector_rows()
    got = lattice.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    want = brute.vector_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_lattice_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", 16)
    rng = np.random.default_rng(3)
    center = rng.normal(size=8)
    rows = [(k, [float(x) for x in center + rng.normal(size=8) * 0.15], 1) for k in range(150)]
    got = lattice.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), p=lattice.LatticeParams(tables=8, probes=6, scale=0.3))
    want = brute.vector_links([(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in rows])
    assert sum(r.n_links for r in got.collect()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got.collect())


@pytest.mark.parametrize("level", [0, 1, 2])
@pytest.mark.parametrize("dim", [64, 256])
def test_levels_meet_near_vectors_and_fewer_others(level, dim):
    p, rng = lattice.LEVELS[level][1], np.random.default_rng(level)
    a = lattice.unit(rng.normal(size=(1500, dim)))
    side = rng.normal(size=a.shape)
    side = lattice.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    near = 0.93 * a + np.sqrt(1 - 0.93**2) * side

    def meet(x, y):
        return ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1)

    one, two = lattice.cells(a, p), lattice.cells(near, p)
    others = np.mean([meet(one, np.roll(one, k, axis=0)).mean() for k in range(1, 40)])
    assert meet(one, two).mean() >= 0.99 and others < (0.03, 0.0003, 0.0003)[level]


@pytest.mark.parametrize("level", [1, 2])
def test_finer_levels_and_labels_of_any_type_match_brute_force(spark, monkeypatch, level):
    monkeypatch.setattr(lattice, "LEVELS", [(8, lattice.LatticeParams()), (1 << 62, lattice.LEVELS[level][1])])
    rows = vector_rows()
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("label", F.concat(F.lit("label "), "label"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(docs).collect()}
    want = brute.vector_links(rows)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want) and all(got[k][0] <= want[k][0] for k in want)


@pytest.mark.parametrize("tile", [1 << 17, 40, 13])
def test_lattice_finds_the_same_links_however_many_vectors_a_label_has(spark, monkeypatch, tile):
    """Vectors a good way above and below the threshold, in one tile, in an even and in an odd number of them; no setting hangs on the label's size."""
    monkeypatch.setattr(lattice, "TILE", tile)
    monkeypatch.setattr(lattice, "SMALL", 1 if tile < 100 else lattice.SMALL)
    monkeypatch.setattr(lattice, "LEVELS", [(8, lattice.LatticeParams()), (1 << 62, lattice.LatticeParams(1, 1, 9.0, 3))])
    rows = vector_rows() + [(400, [-0.0] + [1.0] * 15, 1), (401, [0.0] + [1.0] * 15, 1)]
    got = lattice.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute.vector_links(rows)


def test_links_of_a_pair_do_not_hang_on_the_vectors_beside_it(spark, monkeypatch, tmp_path):
    """Pairs so far apart that the cells find only some, alone and with 33,000 vectors of their label at right angles to them, in three tiles."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(lattice, "TILE", 1 << 14)
    rng = np.random.default_rng(25)
    a, side = lattice.unit(rng.normal(size=(300, 32))), rng.normal(size=(300, 32))
    side = lattice.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    pairs = np.concatenate([a, 0.75 * a + 0.66 * side])
    vectors = np.zeros((33600, 64), np.float32)
    vectors[:600, :32], vectors[600:, 32:] = pairs, rng.normal(size=(33000, 32))
    found = []
    for n in (600, len(vectors)):
        path = str(tmp_path / f"{n}.parquet")
        pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(vectors[:n]), "label": np.zeros(n, np.int32)}), path)
        got = lattice.near_duplicate_vectors(spark.read.parquet(path), threshold=0.7)
        found.append({r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.where("vec_id < 600").collect()})
    assert found[0] == found[1] and 0 < sum(n for n, _, _ in found[0].values()) < 600


def test_lattice_sends_a_vector_twice_in_a_round_at_most(spark):
    packed = spark.createDataFrame([(g, n, k) for g, n in enumerate((1, 2, 5, 6)) for k in range(n)], "grp bigint, tiles bigint, tile bigint")
    pairs = set()
    for step in range(4):
        sides = {}
        for r in lattice._round(packed, step).collect():
            sides.setdefault((r.grp, r.ti), {})[r.side] = r.tile
        met = [(g, *sorted((x[0], x.get(1, x[0])))) for (g, _), x in sides.items()]
        assert sum(len(x) for x in sides.values()) <= 2 * packed.count() and not pairs & {*met} and len(met) == len({*met})
        pairs |= {*met}
    assert pairs == {(g, i, j) for g, n in enumerate((1, 2, 5, 6)) for i in range(n) for j in range(i, n)}


def test_lattice_takes_empty_tables_and_null_ids(spark):
    schema = "vec_id bigint, embedding array<float>, label int, rep int, cell int"
    assert lattice.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    got = lattice.near_duplicate_vectors(spark.createDataFrame([(None, [1.0], 1, 0, 0), (1, [1.0], 1, 0, 0)], schema)).collect()
    assert sorted(((r.vec_id, r.n_links) for r in got), key=repr) == [(1, 0), (None, 0)]


def test_e8_points_are_nearest():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(500, 8)) * 2
    p = lattice.nearest_e8(y)
    far = ((y - p) ** 2).sum(axis=1)
    assert (far <= 1 + 1e-9).all()  # the covering radius
    assert all((((y - p - s) ** 2).sum(axis=1) >= far - 1e-9).all() for s in lattice.STEPS)


def jaccard_groups(rows, width=5, similarity=0.8):
    sets = [frozenset(simhash.shingle_digests((t or "").encode(), width)) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links.append((rows[i][0], rows[j][0]))
    return brute.components([i for i, _ in rows], links)


def test_similar_sets_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    base = texts.prose(7, 150).split()
    rows = [(k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(30)] + [(50 + k, texts.prose(300 + k, 60)) for k in range(20)]
    rows += [(80, None), (81, ""), (82, "one two"), (83, "one two")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == jaccard_groups(rows)


def test_near_copies_with_repeated_lines_are_found(spark):
    rows = []
    for k in range(12):
        body = " ".join(f"w{k}x{i}" for i in range(600))
        lines = [" ".join(f"l{k}y{j}z{i}" for i in range(10)) for j in range(2)]
        rows += [(10 * k, body), (10 * k + 1, body + (" " + lines[0]) * (50 + 13 * k)), (10 * k + 2, body + " " + lines[1] + (" " + lines[0]) * 200), (10 * k + 3, body + " " + lines[0] + (" " + lines[1]) * 200)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == jaccard_groups(rows)


def test_groups_of_every_path_match_brute_force(spark, monkeypatch):
    """Shards cut into tiles, components grown one by one, and large groups with sets near to their least node and far from it."""
    monkeypatch.setattr(neardup, "TILE", 5)
    monkeypatch.setattr(neardup, "TILE_ROWS", 16)
    monkeypatch.setattr(simhash, "GROW_ROWS", 4)
    rows = []
    for g in range(3):
        base = texts.prose(400 + g, 200).split()
        for k in range(40):  # each text differs from the one before it in a few words, so chains run far from their start
            base = base[:]
            for w in range(1 + g):
                base[(17 * k + 61 * w) % 200] = f"new{k}x{w}"
            rows.append((1000 * g + k, " ".join(base)))
    rows += [(5000 + k, texts.prose(900, 150).replace("alpha", f"v{k}", 1)) for k in range(60)] + [(6000 + k, texts.prose(950 + k, 60)) for k in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == jaccard_groups(rows)


def test_ids_that_repeat_lose_no_text(spark):
    a, b, c = texts.prose(21, 80), texts.prose(22, 80), texts.prose(23, 80)
    rows = [(5, a), (5, b), (2, b + " more"), (7, c), (7, c), (9, c + " "), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in neardup.one_of_each_group(docs).collect()) == [(2, b + " more"), (5, a), (7, c)]
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))  # ids of another type
    assert sorted(r.doc_id for r in neardup.one_of_each_group(named).collect()) == ["d2", "d5", "d7"]


def test_sketches_pass_similar_sets():
    rng = np.random.default_rng(5)
    tables, wrong = [], 0
    for n in [1, 2, 3, 5, 8, 20, 60, 200, 1000] * 60:
        one = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        keep = int(np.ceil(n * 8 / 9))  # with n - keep new ones the similarity is 0.8 or a little more
        other = np.concatenate([one[:keep], rng.integers(0, 1 << 63, n - keep, np.uint64)])
        tables += [np.unique(one), np.unique(other)]
    rows = spark_free_table(tables)
    q = np.arange(0, len(tables), 2)
    ok = neardup.plausible(0.8)(rows)(q, q + 1)
    for k, x in enumerate(q.tolist()):
        both = len(np.intersect1d(tables[x], tables[x + 1]))
        wrong += both >= 0.8 * (len(tables[x]) + len(tables[x + 1]) - both) and not ok[k]
    far = neardup.plausible(0.8)(rows)(q, np.roll(q, 2 * 9))  # unrelated sets of the same sizes
    assert wrong == 0 and not far[np.array([len(tables[x]) >= 60 for x in q])].any()


def spark_free_table(sets):
    import pyarrow as pa

    return pa.table({"n": [len(s) for s in sets], "sketch": pa.array([x.tobytes() for x in neardup.sketches(sets)], pa.binary())})


@pytest.mark.parametrize("most", [1, 3, 256])
def test_components_grow_to_the_same_as_all_pairs(most):
    rng = np.random.default_rng(most)
    for _ in range(40):
        n = int(rng.integers(1, 200))
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 8)), np.uint64)
        value = base[rng.integers(0, len(base), n)]
        for _ in range(int(rng.integers(0, 6))):
            value = value ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        tag = rng.integers(0, 3, n)
        also = lambda q, r: tag[q] == tag[r]  # noqa: B023, E731
        a, b = np.nonzero(np.triu((np.bitwise_count(value[:, None] ^ value[None, :]) <= 3) & (tag[:, None] == tag[None, :]), 1))
        want = bktree.label(n, a, b).tolist()
        for got in (bktree.components_large(value, 3, also, most), bktree.components_small(np.zeros(n, np.int64), value, 3, also)):
            assert bktree.label(n, np.arange(n), got).tolist() == want


def test_one_hot_shard_in_tiles_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 20)
    monkeypatch.setattr(simhash, "GROW_ROWS", 8)
    rng = np.random.default_rng(8)
    fps = sorted({int(sum(1 << int(b) for b in rng.choice(12, 4))) for _ in range(150)})  # all share their high bits
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    got = brute.components(fps, [(r.a, r.b) for r in links.collect()])
    assert got == brute.components(fps, [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3])


def test_one_of_each_group_stays(spark):
    docs = texts.clashing(texts.edge_docs(spark))
    got = neardup.one_of_each_group(docs)
    ids = [r.doc_id for r in got.collect()]
    want = {i for i, c in jaccard_groups([(r[0], r[1]) for r in texts.edge_rows() if r[0] is not None]).items() if i == c}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1 and got.columns == docs.columns
    assert neardup.one_of_each_group(texts.empty_docs(spark)).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("spark://a:7077", "/shared/")) == "/shared"
    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master, None))
