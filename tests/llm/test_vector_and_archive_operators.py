import hashlib
from collections import Counter

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (900, None, 1, "x"), (901, [nan, 1.0, 0.0, 0.0], 1, "x"), (902, [0.1, None, 0.0, 0.0], 1, "x"), (903, [inf, 0.0, 0.0, 0.0], 1, "x"),
        (904, [0.0, 0.0, 0.0, 0.0], 1, "x"), (905, [1.0, 0.0], 1, "x"), (906, [1.0, 0.0, 0.0, 0.0], 1, "x"), (907, [1.0, 0.0, 0.0, 0.0], None, "x"), (908, [-0.0, 1.0, 0.0, 0.0], 2, "x"), (909, [0.0, 1.0, 0.0, 0.0], 2, "x"),
    ]


def sample(seed, n, dims=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] * rng.uniform(0.5, 3) + rng.normal(0, 0.12, dims)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), "x"))
    return out + [(n, out[0][1], out[0][2], "x"), (n + 1, out[0][1], out[0][2], "x")]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("tile,block", [(16, 3), (4096, 2048)])
def test_topk_matches_brute_force(spark, tile, block):
    from tarn.llm import topk

    data = sample(1, 240) + odd_vectors()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.search(spark.createDataFrame(data, VECTORS), tile=tile, block=block)))
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v, _, _ in data if usable(v)}
    want = []
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_topk_few_and_huge(spark):
    from tarn.llm import topk

    few = spark.createDataFrame([(0, [1e20, 1.0], 1, "x"), (7, [1.0, -1.0], 1, "x")], VECTORS)
    (r,) = rows(topk.search(few))
    a, b = ([int(np.floor(256.0 * float(np.float32(x)))) for x in v] for v in ([1e20, 1.0], [1.0, -1.0]))
    assert (r["query_id"], r["rank"], r["vec_id"]) == (0, 1, 7)
    assert r["score"] == min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))
    assert rows(topk.search(spark.createDataFrame([], VECTORS))) == []


def test_topk_of_the_largest_doubles(spark):
    from tarn.llm import topk

    data = [(0, [1.7e308, -0.3], 1, "x"), (50, [-1.0, 2.0], 1, "x"), (7, [1e300, 5e-324], 1, "x"), (8, [-1.7e308, 1.0], 1, "x"), (9, [0.5, 0.25], 1, "x")]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(topk.search(spark.createDataFrame(data, VECTORS.replace("float", "double"))))}

    def whole(x):
        n, d = x.as_integer_ratio()
        return 256 * n // d

    ints = {i: [whole(x) for x in v] for i, v, _, _ in data}
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
        assert {got[q, k + 1][1] for k in range(4)} == {hold(-s) for s, _ in want}
        assert sorted(got[q, k + 1][0] for k in range(4)) == sorted(i for _, i in want)
    assert len(got) == 8


@pytest.mark.parametrize("tile", [16, 2048])
def test_embedding_dedup_matches_brute_force(spark, tile):
    from tarn.llm import embed_dedup

    data = sample(2, 300) + odd_vectors()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(embed_dedup.dedup(spark.createDataFrame(data, VECTORS), tile=tile))}
    ok = [(i, np.pad(np.array(v, float), (0, 4 - len(v))), lab) for i, v, lab, _ in data if usable(v) and lab is not None and any(v)]
    parent, n = {i: i for i, _, _, _ in data}, dict.fromkeys((i for i, _, _, _ in data), 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, u, la) in enumerate(ok):
        for b, v, lb in ok[k + 1 :]:
            if la == lb and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sum(n.values()) > 200
    assert got == {i: (n[i], root(i), root(i) == i) for i in parent}
    assert rows(embed_dedup.dedup(spark.createDataFrame([], VECTORS))) == []


def test_topk_large_components_stay_exact(spark):
    from tarn.llm import topk

    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=20) * (10.0 ** rng.integers(0, 9))], 1, "x") for i in range(120)]
    data += [(200, [1e200] + [0.0] * 19, 1, "x"), (250, [-1e200] + [1.0] * 19, 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(topk.search(df, tile=50, block=2))}
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v, _, _ in data}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 50, 100, 200, 250):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        assert [got[q, k + 1][1] for k in range(5)] == [clip(-s) for s, _ in scored]
        if all(abs(s) < 2**63 for s, _ in scored):
            assert [got[q, k + 1][0] for k in range(5)] == [i for _, i in scored]


def test_embedding_dedup_compares_rows_without_an_id_or_sharing_one(spark):
    from tarn.llm import embed_dedup

    data = [
        (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.001], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 2), (None, [0.0, -1.0], 1),
        (None, None, 1), (2**60 + 1, [0.0, 3.0], 2), (2**60 + 3, None, None), (None, [0.0, -2.0], 1),
    ]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(embed_dedup.dedup(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))))
    want = [(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (7, 1, 7, True), (2**60 + 1, 1, 7, False)]
    assert got == Counter(want + [(None, 1, None, True)] * 2 + [(None, 0, None, True), (2**60 + 3, 0, 2**60 + 3, True)])


def test_quantised_bound_holds():
    from tarn.llm.embed_dedup import product, quantise

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, kept, lost = quantise(x)
    near = product(q, q) * s[:, None] * s[None, :]
    assert (np.abs(near - x @ x.T) <= kept[:, None] * lost[None, :] + lost[:, None] + 1e-12).all()


def test_components_match_union_find(spark):
    from tarn.llm.components import components

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    got = {r["id"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {k: v for k, v in got.items()} == {k: root(k) for k in parent if root(k) != k} | {k: v for k, v in got.items() if v == k}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


PAGES = "page_id long, url string, html string, payload_bytes int"


def test_warc_round_trip(spark):
    from tarn.llm import warc

    big = "é" * 5000
    data = [(i, f"http://x/{i}", f"<p>{'x' * 150}{i % 7}</p>", 1) for i in range(60)]
    data += [(100, None, None, 1), (101, "u\r\nX-Bad: 1", "", 1), (102, "u", "short", 1), (103, "u", "short", 1), (104, "u", big, 1), (99, "u", big, 1), (None, "u", big, 1), (99, "u", big, 1)]
    got = rows(warc.round_trip(spark.createDataFrame(data, PAGES), roll=2000))
    assert len(got) == len(data)
    first = {}
    for i, _, h, _ in data:
        p = (h or "").encode()
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    seen = []
    for r in got:
        p = next((h or "").encode() for i, _, h, _ in data if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), hashlib.sha256(p).hexdigest())
        if r["page_id"] is None or len(p) < 100:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        elif r["page_id"] == first[p]:
            seen.append((r["page_id"], r["record_type"]))
        else:
            assert (r["record_type"], r["refers_to"]) == ("revisit", first[p])
    assert sum(t == "response" for i, t in seen if i == 99) == 1
    assert all(t == "response" for i, t in seen if i != 99)
    assert rows(warc.round_trip(spark.createDataFrame([], PAGES))) == []


def test_warc_survives_split_ranges(spark):
    """Ranges whose rows several tasks read must not write over each other's files."""
    from tarn.llm import warc

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    data = [(i, "u", "".join(chr(97 + (i * k) % 26) for k in range(3000)), 1) for i in range(700)]
    conf.set("parquet.block.size", "20000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        got = rows(warc.round_trip(spark.createDataFrame(data, PAGES), roll=5000))
    finally:
        conf.unset("parquet.block.size")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h, _ in data}
    assert len(got) == len(data) and {r["page_id"]: r["payload_digest"] for r in got} == want


def test_warc_is_deterministic(spark):
    from tarn.llm import warc
    from tarn.llm.common import scratch_path

    df = spark.createDataFrame([(i, "u", "y" * (i * 37 % 400), 1) for i in range(50)], PAGES)
    one, two = (sorted((r["records"], r["sha256"]) for r in rows(warc.write(df.repartition(k), scratch_path(spark, "w"), roll=1500))) for k in (2, 5))
    assert one == two and sum(n for n, _ in one) == 50


def test_warc_leaves_no_temporary_files_and_replaces_earlier_attempts(spark, tmp_path):
    from tarn.llm import warc

    root = str(tmp_path / "archive")
    df = spark.createDataFrame([(i, "u", "y" * (i * 37 % 400), 1) for i in range(50)], PAGES)
    one = sorted(tuple(r) for r in warc.write(df, root, roll=1500).collect())
    two = sorted(tuple(r) for r in warc.write(df, root, roll=1500).collect())
    assert one == two and sorted(p.name for p in (tmp_path / "archive").iterdir()) == [r[0] for r in one]


def test_vectors_and_pages_with_clashing_names(spark):
    from pyspark.sql import functions as F

    from tarn.llm import embed_dedup, topk, warc

    df = spark.createDataFrame(sample(3, 60), VECTORS)
    wide = df.select("*", *(F.lit(7).alias(c) for c in ("v", "h", "h2", "_row", "t", "b", "i", "j", "n", "c", "id", "least", "asks", "score", "rank", "query_id", "n_links", "component_id", "kept")))
    for call in (topk.search, embed_dedup.dedup):
        assert sorted(map(tuple, call(df).collect())) == sorted(map(tuple, call(wide).collect()))
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 120 + str(i % 3), 1) for i in range(20)], PAGES)
    wide = pages.select("*", *(F.lit(7).alias(c) for c in ("digest", "first", "kind", "place", "revisit", "n", "record_type", "refers_to", "file")))
    assert sorted(map(str, warc.round_trip(pages).collect())) == sorted(map(str, warc.round_trip(wide).collect()))
