import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import encode, leaks, neighbours, pieces, residue
from canopy.llm.arrow import words

DOC = "doc_id bigint, text string, ids string"


def test_words():
    assert words("Ab-c_d 1é́x ²№ 日本。z") == ["ab", "c", "d", "1é", "x", "日本", "z"]


def test_round_trip(spark):
    texts = ["", None, "plain text", "日本語 🙂‍💻 naïve\r\n\x00", "<|endoftext|> x", "a" * 50_000, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = encode.encode(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[0] == [] and got[1] == [] and 50256 not in got[4] and len(got) == len(texts)
    assert {r.doc_id: r.text for r in encode.decode(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}
    spans = {r.doc_id: r for r in encode.encode(df, offsets=True).collect()}
    assert spans[2].starts[0] == 0 and spans[2].ends[-1] == len(texts[2]) and spans[3].ids == got[3]
    assert encode.encode(df.limit(0)).count() == 0
    assert encode.decode(spark.createDataFrame([(1, None), (2, [10, 999_999, None])], "doc_id bigint, ids array<int>")).collect()[0].text is None


def brute(docs, items):
    runs = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - leaks.RUN + 1):
            runs.setdefault(tuple(w[k : k + leaks.RUN]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t or "")] for k in range(len(w) - leaks.RUN + 1) for i in runs.get(tuple(w[k : k + leaks.RUN]), ())}


def test_leaks(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(40)) for i in range(12)] + [(12, None), (13, ""), (14, "short one"), (15, text(12))]
    items += [(16, items[0][1])]
    docs = [(i, text(100)) for i in range(20)]
    for k, n in enumerate([11, 12, 13, 40]):
        docs.append((100 + k, text(20) + " -- " + "; ".join(items[k][1].upper().split()[:n]) + " " + text(5)))
    docs += [(200, None), (201, ""), (202, items[15][1]), (202, items[15][1]), (203, items[0][1] + " " + items[1][1])]
    a, b = spark.createDataFrame([(*d, "x") for d in docs], DOC), spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks.leaks(a, b).collect()
    assert {tuple(r) for r in found} == brute(docs, items) and len(found) == len({tuple(r) for r in found})
    assert leaks.leaks(a.limit(0), b).count() == 0 and leaks.leaks(a, b.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab \n\r{};é\U0001f642"), max_size=400), st.integers(20, 80))
def test_spans(text, limit):
    overlap = limit // 5
    got = pieces.spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(a < c <= b and c > a for (a, b), (c, _) in zip(got, got[1:]))


def test_natural_boundaries():
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 20 + "\n" for i in range(100))
    got = pieces.spans(text)
    assert all(text[b - 1] == "\n" for _, b in got) and all(text[a - 1] == "\n" for a, _ in got[1:])
    assert all(text[b:].startswith("def") for _, b in got[:-1]) and all(300 <= b - c <= 600 for (_, b), (c, _) in zip(got, got[1:]))
    assert pieces.spans("x" * 13_000) == [(0, 6000), (5700, 11_700), (11_400, 13_000)]
    with pytest.raises(ValueError):
        pieces.spans("x", 10, 10)


def test_pieces(spark):
    rows = [(1, "x" * 6001), (2, "x" * 6000), (3, None), (4, ""), (5, "é\n" * 4000), (1, "y" * 6001)]
    df = spark.createDataFrame(rows, "snippet_id bigint, source_code string").withColumn("piece", pieces.F.lit("clash"))
    got = pieces.pieces(df).collect()
    assert {r.snippet_id for r in got} == {1, 5} and all(len(r.text) <= 6000 and len(r.text) == r.stop - r.start for r in got)
    assert pieces.pieces(df.limit(0)).count() == 0


def test_rotation_and_packing():
    x = np.random.default_rng(0).normal(size=(50, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = neighbours.rotate(x, 5)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-5)
    assert np.abs(neighbours.unpack(neighbours.pack(x), 64) @ x.T - x @ x.T).max() < 1e-3
    first, second, gap = neighbours.signed_axes(y.copy(), 0, 64)
    assert (first != second).all() and (gap >= 0).all() and (first == 2 * np.abs(y).argmax(1) + (y[np.arange(50), np.abs(y).argmax(1)] < 0)).all()


VEC = "cache_id bigint, embedding array<float>, id string"


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.25 * rng.normal(size=(rng.integers(2, 30), 32)) for c in centres]).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1)[:, :10]
    truth = {(min(i, j), max(i, j)) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.8}
    rows = [(i, (v * (i % 3 + 1)).tolist(), "x") for i, v in enumerate(x)]
    bad = [(9000, None, "x"), (9001, [], "x"), (9002, [0.0] * 32, "x"), (9003, [float("nan")] * 32, "x"), (9004, [1.0] * 31, "x"), (None, [1.0] * 32, "x"), (9005, [float("inf")] + [1.0] * 31, "x")]
    df = spark.createDataFrame(rows + bad, VEC)
    assert {tuple(r) for r in neighbours.nearest_pairs(df, dim=32).collect()} == truth  # one bucket: exact
    for options in ({"per_bucket": 60}, {"tables": 2, "probes": 2, "per_bucket": 60}):
        got = {tuple(r) for r in neighbours.nearest_pairs(df, dim=32, **options).collect()}
        assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got), options
        assert all(b < 9000 and a < b for a, b in got)
    deep = {tuple(r) for r in neighbours.nearest_pairs(df, dim=32, per_bucket=500, most=40, tables=4).collect()}  # buckets divided by further codes
    assert all(s[a, b] >= 0.7999 for a, b in deep) and len(deep & truth) >= 0.8 * len(truth)
    assert neighbours.nearest_pairs(df.limit(0), dim=32).count() == 0


def test_no_pair_is_left_out(spark, monkeypatch):
    """More rows than a bucket of the hashing takes, without clear groups: every pair is found, and ties go to the smaller key."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.75 * rng.normal(size=(12, 64)) for c in rng.normal(size=(280, 64))]).astype(np.float32)
    x[-4:] = 0  # two and two with equal cosines to a third
    x[-5], x[-4, :2], x[-3, :2], x[-2, :2], x[-1, :2] = 0, (4, 3), (4, -3), (3, 4), (5, 0)
    x[-5, 0], x = 1, np.concatenate([x, [[9.0] * 64]]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -2)
    truth = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:3] if s[i, j] >= 0.6}
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], VEC).repartition(3)
    found = lambda: {(r.a, r.b) for r in neighbours.nearest(df, dim=64, k=3, least=0.6).collect()}
    assert len(truth) > 3000 and found() == truth
    monkeypatch.setattr(neighbours, "axes", lambda x, least: np.eye(64, dtype=np.float32)[:, :8])  # hardly any bound
    assert found() == truth


def test_copies(spark):
    rows = [(i, [1.0, float(i // 20)] + [0.0] * 30, "x") for i in range(60)] + [(100 + i, [1.0, 0.1 * (i // 2), 0.05] + [0.0] * 29, "x") for i in range(6)]
    got = {tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, VEC), dim=32).select("a", "b").collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, ids = np.round(x @ x.T, 12), [r[0] for r in rows]
    want = {(a, ids[j]) for i, a in enumerate(ids) for j in sorted((j for j in range(len(ids)) if j != i and c[i, j] >= 0.8), key=lambda j: (-c[i, j], ids[j]))[:10]}
    assert got == want


def test_a_third_of_all_vectors_in_one_neighbourhood(spark):
    rng = np.random.default_rng(3)
    dense = rng.normal(size=32) + 0.2 * rng.normal(size=(600, 32))
    x = np.concatenate([dense, rng.normal(size=(1200, 32))]).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    truth = {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.8}
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], VEC)
    got = {tuple(r) for r in neighbours.nearest_pairs(df, dim=32, per_bucket=300, most=250).collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    same = spark.createDataFrame([(i, (dense[0] + 1e-4 * rng.normal(size=32)).tolist(), "x") for i in range(90)], VEC)  # no code divides them
    assert all(n >= 10 for _, n in neighbours.nearest(same, dim=32, per_bucket=500, most=20).groupBy("a").count().collect())


RESIDUE = [
    "404 Not Found\nThe requested page could not be found on this server.", "# Title here\n\nHome | Docs | Search\n\nInternal Server Error\n\nTraceback has been sent to the administrators. Incident f5e0fe7f.", "Please enable JavaScript to view this page.", "<html><head><title>503 Service Unavailable</title></head><body><h1>503 Service Unavailable</h1></body></html>", "Hello {{name}}, thank you for your report about {{team}}.\n# {{project_name}}\nTwo classes inherit from the grammar.",
    "## Steps\n[list the steps]\n\n## Environment\n<!-- version, platform -->", "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor.", "Your text goes here. Replace this paragraph with a description.", "TBD", "Seite nicht gefunden. Der angeforderte Artikel wurde verschoben oder gelöscht.", '{"status": 404, "message": "document not available"}', "Steps to reproduce:\n1. XXXX\n2. XXXX\n\n# XXXX",
]
CONTENT = [
    'The viewer shows "Please enable JavaScript" when scripts are off. It confused two testers. We changed the text of it.', "A missing node makes the endpoint answer 404 Not Found, and `f` turns that into an empty list.", "Run `export HOME=${HOME}/x` and call `f\"{name}\"` to see the set. Then read the file twice.", "The template uses `[INSERT author HERE]` and `{{x}}`; the renderer replaces both before writing.", "Explain in one paragraph what happens here: The parser reads a file and stores one node.", "# Title\n\n```python\nx = {a}\nraise Error('404')\n```", "The demo page used lorem ipsum dolor text until this release; it now shows a real pool.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert residue.is_seed(*residue.judge(text))


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not residue.is_seed(*residue.judge(text))


def test_residue_rows(spark):
    near = "The docs server did not answer because the shard that holds this page is being moved to another rack and the mirror of it was not reachable at the time of the call either so nothing can be shown for now"
    texts = [*RESIDUE, *CONTENT, None, "", " \n ", RESIDUE[0], "Error 502: Bad gateway. " + near, "Error 502: Bad gateway! " + near]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "TBD", "x"), (0, texts[0], "x")], DOC)
    got = [r.doc_id for r in residue.residue(df).collect()]
    n = len(RESIDUE)
    assert sorted(got) == [*range(n), len(texts) - 3, len(texts) - 2, len(texts) - 1]
    assert residue.residue(df.limit(0)).count() == 0


def test_near_links(spark):
    rng = np.random.default_rng(5)
    base = [(i, int(v)) for i, v in enumerate(rng.integers(-(2**62), 2**62, 300))]
    flipped = lambda n: [(1000 + i, v ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False))) for i, v in base]
    schema = "node bigint, sim bigint"
    for bits, least in ((4, 300), (10, 280), (40, 0)):
        got = {tuple(r) for r in residue.near_links(spark.createDataFrame(base, schema), spark.createDataFrame(flipped(bits), schema), 300).collect()}
        met = len(got & {(i, 1000 + i) for i in range(300)})
        assert met >= least and (bits < 40 or not met)


def test_residue_spreads_through_passages(spark):
    """Units that no pattern knows: equal to seeds once masked, or near-copies of long ones."""
    long = "we could not reach the shard that holds what was asked for because it is being moved to another rack and its mirror in the second hall did not answer any of the calls that were made to it within the time that is allowed for that"
    seeds = [f"Fixes {{a{i}}} in {{b}}.\n\nReleased on {{c}} as version {{d}}." for i in range(3)] + [f"Error 502: {long} now."]
    texts = [*seeds, "Fixes «author» in «step one».\n\nReleased on «day» as version «x y».", f"Note that {long} today.", "Fixes the parser in «step one». It reads the file twice. Then the cache is written."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    assert sorted(r.doc_id for r in residue.residue(df, spread=False).collect()) == [0, 1, 2, 3]
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == [0, 1, 2, 3, 4, 5]


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id bigint")
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)], "a bigint, b bigint")
    assert {r.id: r.part for r in residue.components(nodes, links).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
