import numpy as np
import pytest
from rows import docs

from glyphmill.llm import blocks
from glyphmill.llm.blocks import forest, meeting, summed


def opened():
    def keys(b):  # a local function goes to the workers by value
        row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths())
        return row, b.column(1).flatten().to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, 64)

    return keys


def trees(n, edges):
    root = list(range(n))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [x if v == y else v for v in root]
    return root


def sketches(seed, groups, n):
    r = np.random.default_rng(seed)
    base = r.integers(1, 256, (groups, 64)).astype(np.uint8)
    out = base[np.arange(n) % groups].copy()
    for _ in range(4):
        out[np.arange(n), r.integers(0, 64, n)] = r.integers(1, 256, n)
    return out


def test_forest_connects_what_is_similar():
    assert len(set(trees(40, forest(sketches(3, 4, 40), 0.5)))) == 4


def test_summed():
    links, root = summed(6, np.array([0, 1, 4]), np.array([1, 2, 5]), np.array([1, 1, 3, 1, 1, 2]))
    assert links.tolist() == [1, 4, 1, 0, 2, 1] and root.tolist() == [0, 0, 0, 3, 4, 4]


@pytest.mark.parametrize("groups", [1, 50, 3000])
def test_one_key_for_all(spark, monkeypatch, groups):
    """A key that all items share, with few and with many unlike items: blocks stay small, and like ones are found."""
    n = 6000
    held = []
    own = blocks.forest
    monkeypatch.setattr(blocks, "BLOCK", 256)
    monkeypatch.setattr(blocks, "forest", lambda sketch, share: held.append(len(sketch)) or own(sketch, share))
    s = sketches(5, groups, n)
    rows = [(i, [7, -i], bytearray(s[i].tobytes())) for i in range(n)]
    batch = 400
    import pyarrow as pa

    def run(it, fn):
        return [r for b in fn(iter(it)) for r in b.to_pylist()]

    # without Spark: the levels one after another
    it = [pa.RecordBatch.from_pylist([{"sid": i, "keys": k, "sketch": bytes(x)} for i, k, x in rows[a : a + batch]], pa.schema([("sid", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])) for a in range(0, n, batch)]
    nodes = run(it, lambda i: blocks.before_shuffle(i, opened(), 0.5))
    todo = [(r["key"], r["sid"], s[r["sid"]]) for r in nodes]
    edges, level = [], 0
    while todo:
        todo.sort(key=lambda r: (r[0], r[1]))
        it = [pa.RecordBatch.from_pylist([{"key": k, "sid": i, "sketch": x.tobytes()} for k, i, x in todo[a : a + batch]], pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary())])) for a in range(0, len(todo), batch)]
        out = run(it, lambda i: blocks.link(i, 64, 0.5, level == 4))
        edges += [(r["a"], r["b"]) for r in out if r["b"] is not None]
        todo = [(hash((r["key"], i, r["sketch"][2 * i : 2 * i + 2])), r["a"], s[r["a"]]) for r in out if r["b"] is None for i in range(8 * level, 8 * level + 8)]
        level += 1
    root = trees(n, edges)
    of = {}
    for i in range(n):
        of.setdefault(i % groups, set()).add(root[i])
    assert sum(len(v) == 1 for v in of.values()) >= 0.99 * groups
    assert len({root[i] for i in range(n)}) >= 0.99 * groups
    assert max(held) <= 2 * 256


def test_meeting_with_a_hot_key(spark):
    n, groups = 6000, 40
    s = sketches(9, groups, n)
    df = spark.createDataFrame([(i, [1, 100 + i % groups], bytearray(s[i].tobytes())) for i in range(n)], "sid long, keys array<long>, sketch binary")
    comp = {r.node: r.comp for r in meeting(df, opened(), df.select("sid", "sketch"), 64, 0.5).collect()}
    assert len(comp) == n and all(comp[i] == i % groups for i in range(n))


def chain():
    """Sketches of three items: the second is similar to both others, which are unlike."""
    s = np.random.default_rng(2).integers(1, 256, (3, 64)).astype(np.uint8)
    s[1, :32], s[1, 32:] = s[0, :32], s[2, 32:]
    return s


def test_an_item_whose_like_has_its_key_goes_on(spark):
    s = chain()
    # the first two in one batch, the third, similar to the second only, in another
    df = spark.createDataFrame([(i, [7], bytearray(s[i].tobytes())) for i in range(3)], "sid long, keys array<long>, sketch binary").repartitionByRange(2, "sid")
    parts = df.rdd.glom().map(lambda p: [r.sid for r in p]).collect()
    assert sorted(map(len, parts)) == [1, 2]
    comp = {r.node: r.comp for r in meeting(df, opened(), df.select("sid", "sketch"), 64, 0.5).collect()}
    assert comp == {0: 0, 1: 0, 2: 0}


def test_whole_connects_across_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 6)
    s = np.random.default_rng(4).integers(1, 256, (40, 64)).astype(np.uint8)
    s[31, :32], s[31, 32:] = s[2, :32], s[17, 32:]
    assert sorted({tuple(sorted(e)) for e in blocks.whole(s, 0.5)}) == [(2, 31), (17, 31)]


def lonely(n, pairs):
    """Unlike sketches, but for pairs that agree in every other byte only."""
    s = np.random.default_rng(6).integers(1, 256, (n, 64)).astype(np.uint8)
    for x, y in pairs:
        s[y, ::2] = s[x, ::2]
    return s


def pairs_found(spark, n, pairs, **more):
    s = lonely(n, pairs)
    df = spark.createDataFrame([(i, [7], bytearray(s[i].tobytes())) for i in range(n)], "sid long, keys array<long>, sketch binary")
    return sorted((r.comp, r.node) for r in meeting(df, opened(), df.select("sid", "sketch"), 64, 0.5, **more).collect() if r.comp != r.node)


def test_a_key_of_any_size_gives_the_same_links(spark):
    """The same pairs are found under a key of 300 items and of 4,500, by one task and by pairs of tiles."""
    few = [(3, 299), (5, 150)]
    assert pairs_found(spark, 300, few) == few
    many = [(3, 4400), (5, 150), (2500, 2600)]
    assert pairs_found(spark, 4500, many) == many
    assert pairs_found(spark, 300, few, most=40, tile=50) == few
