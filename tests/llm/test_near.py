import numpy as np

from corvellum.llm import near

WORDS = [f"w{i}" for i in range(400)]
PLANS = {"chunk": near.CHUNK, "title": near.TITLE}
SCHEMA = "kind string, key string, text string, cls string, bands string"


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 600).astype(np.uint64)
    a, b = x[:400], x[200:]
    ra, rb, rab = (near.registers(s, 512) for s in (a, b, x))
    assert (np.maximum(ra, rb) == rab).all()
    assert abs(near.joint_estimate(ra, rb, 400, 400) - 1 / 3) < 0.08
    assert near.joint_estimate(ra, ra, 400, 400) == 1


def records(spark):
    base = WORDS[:100]
    edited = [*base[:50], "x", *base[51:]]
    moved = [*base[50:], *base[:50]]
    rows = [("chunk", "a", " ".join(base)), ("chunk", "b", " ".join(edited)), ("chunk", "c", " ".join(moved)), ("chunk", "d", " ".join(base).upper() + "!"), ("chunk", "e", " ".join(WORDS[200:300])),
            ("chunk", "a", " ".join(base)), ("chunk", "n", None), ("chunk", None, "q r s t"), ("chunk", "s", "two words"), ("chunk", "z", ""), ("title", "a", "A  Title of things "), ("title", "b", "a title of Things"), ("title", "c", None), ("other", "x", "a b c d")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_pairs_copies_and_edges(spark):
    found = {tuple(r) for r in near.NearDuplicates(records(spark), PLANS).pairs().collect()}
    assert found == {("chunk", *p) for p in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"))} | {("title", "a", "b")}


def test_membership_has_one_row_a_record(spark):
    rows = near.NearDuplicates(records(spark), PLANS).membership().collect()
    chunk = {r.item_key: r for r in rows if r.item_kind == "chunk"}
    assert set(chunk) == {"a", "b", "c", "d", "e"} and len(rows) == 7
    assert chunk["a"].class_id == chunk["d"].class_id and chunk["a"].n_copies == 2 and chunk["a"].n_links == 2 and chunk["e"].n_links == 0


def test_empty_table(spark):
    assert near.NearDuplicates(spark.createDataFrame([], SCHEMA), PLANS).pairs().count() == 0


def test_all_pairs_against_brute_force(spark, tables):
    found = {tuple(r) for r in near.p2_found(spark, tables).collect()}
    want = set()
    for kind, plan in PLANS.items():
        rows = {(r.key, r.text) for r in near.library_records(spark, tables).collect() if r.kind == kind and r.text}
        keys = [k for k, _ in rows]
        sets = [set(s.tolist()) for s in near.shingle_sets([t for _, t in rows], plan)]
        want |= {(kind, *sorted((keys[i], keys[j]))) for i in range(len(keys)) for j in range(i) if keys[i] != keys[j] and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert found == want and want


def joined(pairs):
    """Each key with the least key it is connected with."""
    root = {k: k for p in pairs for k in p}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {k: top(k) for k in root}


def test_components(spark):
    rng = np.random.default_rng(2)
    ids = [int(x) for x in rng.permutation(np.arange(-300, 300))]
    edges = [*zip(ids[:150], ids[1:150]), *zip(ids[200:260], [*ids[201:260], ids[200]]), *((ids[300], x) for x in ids[301:400]), *((ids[400 + int(a)], ids[400 + int(b)]) for a, b in rng.integers(0, 200, (120, 2)))]
    df = spark.createDataFrame(edges, "cls_a bigint, cls_b bigint")
    got = [tuple(r) for r in near.components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == joined([e for e in edges if e[0] != e[1]])
    assert near.components(df.where("false")).count() == 0


def test_groups_join_edited_copies(spark):
    """A chain of edits is one group, though its ends are no pair; so are copies, and what one key holds."""
    chain = [("chunk", f"k{i}", " ".join(WORDS[12 * i : 12 * i + 100])) for i in range(9)]
    rows = [*chain, ("chunk", "copy", chain[4][2].upper()), ("chunk", "far", "one two three four five"), ("chunk", "k0", "some other text of this key"), ("chunk", "twin", "Some other text of this key!"), ("title", "k0", "A title")]
    data = near.NearDuplicates(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), PLANS)
    group = {}
    for r in data.membership().collect():
        group.setdefault((r.item_kind, r.item_key), set()).add(r.group_id)
    assert all(len(x) == 1 for x in group.values())
    one = group["chunk", "k0"]
    assert {k for k, x in group.items() if x == one} == {("chunk", k) for k in ("copy", "twin", *(f"k{i}" for i in range(9)))}
    assert ("chunk", "k0", "k8") not in {tuple(r) for r in data.pairs().collect()}


def test_groups_connect_all_pairs(spark, tables):
    want = joined([((r.item_kind, r.key_a), (r.item_kind, r.key_b)) for r in near.p2_found(spark, tables).collect()])
    rows = near.p2_groups(spark, tables).collect()
    by_want, by_got = {}, {}
    for r in rows:
        key = (r.item_kind, r.item_key)
        by_want.setdefault(want.get(key, key), set()).add(key)
        by_got.setdefault(r.group_id, set()).add(key)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values())) and len(by_got) < len(rows)
