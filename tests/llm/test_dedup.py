"""SimHash groups against all pairs; exact fingerprints against plain Python."""

import hashlib
import random

import pytest
import xxhash

from arborspark.llm import common, fingerprints, mixing, simhash_dedup


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = dict.fromkeys(prints)
    for p in label:
        label[p] = p
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.fixture(scope="module")
def near(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(120)]
        for copy in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(copy):
                t[r.randrange(len(t))] = "edit"
            rows.append((1000 - k, " ".join(t)))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    label = plain_components([plain_print(t) for _, t in rows])
    first = {}
    for i, t in rows:
        root = label[plain_print(t)]
        if i is not None:
            first[root] = min(i, first.get(root, i))
    want = sorted(((i, f"{plain_print(t):016x}", first.get(label[plain_print(t)])) for i, t in rows), key=repr)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_groups(df).collect()), key=repr)
    assert got == want


def test_groups_equal_all_pairs(near):
    check(near)


def test_groups_of_odd_rows(docs, none):
    check(docs)
    assert simhash_dedup.near_groups(none).count() == 0


def test_hot_shards_are_dealt_again(near, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TREE_ENTRIES", 2)
    check(near)


def test_dense_clusters_are_dealt_to_the_last_level(spark, monkeypatch):
    """Many different fingerprints that agree on most bits: links equal those of all pairs."""
    r = random.Random(12)
    base = r.getrandbits(63)
    points = list({base ^ r.getrandbits(11) for _ in range(400)} | {base ^ (r.getrandbits(20) << 40) for _ in range(60)})
    monkeypatch.setattr(simhash_dedup, "TREE_ENTRIES", 40)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for x in simhash_dedup.links(df).collect():
        a, b = top(x["a"]), top(x["b"])
        root[max(a, b)] = min(a, b)
    assert {p: top(p) for p in points} == plain_components(points)


def test_deduplicate_and_mix_with_clashing_columns(docs):
    for f, names in ((simhash_dedup.deduplicate, ["row_key", "__key", "fp", "root"]), (mixing.mix, ["mix_source", "mix_source_size", "mix_target", "mix_copy", "size"])):
        df = docs.selectExpr("*", *[f"'{n}' as `{n}`" for n in names], "1 as `a.b`")
        got = f(df)
        assert got.columns == df.columns
        rows = got.collect()
        assert rows and all(r[n] == n for r in rows for n in names)


def test_work_tables_need_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert common.shared_dir(spark)


def test_tree_finds_all_within_the_radius():
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    values = list({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(6)})
    t = simhash_dedup.BKTree()
    for v in values:
        t.add(v)
    for q in values[:80]:
        assert {t.values[k] for k in t.within(q)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_one_row_of_each_group_stays(docs, near):
    kept = simhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert ids == [-1, 1, 2, 6, 7, 8, 9]
    assert simhash_dedup.deduplicate(near).count() == len({r["component_id"] for r in simhash_dedup.near_groups(near).collect()})


def test_rows_without_any_id_keep_one(spark):
    df = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (1, "other words stand here")], "doc_id long, text string")
    assert simhash_dedup.deduplicate(df).count() == 2


def test_one_id_on_unrelated_texts_keeps_each(spark):
    a, b = ("".join(f" {w}{k}" for k in range(40)) for w in "ab")
    for first, second in ((a, b), (b, a)):
        df = spark.createDataFrame([(3, first), (5, first), (5, second), (5, second)], "doc_id long, text string")
        assert sorted(map(tuple, simhash_dedup.deduplicate(df).collect())) == [(3, first), (5, second)]


def test_edited_texts_follow_the_ids(docs, none):
    got = fingerprints.fingerprint_documents(docs, per_range=3).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[k - 1][1]  # rows ascend; the next in descending order is the one before
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        c, ce, ca = (fingerprints.canonical(x) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(c), fingerprints.digest(ce), float(c == ce), float(c == ca)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fingerprints.fingerprint_documents(none).count() == 0


def plain_chain(rows):
    """(id, text, next text) by ascending id, null first, then XXH64 of the text; the first is followed by the last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64(r[1].encode(), 42).intdigest() - (1 << 64) * (xxhash.xxh64(r[1].encode(), 42).intdigest() >> 63)))
    return [(i, t, order[k - 1][1]) for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("ids", ["distinct", "none", "one", "mixed"])
def test_many_ranges_give_the_same_rows(spark, ids):
    r = random.Random(4)
    pick = {"distinct": lambda k: k * 7 % 1009, "none": lambda k: None, "one": lambda k: 5, "mixed": lambda k: r.choice([None, 9, 9, k])}[ids]
    rows = [(pick(k), " ".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = []
    for i, t, after in plain_chain(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        c, ce, ca = (fingerprints.canonical(x) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(c), fingerprints.digest(ce), float(c == ce), float(c == ca)))
    for per_range in (10, 1 << 14):
        got = fingerprints.fingerprint_documents(df, per_range=per_range).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_canonical_form():
    same = ["Ｇröße  x", "größe x", "GRÖSSE X ", "grösse\tx"]
    assert len({fingerprints.canonical(t) for t in same}) == 1


def test_different_bytes_under_one_digest_are_told_apart(spark, docs, monkeypatch):
    real = fingerprints.digest
    monkeypatch.setattr(fingerprints, "digest", lambda c: "0" * 32 if len(c) < 60 else real(c))
    df = docs.where("doc_id in (1, 5, 7, 9)")
    rows = fingerprints.fingerprint_documents(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[1] == by[5] and len(by[1] | by[7] | by[9]) == 3
