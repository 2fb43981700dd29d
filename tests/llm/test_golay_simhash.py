from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from quillon.llm import golay_simhash as g

from .helpers import awkward, empty


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, ids):
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for k, x in enumerate(ids):
        if x is not None:
            least[root(k)] = min(x, least.get(root(k), x))
    return [least.get(root(k)) for k in range(len(prints))]


def unsigned(x):
    return x & (1 << 64) - 1


def compare(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    expected = sorted(zip([r[0] for r in rows], prints, brute_components(prints, [r[0] for r in rows]), strict=True), key=repr)
    got = sorted([(r["doc_id"], unsigned(r["fp"]), r["component_id"]) for r in g.group(docs).collect()], key=repr)
    assert got == expected


def test_awkward_rows(spark):
    compare(spark, awkward(spark))


def test_documents(spark):
    compare(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_golay_code_is_perfect_and_keys_survive_errors():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    index, n = g.golay_keys(words)
    assert set(np.unique(n)) <= {1, 6}
    for errors in (1, 2):
        places = np.array([rng.choice(23, errors, replace=False) for _ in words])
        other = words ^ np.bitwise_or.reduce(np.uint32(1) << places.astype(np.uint32), axis=1)
        jndex, m = g.golay_keys(other)
        for a, x, b, y in zip(index, n, jndex, m, strict=True):
            sa, sb = set(a[:x].tolist()), set(b[:y].tolist())
            assert sa & sb
            if errors == 1:
                assert a[0] in sb or b[0] in sa


@pytest.mark.parametrize("block", [4096, 30])
def test_links_of_all_patterns_are_found(spark, block):
    """Random fingerprints with copies at 0 to 6 differing bits, in any segment: components equal those of all pairs."""
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    out = set(base.tolist())
    for x in base.tolist():
        for bits in range(1, 7):
            for _ in range(6):
                y = x
                for p in rng.choice(64, bits, replace=False):
                    y ^= 1 << int(p)
                out.add(y)
    prints = sorted(out)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    links = [(unsigned(r["a"]), unsigned(r["b"])) for r in g.links(df, block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    index = {x: k for k, x in enumerate(prints)}
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        label[root(index[a])] = root(index[b])
    expected = brute_components(prints, list(range(len(prints))))
    found = {}
    for k in range(len(prints)):
        found.setdefault(root(k), set()).add(k)
    wanted = {}
    for k, c in enumerate(expected):
        wanted.setdefault(c, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_every_case_of_four_bits_has_a_common_key():
    """All splits (a, b, c) of up to 4 bits over the segments, many times: some key is shared, and not by two probes only."""
    rng = np.random.default_rng(5)
    for a in range(5):
        for b in range(5 - a):
            for c in range(5 - a - b):
                one = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
                other = one.copy()
                for size, shift, n in ((23, 0, a), (23, 23, b), (18, 46, c)):
                    places = np.array([rng.choice(size, n, replace=False) for _ in one]).reshape(len(one), n).astype(np.uint64)
                    for k in range(n):
                        other ^= np.uint64(1) << (places[:, k] + np.uint64(shift))
                sets = []
                for prints in (one, other):
                    rows, keys = g.keys_of(prints)
                    found = [{} for _ in prints]
                    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
                        found[r][k >> 1] = found[r].get(k >> 1, 1) & (k & 1)
                    sets.append(found)
                for x, y in zip(*sets, strict=True):
                    assert any(not (x[k] and y[k]) for k in x.keys() & y.keys()), (a, b, c)


def test_keys_of_random_fingerprints_are_small():
    """A million random fingerprints: few candidates for each, and no large key."""
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 1_000_000, dtype=np.uint64) ^ (rng.integers(0, 2, 1_000_000, dtype=np.uint64) << np.uint64(63))
    some = prints[:20_000]
    keys = np.sort(np.concatenate([g.keys_of(prints[k : k + 50_000])[1][::1] >> np.uint64(1) for k in range(0, 200_000, 50_000)]))
    own = g.keys_of(some)[1] >> np.uint64(1)
    met = np.searchsorted(keys, own, "right") - np.searchsorted(keys, own, "left") - 1
    assert met.max() < 100
    assert met.sum() / len(some) < 5  # candidates per fingerprint among 200,000


@pytest.mark.parametrize("spread", [0, 100])
def test_large_keys_lose_no_link(spark, monkeypatch, spread):
    """A dense group whose keys are large, spread beforehand or met as they come, in short stretches."""
    monkeypatch.setattr(g, "STRETCH", 50)
    monkeypatch.setattr(g, "SAMPLE", 2)
    monkeypatch.setattr(g, "SPREAD", spread)
    rng = np.random.default_rng(7)
    prints = sorted({int(0x0123456789ABCDEF) ^ int(sum(1 << int(k) for k in rng.choice(12, n, replace=False)) << 46) for n in range(5) for _ in range(60)} | set(rng.integers(0, 1 << 62, 50).tolist()))
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    from quillon.llm.components import components

    roots = {r["node"]: r["root"] for r in components(g.links(df, 20)).collect()}
    assert [roots.get(x, x) for x in prints] == [brute_components(prints, prints)[k] for k in range(len(prints))]


def test_chain_is_one_component(spark):
    chain = [sum(1 << b for b in range(4 * k)) for k in range(16)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in chain], "fp long")
    from quillon.llm.components import components

    assert len({r["root"] for r in components(g.links(df)).collect()}) == 1


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = g.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in g.group(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)


def test_null_and_repeated_ids_lose_no_group(spark):
    """Different texts under null or one id each stay; a null id's copy of a text that has an id goes."""
    text = [" ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "eta", "zeta")) for k in range(9)]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (5, text[3]), (5, text[4]), (5, text[4]), (None, text[3]), (7, text[5]), (3, text[5]), (3, text[6]), (None, None)]
    kept = g.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(None, text[0]), (None, text[1]), (None, text[2]), (5, text[3]), (5, text[4]), (3, text[5]), (3, text[6]), (None, None)]
    assert sorted(map(tuple, kept), key=repr) == sorted(wanted, key=repr)


def test_empty_table(spark):
    assert g.group(empty(spark)).count() == 0
    assert g.keep_one(empty(spark)).count() == 0
