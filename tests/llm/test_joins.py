"""N-gram Jaccard join, mixing, sharding, URL rules: brute force and odd inputs."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfield.llm import blend, shard, simjoin, urlrules

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = {}, {}
    for k, (i, text) in enumerate(rows):
        sets[k], parent[k] = shingles(text), k

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in sets:
        groups[find(k)].append(rows[k][0])
    return sorted((rows[k][0], len(sets[k]), min(groups[find(k)])) for k in sets)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    common = " ".join(word() for _ in range(30))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 7, 12, 60, 200]))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = word()
            rows.append((" ".join(own) + (" " + common if g % 3 == 0 else "")).upper() if rng.random() < 0.2 else " ".join(own) + (" " + common if g % 3 == 0 else ""))
    rows += [None, "", " \t\n", "one", "one", "One", "a b c d", "a b c d e", common, "x " * 500, "x " * 700, "é ü " * 40, "\x00 \x00 b c d e f"]
    return [(k * 3, t) for k, t in enumerate(rows)]


def test_similar_documents_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine")).repartition(5)
    got = sorted(tuple(r)[:2] + (r.component_id,) for r in simjoin.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    want = brute_components(rows)
    # Empty documents link with nothing, not even with each other.
    assert got == want


def test_keys_meet_and_sketches_bound():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(3, 2000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: len(a) - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        i = len(np.intersect1d(a, b))
        if 100 * i < 75 * (len(a) + len(b) - i):
            continue
        often = np.sort(rng.choice(simjoin.parity_words(a, simjoin.levels_of(len(a))[0]), n // 3 + 1))
        for frequent in (np.zeros(0, np.uint64), often):
            assert np.intersect1d(simjoin.probe_keys(a, frequent), simjoin.probe_keys(b, frequent)).size
        x, y = simjoin.bit_sketch(a), simjoin.bit_sketch(b)
        x, y = (v if len(v) == min(len(x), len(y)) else v[: len(v) // 2] ^ v[len(v) // 2 :] for v in (x, y))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_large_buckets_are_judged_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BUCKET", 4)
    rows = corpus() + [(1000 + k, "p q r s t u v w x y z aa bb cc dd ee ff gg hh ii " + f"k{k} l{k % 5}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simjoin.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_near_copies_give_pairs_in_proportion(spark, monkeypatch):
    """A group of 400 near copies, keys of which are dealt over tasks, and rounds with pairs that prove wrong."""
    monkeypatch.setattr(simjoin, "HOT_KEY", 64)
    monkeypatch.setattr(simjoin, "SPARSE", 1)
    monkeypatch.setattr(simjoin, "GROWTH", (1,))
    rng = random.Random(11)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for k in range(400):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            own[rng.randrange(70)] = f"e{k}x{rng.randrange(1000)}"
        rows.append((k, " ".join(own)))
    given = []
    plain = simjoin.candidates

    def counted(*args):
        found = plain(*args)
        given.append(found.count())
        return found

    monkeypatch.setattr(simjoin, "candidates", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in simjoin.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    assert len(given) > 1 and max(given) < 40 * len(rows)


def test_null_ids_link_like_others(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(None, a), (7, a + " a30"), (None, b), (None, b + " b30"), (3, None), (None, "")]
    got = simjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted([(None, 26, 7), (7, 27, 7), (None, 26, None), (None, 27, None), (3, 0, 3), (None, 0, None)], key=repr)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert simjoin.similar_documents(none).count() == 0
    assert blend.plan_copies(none).count() == 0
    assert shard.shard_minimax(none, 3).count() == 0


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in sizes if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(w[s] for s in left) if left else 0
        over = {s for s in left if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * w[s] for s in sizes}
        capped |= over


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 40))) or None, rng.choice(["b", "a", "é", None, "Z", "zz"]), k) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = blend.plan_copies(docs).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_hand(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.25 * want[s] for s in sizes)
    assert sorted(map(tuple, blend.plan_copies(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert blend.mix_sources(docs).count() == sum(r.copies for r in got)


def test_mix_against_sql(spark, duck):
    from helpers import same_rows

    same_rows(blend.op2_source_mix(spark, SF), duck, blend.OP2_SQL)


@pytest.mark.parametrize("shards", [1, 2, 5])
@pytest.mark.parametrize("window", [200_000, 3])
def test_shards_are_minimax(spark, monkeypatch, shards, window):
    monkeypatch.setattr(shard, "WINDOW_ENDS", window)
    rng = random.Random(shards)
    texts = ["t" * rng.randint(0, 60) + str(rng.randint(0, 20)) for _ in range(60)] + ["hot" * 20] * 30 + [None, None, "", ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = shard.shard_minimax(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    by = {r.doc_id: r for r in got}
    assert len(by) == len(rows)
    group = defaultdict(list)
    for k, t in rows:
        r = by[k]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        group[t].append(k)
    assert all(len({by[k].shard for k in g}) == 1 for g in group.values())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # Groups in the operator's order, and the best capacity by dynamic programming.
    import hashlib

    order = sorted(group, key=lambda t: b"" if t is None else hashlib.sha256(t.encode()).digest())
    size = [sum(by[k]["size"] for k in group[t]) for t in order]
    best = [sum(size[: j + 1]) for j in range(len(size))]
    for _ in range(shards - 1):
        best = [min(max(best[i], sum(size[i + 1 : j + 1])) for i in range(j + 1)) for j in range(len(size))]
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) == best[-1]


URLS = [None, "", "no scheme/x", "HTTP://WWW.Example.ORG/es/1?q", "https://example.org/en/12#x", "https://a.b.example.org/en/2", "https://org/x", "https://xorg/x", "https://c.com/fr/1", "https://com/de/", "https://c.com", "://example.org/es/", "https://example.org:80/es/", "https://example.org?x", "x://..org/", "https://" + "a." * 300 + "example.org/es/" + "y" * 5000]


def test_url_rules(spark, duck):
    from helpers import same_rows

    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(urlrules.RULES), "host string, path string, verdict string")

    def fit(host, path):
        best = [(len(h + p), len(h), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(best)[2:] if best else (None, "allow")

    for r in urlrules.match_rules(pages, rules).collect():
        u = URLS[r.page_id % len(URLS)] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path) and (r.rule, r.verdict) == fit(host, path)
    assert urlrules.match_rules(pages, rules.limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
    assert urlrules.match_rules(pages.limit(0), rules).count() == 0
    same_rows(urlrules.op7_url_rules(spark, SF), duck, urlrules.OP7_SQL)


def test_many_nested_rules(spark):
    rng = random.Random(2)
    rules = list({(".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    urls = [(k, "h://" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))) for k in range(400)]
    got = urlrules.match_rules(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")).collect()
    for r in got:
        fits = [(len(h + p), len(h)) for (h, p), _ in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (len(r.rule) if r.rule else None) == (max(fits)[0] if fits else None)


def test_one_of_each_component_stays_where_ids_are_repeated_or_null(spark):
    """Rows, not ids, are kept and dropped: a clean text under the id of a copy stays, and copies with one id or none go."""
    a, b, c, d, e = (" ".join(f"{t}{k}" for k in range(40)) for t in "abcde")
    near = b + " b40"
    rows = [(1, a, 0), (2, a, 0), (2, c, 0), (5, d, 0), (5, d, 0), (5, d, 0), (None, e, 0), (None, e, 0), (None, b, 0), (7, near, 0), (7, None, 0), (None, None, 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in simjoin.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, a), (2, c), (5, d), (None, e), (7, near), (7, None), (None, None), (None, "")], key=repr)
    assert simjoin.keep_one(docs).columns == docs.columns


def test_a_round_of_refused_pairs_does_not_end_the_search(spark, monkeypatch, tmp_path):
    """Rounds fed by hand: the second gives only a pair that was refused before, the third the one that links."""
    ddl = "m long, a long, b long, more boolean"
    fed = [[(1, 10, 20, True)], [(1, 10, 20, True)], [(1, 10, 20, False), (1, 10, 30, False)]]
    asked, asked_most = [], []
    monkeypatch.setattr(simjoin, "candidates", lambda *a: (asked_most.append(a[5]), spark.createDataFrame(fed[len(asked_most) - 1], ddl))[1])
    monkeypatch.setattr(simjoin, "texts_of", lambda each, *rest: each)
    none = spark.createDataFrame([], "class long")
    search = simjoin._Links(none, none, 0, str(tmp_path))
    search.add = lambda each, texts: asked.extend(sorted(map(tuple, each.select("a", "b").collect())))
    search.across = lambda pairs: pairs
    search.join_up(spark.createDataFrame([(1,)], "row long"))
    assert asked == [(10, 20), (10, 30)] and len(asked_most) == 3


def test_texts_with_some_shingles_in_common_hardly_share_keys():
    """Sets of hashes from one pool, a few of which any two have in common by chance: single ones must not make buckets."""
    rng, none = np.random.default_rng(5), np.zeros(0, np.uint64)
    pool = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
    keys = [np.unique(simjoin.probe_keys(np.unique(rng.choice(pool, int(rng.integers(100, 700)), replace=False)), none)) for _ in range(300)]
    times = np.unique(np.concatenate(keys), return_counts=True)[1]
    assert times[times > 1].sum() < sum(map(len, keys)) / 10


@pytest.mark.parametrize("most", [7, 1 << 17])
def test_components_of_many_tasks_and_of_one(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(simjoin, "EDGES", most)
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(60, 100)] + [(500, 200), (200, 300), (-5, 500)] + [(rng.randrange(1000, 1060), rng.randrange(1060, 1100)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = simjoin.components(spark.createDataFrame(edges, "a long, b long").repartition(5), str(tmp_path))
    assert sorted(map(tuple, found.select("node", "root").collect())) == sorted(root.items())
    none = simjoin.components(spark.createDataFrame([], "a long, b long"), str(tmp_path))
    assert none.count() == 0
