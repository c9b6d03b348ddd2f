"""Operators 11 to 13 against brute force, the libraries and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from ringfield.llm import bytebpe, crosstok, runs

SF = "/root/testdata/sf0.001"
import brute_align
import brute_runs

ODD = ["", None, " ", "  ", "a", "trail ", "trail  ", "  lead", "x▁y ok", "a  b", "a　 b", "日本 語 です", "<|endoftext|> <s> </s>", "é  z　 ﬁ", "\x00a \x01",
       "\r\n x \t y", "'s 're a's  's", "''s 'll 'LL'd", "é é  é", " ▁", "naïve … “q” – x", "word " * 4000, "x" * 20_000, " " * 5000, "a b c " * 30 + "a b d"]


def texts(seed: int, n: int, alphabet: list[str]) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def table(spark, values, ddl="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(values)), ddl)


# -- 11 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [ODD, texts(5, 2000, [*"ab' \n\t1!é 　日▁", "  ", " the", "<s>", "\r\n"])], ids=["odd", "random"])
def test_links_equal_brute_force(spark, values):
    found = {r[0]: tuple(r)[1:] for r in crosstok.linked_counts(table(spark, values).repartition(5), *crosstok.default_pair()).collect()}
    want = brute_align.answers(values)
    assert [found[k] for k in range(len(values))] == want
    assert sum(w[3] for w in want) and any(w[6] == "" for w in want)


def test_whole_table_and_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = dict(zip([k for k, _ in rows], brute_align.answers([t for _, t in rows]), strict=True))
    assert {r[0]: tuple(r)[1:] for r in crosstok.op11_token_alignment(spark, SF).collect()} == want
    for r in crosstok.align(docs, *crosstok.default_pair()).collect():
        parts, a, b = [], 0, 0
        for m, n in zip(r["a_ends"], r["b_ends"], strict=True):
            parts.append(",".join(map(str, r["a_ids"][a:m])) + "|" + ",".join(map(str, r["b_ids"][b:n])))
            a, b = m, n
        assert (a, b) == (len(r["a_ids"]), len(r["b_ids"])) == want[r["doc_id"]][:2]
        assert (hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "") == want[r["doc_id"]][6]


def test_pages_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pair = crosstok.default_pair()
    one = sorted(map(tuple, crosstok.linked_counts(docs, *pair).collect()))
    many = crosstok.linked_counts(docs.repartition(7, "doc_id"), *pair).collect()
    assert sorted(map(tuple, many)) == one


def test_alignment_of_odd_tables(spark):
    pair = crosstok.default_pair()
    rows = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 3), (8, None, 4)], "doc_id int, text string, page int")
    got = sorted(map(tuple, crosstok.linked_counts(rows, *pair).collect()), key=repr)
    assert [g[0] for g in got] == [7, 7, 8, None] and got[0] == got[1] and got[0][4] == 2 and got[0][6] == 6
    assert crosstok.linked_counts(rows.limit(0), *pair).count() == 0
    clash = rows.withColumn("a_ids", F.lit(1)).withColumn("bucket", F.lit(2))
    assert crosstok.align(clash, *pair).columns == ["doc_id", "text", "page", "bucket", "a_ids", "b_ids", "a_ends", "b_ends"]
    assert crosstok.align(clash.limit(0), *pair).count() == 0


# -- 12 --------------------------------------------------------------------------------------------


def library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same_as_library(rows, values):
    whole = library()
    got = {r["doc_id"]: r for r in rows}
    for k, t in values.items():
        assert np.frombuffer(bytes(got[k]["ids"]), "<u4").tolist() == whole.encode_ordinary(t or ""), repr(t)
        assert bytes(got[k]["decoded"]) == (t or "").encode()


def test_every_character_is_split_as_the_library_splits_it():
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    values = [f"a{c}a{c}1{c}!{c}  {c}" for c in chars if ord(c) < 0x2000] + [f"a{c}1" for c in chars[0x2000 :: 7]]
    b = np.frombuffer("".join(values).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(v.encode()) for v in values])])
    starts = bytebpe.pretoken_starts(b, offsets)
    pieces = [b[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(b)], strict=True)]
    ids = bytebpe.ranks_of(bytebpe.default_ranks()).encode(pieces)[1].tolist()
    whole = library()
    assert ids == [x for v in values for x in whole.encode_ordinary(v)]


def test_random_and_odd_texts(spark):
    values = dict(enumerate(ODD + texts(2, 3000, [*"ab'strevldmLL \n\t 1!é 　日\x85", "  ", "'s", "'re", "'ll", "\r\n"])))
    coded = bytebpe.encode(table(spark, list(values.values())).repartition(6), bytebpe.default_ranks())
    same_as_library(bytebpe.decode(coded, bytebpe.default_ranks()).collect(), values)


def test_bpe_query_on_the_whole_table(spark):
    whole = library()
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = whole.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert set(map(tuple, bytebpe.op12_byte_bpe(spark, SF).collect())) == want


def test_bpe_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, "a b", 1), ("x", "a b", 2), ("x", "a b", 3), ("y", None, 4)], "doc_id string, text string, page int")
    got = bytebpe.encode(rows, bytebpe.default_ranks())
    assert sorted((r["doc_id"] or "", len(r["ids"])) for r in got.collect()) == [("", 8), ("x", 8), ("x", 8), ("y", 0)]
    assert bytebpe.encode(rows.limit(0), bytebpe.default_ranks()).count() == 0
    none = bytebpe.decode(got.select("doc_id", F.when(F.col("doc_id") == "x", F.col("ids")).alias("ids"), F.lit(1).alias("decoded__")), bytebpe.default_ranks())
    assert sorted((r["doc_id"] or "", r["decoded"]) for r in none.collect()) == [("", None), ("x", b"a b"), ("x", b"a b"), ("y", None)]


def test_codes_round_trip():
    from ringfield.llm.pages import squeezed_codes, unsqueezed_codes

    for most in (1, 253, 254, 65_536, 196_607, 196_608, 1 << 20):
        codes = np.random.default_rng(0).integers(0, most, 5000)
        codes[0] = most - 1
        assert (unsqueezed_codes(squeezed_codes(codes)) == codes).all()
    assert len(unsqueezed_codes(squeezed_codes(np.zeros(0, np.int64)))) == 0


# -- 13 --------------------------------------------------------------------------------------------


def test_runs_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(250):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            k, d = rnd.choice([1, 2, 3, 30]), []
            for _ in range(rnd.randint(0, 5)):
                piece = [rnd.randrange(k) for _ in range(rnd.randint(1, 9))]
                d += (piece * rnd.randint(1, 12))[: rnd.randint(1, 90)]
            docs.append(d)
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = runs.find_runs(np.array([x for d in docs for x in d], np.int64), at)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(s + int(o), n, q) for d, o in zip(docs, at, strict=False) for s, n, q in brute_runs.runs(d)]


def test_runs_of_long_repeats():
    one = np.zeros(60_000, np.int64)  # a single word; a Fibonacci word, which has squares everywhere
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    got = runs.find_runs(one, np.array([0, len(one)]))
    assert [x.tolist() for x in got] == [[0], [60_000], [1]]
    got = runs.find_runs(np.array(b), np.array([0, len(b)]))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute_runs.runs(b)


def test_runs_query_on_the_whole_table(spark):
    want = sorted((brute_runs.answer(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=repr)
    got = sorted(map(tuple, runs.op13_word_runs(spark, SF).collect()), key=repr)
    assert got == want and sum(w[1] for w in want) > 10


def test_runs_of_odd_tables(spark):
    values = [*ODD, "the the " * 20, "x y " * 30, "a\x0bb\x1cc " * 30]
    rows = spark.createDataFrame([(k, t, k, "z") for k, t in enumerate(values)] + [(None, values[-2], 0, "z")] * 2, "doc_id long, text string, runs int, COLLAPSED string").repartition(3)
    found = runs.collapse_runs(rows).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "runs", "collapsed"} and len(found) == len(values) + 2
    for r in found:
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in r["text"] or "").split(" ") if x]
        want = brute_runs.runs(w) if len(w) < 300 else [tuple(x) for x in r["runs"]]
        assert [tuple(x) for x in r["runs"]] == want
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in dropped)
    assert runs.collapse_runs(rows.limit(0)).count() == 0
