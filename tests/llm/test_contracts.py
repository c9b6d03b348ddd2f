"""The registered queries themselves against plain computations of what they promise, over whole tables."""

import zlib

import numpy as np
from conftest import SF

from ringfield.llm import chatformat, tokenfiles
from ringfield.llm.queries import QUERIES


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_chat_query(spark, duck):
    got = QUERIES["op5_chat_windows"](spark, SF)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    want = sorted(duck.execute(chatformat.OP5_PARTS_SQL).fetchall())
    rows = got.collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == want and any(r.conv_id == -7 for r in rows)
    windows = chatformat.format_windows(spark.read.parquet(f"{SF}/conversations.parquet")).groupBy("conv_id").agg({"text": "count"})
    assert {r.conv_id for r in windows.collect()} == {r.conv_id for r in rows} - {-7}
    assert all(r.formatted_chars >= r.loss_chars for r in rows)


def test_token_file_query(spark):
    docs = documents(spark)
    rows = sorted(QUERIES["op8_token_files"](spark, SF).collect())
    encode = tokenfiles.Encoder(tokenfiles.default_tokenizer()).tokenizer.encode
    assert [r.doc_id for r in rows] == sorted(docs)
    at = 0
    for r in rows:
        ids = [*encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def fits(sizes, limit, shards):
    """Whether groups of these sizes, in this order, go into so many shards of at most ``limit``."""
    used, free = 0, -1
    for s in sizes:
        if s > limit:
            return False
        if s > free:
            used, free = used + 1, limit
        free -= s
    return used <= shards


def test_sharding_query(spark):
    docs = documents(spark)
    rows = QUERIES["op9_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    groups, load, slots = {}, [0] * 8, {k: [] for k in range(8)}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        groups.setdefault(docs[r.doc_id], set()).add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in groups.values())  # equal texts stay together
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(sum(r.size for r in rows if docs[r.doc_id] == t) for t in groups)
    assert max(load) <= sum(load) / 8 + largest


def test_sharding_query_is_minimax(spark):
    """No smaller capacity holds the groups in the order that the shards give them."""
    docs = documents(spark)
    rows = sorted(QUERIES["op9_sharding"](spark, SF).collect(), key=lambda r: (r.shard, r.slot))
    sizes, last = [], object()
    for r in rows:
        text = docs[r.doc_id]
        if text == last:
            sizes[-1] += r.size
        else:
            sizes.append(r.size)
        last = text
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert fits(sizes, max(load.values()), 8) and not fits(sizes, max(load.values()) - 1, 8)
