"""Alignment of two tokenizers by definition, to test against."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer


def both(texts: list[str | None]):
    """Ids and byte ends of either tokenizer for each text; None where a text has no tokens."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    char = {chr(c): c for c in plain}
    for k, c in enumerate(c for c in range(256) if c not in plain):
        char[chr(256 + k)] = c
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        whole = (" " + t).encode()
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        p = [bytes(char[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        out.append((x, p, y, q) if b"".join(p) == whole == b"".join(q) else None)
    return out


def ends(parts: list[bytes]) -> list[int]:
    out, at = [], 0
    for p in parts:
        out.append(at := at + len(p))
    return out


def answers(texts: list[str | None]) -> list[tuple]:
    rows, count = [], Counter()
    for got in both(texts):
        if got is None:
            rows.append(None)
            continue
        x, p, y, q = got
        e, f = ends(p), ends(q)
        links, j0 = [], 0
        for i in range(len(x)):
            while f[j0] <= e[i] - len(p[i]):
                j0 += 1
            j = j0
            while j < len(y) and f[j] - len(q[j]) < e[i]:
                links.append((x[i], y[j]))
                j += 1
        groups, at, bt = [], 0, 0
        for cut in sorted(set(e) & set(f)):
            m, n = e.index(cut) + 1, f.index(cut) + 1
            groups.append(",".join(map(str, x[at:m])) + "|" + ",".join(map(str, y[bt:n])))
            at, bt = m, n
        count.update(links)
        rows.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], r[2], len(r[3]), sum(count[k] == best[k[1]] for k in r[3]), sum(count[k] for k in r[3]), r[4]) for r in rows]
