"""Byte-level BPE, tokenizer alignment and vector codes against plain implementations."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm import byte_bpe, queries, token_alignment, vector_codes

DOCS = "doc_id long, text string, ids string, keys long, chunk string, groups string, id long, raw string"
RANKS = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}


def texts():
    rng = random.Random(5)
    alphabets = ("ab", "etaoinshr ", "0123 ", "<>=!-", "éñ中文 a", " \n\t\r", "Ab'sdtl ", "▁ a", "\x00\x85\xa0 　 x", "🙂👍🏽é")
    out = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 7, 40, 127, 128, 129, 600)]
    out += [" ".join(rng.choice(("don't", "the", "straße", "naïve", "x" * 9, "2024", "<|endoftext|>", "<s>", "</s>", "<0x41>")) for _ in range(80)) for _ in range(20)]
    out += ["", None, "same text", "same text", "a" * 40_000, "=-" * 3_000, "中" * 5_000, "word " * 20_000]
    return out


def documents(spark):
    rows = [(i, t, "clash", 7, "c", "g", 1, "r") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", "", 0, "", "", 0, "")], DOCS), [t for _, t, *_ in rows] + [rows[3][1], "no id"]


def test_byte_bpe_is_the_library(spark):
    df, want = documents(spark)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=TABLE, special_tokens={})
    ids = byte_bpe.encode(df, RANKS, P.PATTERN)
    assert ids.columns == ["doc_id", "ids"]
    got = byte_bpe.decode(ids, RANKS, P.PATTERN).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.raw)) for r in got)) == sorted(
        (i is None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip([*range(len(want) - 2), 3, None], want)
    )
    assert byte_bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    bad = spark.createDataFrame([(1, [50256]), (2, [-1]), (3, [None, 5]), (4, None), (5, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.raw for r in byte_bpe.decode(bad, RANKS, P.PATTERN).collect()} == {1: None, 2: None, 3: None, 4: None, 5: b""}


def test_ties_and_lower_ranks_of_new_pairs():
    """A made table in which a merge can make a pair of lower rank; long and short pieces agree."""
    rng = random.Random(6)
    made = {bytes([b]): b for b in range(256)}
    for n in range(256, 420):
        while (t := bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 7)))) in made:
            pass
        made[t] = n
        if len(made) >= 256 + 110:
            break
    bpe = byte_bpe.ByteBpe(made, r"(?s).+")
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=made, special_tokens={})
    for n in [*range(1, 40), 200, 300]:
        for _ in range(15):
            t = "".join(rng.choice("ab") for _ in range(n))
            assert bpe.encode([t])[0].tolist() == library.encode_ordinary(t)
            tokens = bpe.byte_ids[np.frombuffer(t.encode(), np.uint8)]
            assert t.encode() in made or bpe.merge_long(tokens).tolist() == library.encode_ordinary(t)


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    by_id = {i: t for t, i in TABLE.items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, docs = [], Counter()
    for text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(by_id[i] for i in x) != b"".join(map(piece, y)) or (text and b"".join(map(piece, y)) != b" " + text.encode()):
            x, y = [], []
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(x):
            group = ([], [])
            while not group[0] or at_a != at_b:
                if at_a <= at_b and (at_a < at_b or not group[0]):
                    at_a += len(by_id[x[i]])
                    group[0].append(x[i])
                    i += 1
                else:
                    at_b += len(piece(y[j]))
                    group[1].append(y[j])
                    j += 1
            groups.append(group)
        links = Counter()
        for g in groups:
            for p, m in Counter(g[0]).items():
                for q, n in Counter(g[1]).items():
                    links[p, q] += m * n
        docs.update(links.keys())
        out.append((x, y, groups, links))
    top = Counter()
    for (p, _), n in docs.items():
        top[p] = max(top[p], n)
    for x, y, groups, links in out:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(m for k, m in links.items() if docs[k] == top[k[0]])
        yield len(x), len(y), len(groups), sum(links.values()), text, best, sum(m * docs[k] for k, m in links.items())


@pytest.mark.parametrize("small", [False, True])
def test_alignment_is_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(token_alignment, "TOGETHER", 50)
        monkeypatch.setattr(token_alignment, "EXPANDED", 3)
        aligner = token_alignment.Aligner(open(P.path("byte_bpe_50k.json")).read(), open(P.path("piece_bpe_32k.model"), "rb").read())
        some = [t for t in texts() if len(t or "") < 200]
        want = [w[:5] for w in brute_alignment(some)]
        assert [r[:5] for part in token_alignment._runs(some) for r in aligner.align(part)] == want
        return
    df, rows = documents(spark)
    with open(P.path("piece_bpe_32k.model"), "rb") as b, open(P.path("byte_bpe_50k.json")) as a:
        aligned = token_alignment.align(df, a.read(), b.read())
    assert token_alignment.with_link_counts(aligned.limit(0), 32_000).count() == 0
    got = token_alignment.with_link_counts(aligned, 32_000).select("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()
    want = list(brute_alignment(rows))
    assert Counter(map(tuple, got)) == Counter(want) and sum(w[0] > 0 for w in want) > 50 and any(w[0] == 0 for w, t in zip(want, rows) if t)


def test_pointer_jumping_on_long_chains():
    """Cuts that share only their last byte make one chain over all tokens."""
    a, b = np.append(np.arange(2, 10_000, 2), 10_001), np.append(np.arange(1, 10_000, 2), 10_001)
    la, lb = token_alignment.group_labels(a, b)
    assert not la.any() and not lb.any()
    rng = np.random.default_rng(2)
    a, b = (np.append(np.unique(rng.integers(1, 500, n)), 500) for n in (200, 90))
    la, lb = token_alignment.group_labels(a, b)
    cuts = np.intersect1d(a, b)
    assert la.tolist() == np.searchsorted(cuts, a).tolist() and lb.tolist() == np.searchsorted(cuts, b).tolist()


def nearest_by_scan(entries, x):
    gap = x[:, None, :].astype(np.int64) - entries[None, :, :].astype(np.int64)
    every = (gap * gap).sum(axis=2)
    return every.argmin(axis=1), every.min(axis=1)


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(1)
    for n, width, high in ((256, 16, 300), (256, 3, 4), (70, 5, 1 << 24), (1, 2, 9), (64, 1, 50), (129, 0, 5)):
        entries, x = rng.integers(-high, high, (n, width)), rng.integers(-high, high, (500, width))
        x[:20] = entries[rng.integers(0, n, 20)]
        entry, distance = vector_codes.Slices(entries).nearest(x)
        want, least = nearest_by_scan(entries, x)
        assert entry.tolist() == want.tolist() and distance.tolist() == least.tolist()


def brute_codes(rows, width):
    """(id, code, error) in order and the books, one row at a time."""
    x = {i: [int(np.floor(1024 * c)) for c in v] for i, v in rows}
    cut = [(width * p // 4, width * (p + 1) // 4) for p in range(4)]
    books = [[x[i][a:b] for i in sorted(x)[:256]] for a, b in cut]
    near = lambda part, book: min((sum((s - t) ** 2 for s, t in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p, (a, b) in enumerate(cut):
            held = {}
            for v in x.values():
                held.setdefault(near(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    final = {i: [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)] for i, v in x.items()}
    return {i: ([k for _, k in f], sum(d for d, _ in f)) for i, f in final.items()}, books


def test_vector_codes(spark):
    rng = random.Random(8)
    schema = "vec_id long, embedding array<float>, label int, code string, error long, id int, v int, _row int, _label string, n int"
    rows = [(3 * i, [rng.choice((-1.0, 0.5, 2.25, rng.gauss(0, 1))) for _ in range(10)], rng.choice((1, 2, None))) for i in range(400)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(30)]
    odd = [(5, None, 1), (8, [1.0] * 9 + [None], 1), (11, [float("nan")] + [0.0] * 9, 2), (14, [0.0] * 9 + [float("-inf")], None)]
    clash = ("x", 1, 2, 3, 4, "y", 5)
    coded, books = vector_codes.vector_codes(spark.createDataFrame([r + clash for r in rows + odd + [(5000, [1.0, 2.0], 9)]], schema))
    got = {r.vec_id: r for r in coded.collect()}
    want, want_books = brute_codes([(i, np.float32(v).astype(float)) for i, v, _ in rows], 10)
    assert [b.tolist() for b in books] == want_books
    assert set(got) == {i for i, _, _ in rows} | {5000} and got[5000].code is None and got[5000].error is None
    by_label = Counter()
    for i, _, label in rows:
        assert (got[i].code, got[i].error) == want[i]
        by_label[label] += want[i][1]
    assert all(got[i].label_error == by_label[label] for i, _, label in rows)
    empty, none = vector_codes.vector_codes(spark.createDataFrame([r + clash for r in odd], schema))
    assert empty.count() == 0 and vector_codes.digest(none) == hashlib.sha256(b"").hexdigest()
    few = [(4, [1e30, -1e30] * 4, None), (4, [1e30, -1e30] * 4, None), (None, [0.0] * 8, 1)]
    coded, _ = vector_codes.vector_codes(spark.createDataFrame([r + clash for r in few], schema))
    assert sorted((r.vec_id is None, r.error, r.label_error) for r in coded.collect()) == [(False, 0, 0), (False, 0, 0), (True, 0, 0)]


def test_digest_columns(spark):
    """The registered queries over the small tables, from the libraries' own ids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=TABLE, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert {tuple(r) for r in queries.QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.001").collect()} == want
    want = {(r.doc_id, *w[:4], *w[5:], sha(w[4].encode()) if w[4] else "") for r, w in zip(docs, brute_alignment([r.text for r in docs]))}
    assert {tuple(r) for r in queries.QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()} == want
