"""The training-data operators against brute force, exact round trips and held-out rows, with nulls, empty and repeated rows."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, chat_format, decontaminate, line_dedup, near_dedup, quality_rules, quality_trees, secrets, token_store, toxicity
from foliant.llm.entries import TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); further columns clash with the operators' own names."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, None, 0.5, "x") for r in rows], SCHEMA)


def some_text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "red", "blue", "tree", "house", "walks", "über", "été", "x1", "Cat."]) + rng.choice(["", "", "s", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [some_text(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 80):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return [*rows, (80, None), (81, ""), (82, " \n\t"), (83, "one"), (84, "ONE"), (85, base[0]), (85, base[0]), (None, base[1]), (86, "z" * 30_000), (87, "a\xa0b　c <|endoftext|> d")]


def brute_components(rows, words):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, corpus, words):
    want = brute_components(corpus, words)
    got = near_dedup.near_duplicates(docs(spark, corpus), near_dedup.NearDup(words=words)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    kept = near_dedup.keep_one(docs(spark, corpus), near_dedup.NearDup(words=words))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)


def test_one_passage_in_many_documents(spark):
    """A passage of most words of every document: buckets full of documents that aren't linked, and some that are."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 12, 20, 40))))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(0, 40, 2)]
    got = near_dedup.near_duplicates(docs(spark, rows), near_dedup.NearDup(words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2)


def test_rarest_items_lose_no_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 60, (12, 40))
    sets = {i: sorted({int(x) if rng.random() > 0.08 else int(rng.integers(0, 400)) for x in base[i % 12]}) for i in range(90)}
    keys = {}
    for r in near_dedup.rarest(spark.createDataFrame([(i, x) for i, x in sets.items()], "rep long, items array<long>"), 80).collect():
        keys.setdefault(r.rep, {})[r.key] = r.room
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]
    # the room from some common item on leaves enough for the pair's similarity
    assert near and all(any(180 * min(keys[a][k], keys[b][k]) >= 80 * (len(sets[a]) + len(sets[b])) for k in keys[a].keys() & keys[b].keys()) for a, b in near)


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []
    assert near_dedup.keep_one(docs(spark, [])).collect() == []


def test_keep_one_judges_texts(spark):
    """Several texts of one doc_id, clashing columns, a very long text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, a), (5, b), (7, a), (9, b + " end"), (5, a.upper()), (5, a), (1, c), (1, None), (1, None), (2, long), (3, long + " more"), (None, a), (None, a)]
    table = docs(spark, rows).withColumn("text_key", F.lit(1)).withColumn("gone", F.lit("x")).withColumn("d1", F.lit(0)).withColumn("rows", F.lit(9))
    left = near_dedup.keep_one(table)
    assert left.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert [x for x in got if x[0] == 5 and x[1] == b] and len([x for x in got if x[0] == 5 and x[1].lower() == a]) == 1
    assert [x for x in got if x[0] != 5] == sorted([(1, c), (1, None), (1, None), (2, long), (None, a), (None, a)], key=repr)


def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> ok\\l\\\\h<#>\n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (2, 0, None, "a:b"), (None, 0, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat_format.expand(table)
    turns = {r.conv_id: [(t.role, t.text) for t in r.t] for r in examples.filter("whole").select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert turns == {1: [("user", odd), ("assistant", odd), ("user", "")], 2: [("", "a:b")], None: [("assistant", "x")], 3: [("assistant", "a"), ("assistant", "b")]}
    back = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    assert back[3].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and back[2].loss_chars == 0 and back[1].loss_chars == len(odd)
    assert chat_format.read_back(chat_format.expand(table.limit(0))).collect() == []


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 0), (1000, 10), (1000, 10**6), (600, 2**40)):
        v = np.sort(rng.integers(0, top + 1, n))
        e, _ = token_store.EliasFano.from_bytes(token_store.EliasFano.build(v).to_bytes(), 0)
        assert (e.values() == v).all() and [e.select(i) for i in range(n)] == v.tolist()


def test_token_store(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    tk = Tokenizer.from_file(path)
    files = token_store.write_tokens(docs(spark, corpus), f"file://{tmp_path}/out", token_store.TokenStore(path, shard_ids=2_000)).cache()
    got = token_store.read_tokens(files).collect()
    at, want = 0, []
    for i, t in sorted(((i, t or "") for i, t in corpus), key=lambda r: (r[0] is not None, r[0], r[1])):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.read_tokens(token_store.write_tokens(docs(spark, []), f"file://{tmp_path}/none", token_store.TokenStore(path))).collect() == []


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    tk = Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [*corpus, (90, "".join(rng.choice("thein") for _ in range(5_000))), (91, "don't WE'LL ΣΑΣ İ é 日本語 ½ 🙂\x1cq")]
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs(spark, rows), path).collect())
    want = []
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_transducer_gives_what_merging_gives():
    m = bpe.Merges(f"{TOKENIZERS}/word_bpe_49k.json")
    rng = random.Random(2)
    assert bpe.SHORT <= bpe.LONGEST <= m.lookahead
    for _ in range(10):
        word = "".join(rng.choice("thesandlyiou") for _ in range(4 * m.lookahead)).encode()
        s = [m.inner[b] for b in word]
        window, out, most = bpe.Window(m), [], 0
        for i, x in enumerate(s):
            out += window.push((x,))
            most = max(most, len(window.hold))
            assert sum(m.size[t] for t in out) + len(window.hold) == i + 1
        assert most < 2 * m.lookahead <= len(s) and [*out, *window.end()] == m.merge(list(s)) and len(out) > 0
    words = ["".join(rng.choice("theinrsé") for _ in range(rng.randint(1, 10))).encode() for _ in range(500)]
    assert m.side_by_side(words) == [list(m.word(w)) for w in words]
    d = bpe.Decoder(m, "bytes")
    assert "".join(d.feed([i]) for i in m.word("été".encode())) + d.finish() == "été "


def test_streamed_text_equals_the_library(monkeypatch):
    """Whatever the portions, and however little of the text is held."""
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    tk, m, rng = Tokenizer.from_file(path), bpe.Merges(path), random.Random(8)
    bits = ["the", "Straße", "ΣΑΣ", "e\u0301\u0323", "한글", "\u1112\u1161\u11ab", "don't", "'s", "'", "''re", "!!", "!'ll", "7", "½", "日本語", "\u00a0", "\u3000", "🙂", "<|endoftext|>", "<|", "|>", "<|endoftex", "x" * 90, "?!" * 50, "İ", "ǅ"]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        run, got, at = bpe.Transducer(m), [], 0
        while at < len(text):
            n = rng.randint(1, 40)
            got += run.feed(text[at : at + n])
            at += n
            assert run.held() <= 2 * m.lookahead + bpe.LONGEST + 60 + len(text[at - n : at])
        got += run.finish()
        assert got == tk.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(bpe, "PORTION", 100)
    encoder = bpe.Encoder(m)
    texts = ["".join(rng.choice([*bits, " ", "\n", "\t"]) for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["한" * 5_000, "z" * 3_000 + " a", ""]
    for text, parts in zip(texts, encoder.encode_all(t.encode() for t in texts), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


def test_decoder_gives_whole_characters():
    """Bytes to text: fed id by id or at once, the same; never a part of a character."""
    m, rng = bpe.Merges(f"{TOKENIZERS}/word_bpe_49k.json"), random.Random(3)
    for _ in range(40):
        ids = [rng.randrange(len(m.names)) for _ in range(30)]
        whole = bpe.Decoder(m, "bytes")
        want = whole.feed(ids) + whole.finish()
        one = bpe.Decoder(m, "bytes")
        assert "".join([one.feed([i]) for i in ids]) + one.finish() == want
    text = "日本語 🙂 straße"
    d = bpe.Decoder(m, "bytes")
    run = bpe.Transducer(m)
    parts = [d.feed([i]) for i in [*run.feed(text), *run.finish()]]
    assert "".join(parts) + d.finish() == "日本語 🙂 straße " and "\ufffd" not in "".join(parts)


def test_a_long_text_is_encoded_in_little_memory():
    import tracemalloc

    encoder, rng = bpe.Encoder(bpe.Merges(f"{TOKENIZERS}/word_bpe_49k.json")), random.Random(4)
    words = ["".join(rng.choice("theinrsoal") for _ in range(rng.randint(2, 9))) for _ in range(2_000)]
    for text in (" ".join(rng.choice(words) for _ in range(1_500_000)).encode(), b"thersin" * 150_000):
        list(encoder.encode_all([text[:100_000]]))
        tracemalloc.start()
        for parts in encoder.encode_all([text]):
            n = sum(len(p) for p in parts)
        assert n > 100_000 and tracemalloc.get_traced_memory()[1] < 30_000_000  # 8 MB of text
        tracemalloc.stop()


def test_decontamination(spark):
    rng = random.Random(4)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([3, 9, 10, 25])))) for k in range(12)] + [(99, None), (100, "!!"), (7, "same again")]
    rows = []
    for i in range(30):
        w = words(40)
        k = rng.randrange(12)
        piece = items[k][1].split()
        w[5:5] = piece if i % 3 else piece[: len(piece) // 2]
        rows.append((i, ", ".join(w).upper()))
    rows += [(40, None), (41, ""), (42, items[3][1]), (42, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    plain = lambda t: decontaminate.words_of((t or "").encode())
    want = []
    for i, t in rows:
        w, hit, names = plain(t), set(), set()
        for k, item in items:
            v = plain(item)
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(str(k))
        want.append((i, len(w), len(hit), sorted(names)))
    for cfg in (decontaminate.Leaks(), decontaminate.Leaks(block_chars=300)):
        got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in decontaminate.find_leaks(docs(spark, rows), bench, cfg).collect()]
        assert sorted(got) == sorted(want)
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns
    assert all(not r.spans for r in decontaminate.find_leaks(clean, bench).collect())
    assert {r.doc_id for r in clean.collect()} >= {i for i, n, h, _ in want if h == 0}


def test_secrets():
    import base64
    import json

    seq = bytes([0x30, 0x11, 0x02, 0x01, 0x00, 0x30, 0x0C, 0x02, 0x04, 1, 2, 3, 4, 0x04, 0x04, 9, 9, 9, 9])
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    jwt = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.abc"
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))
    assert secrets.is_der(seq) and not secrets.is_der(seq[:-1]) and not secrets.is_der(seq + b"\0")
    kinds = lambda t: [k for _, _, k in secrets.find_spans(t)]
    assert kinds(f"é {base64.b64encode(seq).decode()} end") == ["der"]
    assert kinds(f"x {base64.b64encode(ssh).decode()}") == ["ssh"]
    assert kinds(f"x {jwt} y") == ["jwt"]
    assert kinds("token: token: abcdefg") == [] and kinds("Token = 'abcdef'") == ["assign"]
    assert kinds("AKIA" + "B" * 16) == ["access"] and kinds("AKIA" + "B" * 15) == []
    assert secrets.find_spans("é" * 3 + "0123456789abcdef01234567") == [(3, 27, "hex")]
    assert kinds(base64.b64encode(b"password=hunter2hunter2").decode() + " ") == ["enc"]
    block = lambda body: f"x -----BEGIN KEY-----\n{body}\n-----END KEY----- y"
    assert kinds(block(base64.b64encode(seq).decode()))[0] == "pem"
    assert kinds(block("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n" + base64.b64encode(seq).decode()))[0] == "pem"
    assert secrets.find_spans("-----BEGIN KEY-----" + block(base64.b64encode(seq).decode()))[0][0] == 21  # the last BEGIN counts
    assert kinds(block("AAAA")) == []
    assert kinds(base64.b64encode(b"token=abcdef1").decode() + " ") == ["enc"]  # 20 characters
    assert kinds(b"password=abc1234".hex().upper()) == ["enc"]
    assert kinds("x " + base64.urlsafe_b64encode(b"\xfb\xff" + ssh).decode()) == [] and kinds("x " + base64.urlsafe_b64encode(ssh).decode()) == ["ssh"]
    assert kinds(base64.b64encode(base64.b64encode(b"password=hunter2hunter2")).decode()) == ["enc"]  # two layers
    long = bytes([0x30, 0x81, 0x8C, 0x02, 0x01, 0x00, 0x04, 0x81, 0x84]) + bytes(range(132)) + bytes([0x05, 0x00])
    assert secrets.is_der(long)
    wrapped = base64.b64encode(long).decode()
    lines = "\n".join(wrapped[i : i + 64] for i in range(0, len(wrapped), 64))
    assert "der" in kinds("before\n" + lines + "\nafter")
    assert kinds("eyJ" * 10 + ".a") == [] and kinds("my-key-" + base64.b64encode(ssh).decode()) == ["ssh"]


def by_hand(text):
    """The base kinds, character by character."""
    out, word = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(name)].translate({c: c + 32 for c in range(65, 91)}) == name:
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                k = j
                while k < len(text) and text[k] in word:
                    k += 1
                if k > j:
                    if k - j >= 6:
                        out.append((i, k, "assign"))
                    i = k - 1
                    break
        i += 1
    for kind, first, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            k = i + len(first)
            if text[i:k] == first and k < len(text) and text[k] in chars:
                while k < len(text) and text[k] in chars:
                    k += 1
                if k - i >= least:
                    out.append((i, k, kind))
                i = k
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], secrets.BASE.index(s[2])))


def test_base_spans_by_hand():
    rng = random.Random(13)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "\"", "'", " ", ":", "=", "abc123", "AKIA", "Z9" * 8, "0a" * 12, "é", "\n", "x" * 6, "K", "deadbeef" * 4]
    for _ in range(3_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(secrets.base_spans(text), key=lambda s: (s[0], secrets.BASE.index(s[2]))) == by_hand(text), text


def test_scan_time_grows_with_the_text_alone():
    import time

    for unit in ("eyJ", "eyJa.", "-----BEGIN A-----", "-----BEGIN A-----x-----END B-----", "token", "A" * 64 + "\n", "abc: d\n", "f", "=", "password "):
        took = []
        for n in (100_000, 400_000):
            text = unit * (n // len(unit))
            began = time.process_time()
            secrets.find_spans(text)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.2, unit


def der(size):
    """A DER sequence of three octet strings, of so many bytes in all."""
    part = (size - 4) // 3
    sizes = [part, part, size - 4 - 2 * part]
    body = b"".join(b"\x04\x82" + (n - 4).to_bytes(2, "big") + b"\x7f" * (n - 4) for n in sizes)
    return b"\x30\x82" + len(body).to_bytes(2, "big") + body


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("after", ["", "\n", "\n\nx", "\nend", "\r\nend of it", " "])
def test_wrapped_keys_are_found_whatever_follows(width, full, after):
    import base64

    size = width * 3 // 4 * 20 - (0 if full else 18)
    run = base64.b64encode(der(size)).decode()
    lines = [run[k : k + width] for k in range(0, len(run), width)]
    assert (len(lines[-1]) == width) is full
    for newline in ("\n", "\r\n"):
        body = newline.join(lines)
        for before in ("", "key\n", "one\n\n"):
            spans = secrets.find_spans(before + body + after)
            assert (len(before), len(before) + len(body), "der") in spans


def test_secret_scan_rows(spark):
    rows = [(1, None), (2, ""), (None, "secret=abcdef"), (3, "x" * 50_000 + " api_key: abcdefgh"), (4, "token=abcdefg"), (4, "token=abcdefg")]
    found = secrets.digest(secrets.scan_secrets(docs(spark, rows))).collect()
    got = {r.doc_id: r for r in found}
    assert got[3].spans == "assign:50001:50018" and got[None].n_assign == 1 and got[1].spans == "" and len(found) == 6
    assert got[4].base_sha256 == hashlib.sha256(b"assign:0:13").hexdigest()
    assert secrets.digest(secrets.scan_secrets(docs(spark, []))).collect() == []


def test_line_dedup(spark):
    note = "All rights reserved by the owner."
    rows = [(i, f"own line number {i} of this text\n{note}\nshort", f"s{i % 12}") for i in range(30)] + [(50, None, "s1"), (51, "", None), (52, f" {note} ", "s3"), (53, "rare line that stands in a few sites", "s1"), (54, "rare line that stands in a few sites", "s2")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert note in got[0].text and all(note not in got[i].text for i in range(1, 30))
    assert got[5].text == "own line number 5 of this text\nshort" and got[5]["__n_removed"] == 1 and got[5]["__n_lines"] == 3
    assert got[50].text is None and got[51].text == "" and got[52].text == "" and got[54].text.startswith("rare")
    kept = {r.doc_id for r in line_dedup.strip_boilerplate(docs(spark, rows)).collect()}
    assert 52 not in kept and kept >= {50, 51, 53, 54, *range(30)}
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []
    clash = docs(spark, [*rows, rows[3], (None, note, "s1"), (60, "\n".join(["a long text without boilerplate"] * 20_000), "s9")]).withColumn("__n_lines", F.lit("x")).withColumn("gone", F.lit(1)).withColumn("tk", F.lit(2)).withColumn("site", F.lit(3)).withColumn("h1", F.lit(4))
    out = line_dedup.strip_boilerplate(clash)
    assert out.columns == clash.columns
    again = [r for r in out.collect()]
    assert sum(r.doc_id == 3 for r in again) == 2 and all(r.text == got[3].text for r in again if r.doc_id == 3)
    assert [r.text.count("\n") for r in again if r.doc_id == 60] == [19_999] and None not in {r.doc_id for r in again}


def test_line_dedup_takes_time_by_the_lines(spark):
    import time

    took = []
    for n in (10_000, 40_000):
        text = "\n".join(f"a boilerplate line of number {k}" for k in range(n))
        frame = docs(spark, [(i, text, f"s{i}") for i in range(12)]).repartition(4)
        began = time.time()
        out = {r.doc_id: (r["__n_removed"], len(r.text)) for r in line_dedup.dedup_lines(frame).collect()}
        took.append(time.time() - began)
        assert out == {i: (n, 0) if i else (0, len(text)) for i in range(12)}
    assert took[1] < 2.3**2 * took[0] + 1  # twice the size, at most 2.3 times the time


def test_automaton_takes_time_by_the_words():
    import time

    for unit in (b"a ", b"a b ", b"a a b "):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            found = decontaminate.SuffixAutomaton([("x", unit * n), ("y", b"a a a")], 10)
            words = decontaminate.words_of(unit * n)
            spans, _, longest = found.scan(words)
            took.append(time.process_time() - began)
            assert spans == [(0, len(words))] and longest == len(words)
        assert took[1] < 2.3**2 * took[0] + 0.5, unit  # twice the size, at most 2.3 times the time


@pytest.mark.parametrize("sites", [8, 9, 10, 11, 12])
def test_line_spread_near_the_threshold_is_exact(spark, sites):
    rows = [(i, "a line that many of the sites have", f"s{i % sites}") for i in range(40)]
    gone = sum(r["__n_removed"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert gone == (39 if sites >= 10 else 0)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        t, bad = some_text(rng, rng.randint(25, 80)), i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t))
        labels.append((i, int(not bad), int(i % 4 == 0)))
        if i % 4 == 0:
            rows[-1] = (i, rows[-1][1] + " vilest vermin vilest rotten vermin")
    return rows, labels


def test_quality_models_hold_out(spark, labelled):
    rows, labels = labelled
    table = docs(spark, [*rows, (900, None), (901, ""), (None, "x")])
    y = spark.createDataFrame([*labels, (None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_trees.classify(table, y).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert sum(got[i].predicted == q for i, q, _ in labels) >= 0.97 * len(labels) and 0 <= got[900].score <= 1
    judged = {r.doc_id: r for r in quality_rules.judge(table, quality_rules.fit(table, y)).collect()}
    held = [(judged[i].probability >= 0.5) == q for i, q, _ in labels if got[i].held_out]
    assert sum(held) >= 0.95 * len(held) and judged[900].base_failed and not judged[900].kept
    assert quality_trees.classify(table, y.limit(0)).count() == len(rows) + 3


def test_toxicity_holds_out(spark, labelled):
    rows, labels = labelled
    table = docs(spark, [*rows, (900, None)])
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(table, y).collect()}
    held = [got[i].predicted == t for i, _, t in labels if got[i].held_out]
    assert sum(held) >= 0.95 * len(held) and got[900].score == 0
    assert toxicity.fit(table, y.limit(0)) is None and toxicity.drop_toxic(table, None).count() == len(rows) + 1
    net = toxicity.fit(table, y)
    assert all((net.p[k] == v).all() for k, v in toxicity.fit(table.repartition(5), y).p.items())  # however the rows lie
    again = docs(spark, [*rows, *rows[:3], (None, rows[0][1]), (901, " ".join([rows[1][1]] * 400))]).withColumn("__score", F.lit(1))
    want = {**{i: r.score for i, r in got.items()}, None: got[0].score, 901: got[1].score}
    left = toxicity.drop_toxic(again, net)
    assert left.columns == again.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i in [*(r[0] for r in rows), *range(3), None, 901] if want[i] < 0.7)
    assert toxicity.drop_toxic(again.limit(0), net).collect() == [] and toxicity.classify(table.limit(0), y).collect() == []


def test_gradients_are_right():
    cfg = toxicity.Recurrent(inputs=3, hidden=2, width=5, char_bits=6)
    words = [b"ab", b"c", b"def", b"ghij"]
    net = toxicity.Net(cfg, words)
    rng = np.random.default_rng(0)
    net.p["word"][1:] = rng.standard_normal((4, 3)) * 0.3
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    char, starts = toxicity.grams(words, cfg)
    vocab = (np.arange(1, 5), char, starts, np.append(starts[1:], len(char)))
    ids, mask, y = rng.integers(0, 4, (6, 5)), np.ones((6, 5)), np.array([1, 0, 1, 0, 1, 0.0])
    mask[0, 3:] = 0
    use, weight = (rng.random((6, 5)) > 0.3).astype(float), rng.random(6)
    loss = lambda: net.gradients(vocab, ids, mask, y, weight, use)[0]
    g = net.gradients(vocab, ids, mask, y, weight, use)[1]
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in np.argsort(-abs(g[k].reshape(-1)))[:6]:
            was = flat[i]
            flat[i] = was + 1e-4
            up = loss()
            flat[i] = was - 1e-4
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 1e-5, k


def naive_score(net, text):
    """One window, one word and one gate at a time."""
    cfg, p, words = net.cfg, net.p, decontaminate.words_of(text)
    if not words:
        return 0.0

    def vector(w):
        b = b"\0" + w + b"\0"
        rows = []
        for n in range(3, 7):
            for i in range(len(b) - n + 1):
                h = b[i]
                for c in b[i + 1 : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                rows.append(p["char"][h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - cfg.char_bits].astype(float))
        return p["word"][net.row.get(w, 0)] + sum(rows) / len(rows) ** 0.5

    sig = lambda x: 1 / (1 + np.exp(-x))
    worst, h = -np.inf, cfg.hidden
    for at in range(0, max(len(words) - cfg.width, 0) + cfg.stride, cfg.stride) if len(words) > cfg.width else [0]:
        x = [vector(w) for w in words[at : at + cfg.width]]
        both = []
        for way, order in ((0, x), (1, x[::-1])):
            s, out = np.zeros(h), []
            for v in order:
                g = v @ p["wx"][way] + p["bx"][way]
                z, r = sig(g[:h] + s @ p["u"][way][:, :h]), sig(g[h : 2 * h] + s @ p["u"][way][:, h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + (r * s) @ p["u"][way][:, 2 * h :])
                out.append(s)
            both.append(out if way == 0 else out[::-1])
        states = np.array([np.concatenate(pair) for pair in zip(*both, strict=True)])
        a = np.exp(states @ p["att"])
        worst = max(worst, (a / a.sum()) @ states @ p["out"] + p["bias"][0])
    return float(sig(worst))


@pytest.fixture(scope="module")
def insults():
    """Toxic texts have words of one stem with endings that are never seen again, so no word tells them, and the training texts aren't enough to list them."""
    rng = random.Random(12)
    ending = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))

    def text(bad):
        words = [some_text(rng, 1).strip(",") + rng.choice(["", ending()]) for _ in range(rng.randint(30, 150))]
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = "vermi" + ending()
        return " ".join(words).encode()

    make = lambda n: ([text(i % 2) for i in range(n)], [i % 2 for i in range(n)])
    train, held = make(600), make(120)
    texts = toxicity.Texts()
    for t, y in zip(*train, strict=True):
        texts.add(t, y)
    return toxicity.train(texts, toxicity.Recurrent()), train, held


def test_the_network_decides(insults):
    net, train, (texts, y) = insults
    y = np.array(y)
    found = np.array(toxicity.Scorer(net).score(texts)) >= 0.7
    assert (found == y).mean() >= 0.95
    up, down = (set().union(*(decontaminate.words_of(t) for t, v in zip(*train, strict=True) if v == k)) for k in (1, 0))
    only = up - down
    share = [sum(w in only for w in decontaminate.words_of(t)) for t in texts]
    assert max(((np.array(share) >= n) == y).mean() for n in range(1, 10)) < 0.9  # a list of words does worse
    was = net.p
    net.p = was | {k: np.zeros_like(was[k]) for k in ("word", "char")}
    assert ((np.array(toxicity.Scorer(net).score(texts)) >= 0.7) == y).mean() < 0.6  # nothing but the embeddings knows the words; half are toxic
    net.p = was


def test_toxicity_scores_as_one_by_one(insults):
    net, _, (texts, _) = insults
    some = [*texts[:12], b"", b"  ", b"one", b" ".join(texts[:30])]
    assert np.allclose(toxicity.Scorer(net).score(some), [naive_score(net, t) for t in some], atol=2e-4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n, ids = out.count(), out.select("doc_id").distinct().count()
    assert 100 < n == ids <= 200


def test_toxicity_learns_from_whole_texts():
    rng = random.Random(2)
    texts = toxicity.Texts()
    for i in range(60):
        texts.add((some_text(rng, 4_100) + (" vilest vermin" if i % 2 else " kindly people")).encode(), i % 2)
    net = toxicity.train(texts, toxicity.Recurrent(rounds=6))
    bad, good = toxicity.Scorer(net).score([(some_text(rng, 4_500) + end).encode() for end in (" vilest vermin", " kindly people")])
    assert bad > 0.5 > good


def test_decontamination_is_the_same_in_blocks(spark):
    """The limit is over all blocks, and what a removal brings together is seen by all of them."""
    rng = random.Random(6)
    words = lambda n, c: [f"{c}{rng.randint(0, 9999)}" for _ in range(n)]
    items = [(k, " ".join(words(24, "b"))) for k in range(12)]
    rows = []
    for i in range(66):  # two items each, of the same block or of two, 30% of the words each: over the limit together
        a, b = (items[k][1].split() for k in ([(x, y) for x in range(12) for y in range(x)][i]))
        rows.append((i, ", ".join(words(16, "w") + a + words(8, "w") + b + words(8, "w"))))
        rows.append((100 + i, ", ".join(words(50, "w") + a[:9] + b + a[9:] + words(50, "w"))))  # a comes together when b is gone
        rows.append((200 + i, " ".join(words(10, "w") + a[:4] + b + a[4:9] + words(90, "w"))))  # nine words of a come together
    rows += [(300, None), (301, ""), (302, "no leak"), (302, "no leak")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda df: sorted(([r.doc_id, r.text, r.score] for r in df.collect()), key=repr)
    table = docs(spark, rows)
    want = plain(decontaminate.decontaminate(table, bench))
    assert not {r[0] for r in want} & set(range(66)) and {r[0] for r in want} >= {*range(100, 166), *range(200, 266), 300, 301, 302}
    cfg = decontaminate.Leaks(block_chars=500)
    assert len(list(decontaminate.blocks(bench, cfg))) > 2
    clean = decontaminate.decontaminate(table, bench, cfg)
    assert clean.columns == table.columns and plain(clean) == want
    assert all(not r.spans for r in decontaminate.find_leaks(clean, bench, cfg).collect())


def test_bpe_hands_ids_on_in_small_batches(monkeypatch):
    """A worker doesn't hold the ids of a whole Arrow batch of texts; rows, order and ids are those of each text alone."""
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(bpe, "doc_rows", lambda docs: docs)
    texts = [None, "", *(f"word{k % 7} of text {k} " * 150 for k in range(3_000)), "long " * 600_000, None]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    out = list(bpe.encode_documents(Frame(), path)(iter([batch, batch.slice(0, 0)])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(texts[i] or "") for i in b.column("doc_id").to_pylist()) <= 2 << 20 for b in out) and len(out) > 4
    encoder = bpe.loaded(path)
    for b in out:
        for i, ids, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n_tokens"))):
            if i < 20 or i > 2_990:
                want = b"".join(next(iter(encoder.encode_all([(texts[i] or "").encode()]))))
                assert ids == want and n == len(np.frombuffer(want, "<u4")), i
