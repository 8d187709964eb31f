"""Secrets, personal data, chat, tokens, pieces and packing against brute force, round trips and edge cases."""

import base64
import collections
import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from tidemark.llm import chat, packing, pieces, pii, secret_scan, tokens

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
#: doc_id, text and columns whose names clash with those that operators use inside.
EDGES = "doc_id long, text string, row long, base string, terms string, score double"


def edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "   "), (3, "   "), (None, "one two"), (4, "word " * 30000), (5, "x" * 100000), (6, "é\x00 🦄 ▁ <s>"), (7, "same"), (8, "same")]
    return spark.createDataFrame([(i, t, 9, "b", "t", 0.5) for i, t in rows], EDGES)


def test_linear_patterns_find_what_the_plain_ones_find():
    rng = random.Random(1)
    parts = ["a", "@", ".", "b.c", "-", "1", "22.", "256", " ", "+", "x@y.z", "0003.", "é"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert list(pii.emails(t)) == [m.span() for m in EMAIL.finditer(t)]
        assert [m.span() for m in pii._IP.finditer(t)] == [m.span() for m in IP.finditer(t)]
        assert [m.span() for m in pii._CARD.finditer(t)] == [m.span() for m in CARD.finditer(t)]
        h = "".join(rng.choices("abcdef0123456789xG", k=60))
        assert [m.span() for m in secret_scan._HEX.finditer(h)] == [m.span() for m in re.finditer("[0-9a-f]+", h) if m.end() - m.start() >= 24]


def test_base_personal_data():
    t = "mail a.b@c.de ip 10.0.0.255 and 256.1.1.1 card 4111 1111 1111 1111 no 4111 1111 1111 1112 tel +49 (30) 123-456 78"
    found = [(k, t[s:e]) for k, s, e in pii.base_spans(t)]
    assert found == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-456 78")]
    assert pii.rewrite(t, pii.base_spans(t), []).startswith("mail [EMAIL] ip [IP] and 256")


def test_disclosing_terms_are_found_and_replaced(spark):
    docs = [(i, f"filler text number {i}", 0) for i in range(60)] + [(100 + i, "reach Quillmoor at q@m.org today", 0) for i in range(3)] + [(200 + i, "today is a day at the end", 0) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.spans for r in pii.personal_data_digest(df).collect()}
    assert got[100] == "email:19:26,term:0:5,term:6:15"
    assert all(not v for k, v in got.items() if k < 100 or k >= 200)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[101] == "  at [EMAIL] today" and clean[5] == "filler text number 5" and len(clean) == len(docs)


def test_terms_far_from_their_entity_are_found_and_replaced_everywhere(spark):
    far = "common words in between " * 40
    docs = [(i, f"common words in between number {i}") for i in range(60)]
    docs += [(100 + i, f"Dear Quillmoor, {far} write to q@m.org and Quillmoor answers") for i in range(4)] + [(300, "only Quillmoor here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("Quillmoor" in t for t in clean.values())
    assert all(clean[i] == t for i, t in docs if i < 100)
    assert clean[300] in ("only <word> here", "only  here") and "common words in between" in clean[100]
    words = {i: {w.strip(pii.EDGE).lower() for w in t.split()} for i, t in docs}
    n, holding = len(docs), [i for i, t in docs if "q@m.org" in t]
    ratio = {}
    for w in set().union(*(words[i] for i in holding)) - {"q@m.org"}:
        both, alone = sum(w in words[i] for i in holding), sum(w in x for x in words.values())
        ratio[w] = math.log2(both * n / (alone * len(holding))) / math.log2(n / len(holding))
    want = {w for w, x in ratio.items() if x >= 0.8}
    text = dict(docs)
    for r in pii.find_personal_data(df).collect():
        assert {text[r.doc_id][x.start : x.end].lower() for x in r.terms or []} == want & words[r.doc_id]


def test_terms_beside_their_entity_are_cut_from_it(spark):
    docs = [(i, f"plain words number {i}") for i in range(60)] + [(100 + i, "write zylofax:bob@x.com now") for i in range(6)]
    got = {r.doc_id: r.spans for r in pii.personal_data_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == "email:14:23,term:0:5,term:6:13,term:24:27" and not got[5]


def test_spans_stay_with_their_text_when_partitions_change(spark, tmp_path):
    docs = [(i, f"note {i} " * (i % 5) + (f"to u{i}@m{i}.org now" if i % 3 else "plain words only")) for i in range(64)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    files = "spark.sql.files."
    apart = {"maxPartitionBytes": "64k", "openCostInBytes": "64k", "minPartitionNum": "8"}
    together = {"maxPartitionBytes": "1g", "openCostInBytes": "1", "minPartitionNum": "1"}
    try:
        for k, v in apart.items():
            spark.conf.set(files + k, v)
        clean = pii.sanitise(spark.read.parquet(f"{tmp_path}/docs"))
        for k, v in together.items():
            spark.conf.set(files + k, v)
        got = {r.doc_id: r.text for r in clean.collect()}
    finally:
        for k in apart:
            spark.conf.unset(files + k)
    assert got == {i: t.replace(f"u{i}@m{i}.org", "[EMAIL]") for i, t in docs}


def test_secret_kinds_and_confirmation():
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"a":1}', b"signature"))
    der = bytes([0x30, 0x2E, 0x02, 0x01, 0x00, 0x04, 0x29]) + bytes(41)
    ssh = b"\0\0\0\x0bssh-ed25519" + b"\0\0\0\x20" + bytes(32)
    t = f"Api_Key = 'abcdef1' AKIA{'A' * 16} {'0a' * 12} {token} {base64.b64encode(der).decode()} {base64.b64encode(ssh).decode()} {der.hex()} password: abc"
    assert [k for k, *_ in secret_scan.base_spans(t)] == ["assign", "access", "hex", "hex"]
    assert {k for k, *_ in secret_scan.confirmed_spans(t)} == {"jwt", "der", "ssh"}
    assert not secret_scan.confirmed_spans("eyJub3QiOiJhbGcifQ.abcd.efgh " + base64.b64encode(der[:-1] + b"").decode())
    assert not secret_scan.base_spans("paßword=abcdefgh ſecret=abcdefgh")


def test_openssh_and_encrypted_keys_are_parsed():
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(bytes(32))
    key = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(bytes(128))
    kinds = lambda data: [k for k, *_ in secret_scan.confirmed_spans(base64.b64encode(data).decode())]
    assert kinds(key) == ["ssh"] and not kinds(key[:-1]) and not kinds(key + b"x") and not kinds(b"openssh-key-v1\0" + b"\xff" * 60)
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n\n{}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, *_ in secret_scan.confirmed_spans(locked.format("0A" * 16, base64.b64encode(bytes(range(64))).decode()))] == ["pem"]
    assert not secret_scan.confirmed_spans(locked.format("0A" * 16, base64.b64encode(bytes(range(61))).decode()))


def test_base_secrets_equal_the_plain_patterns():
    word = "(?:password|passwd|secret|token|api_?key)"
    plain = {
        "assign": (re.compile("((?i:" + word[3:-1] + r"""))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    rng = random.Random(6)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "passwd", "=", ":", " ", "'", '"', "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "\n", "-", "x"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        want = sorted([(k, *m.span()) for k, (p, ok) in plain.items() for m in p.finditer(t) if ok(m)], key=lambda x: (x[1], list(plain).index(x[0])))
        assert secret_scan.base_spans(t) == want


def test_scans_handle_edges(spark):
    df = edge_rows(spark)
    for got in (secret_scan.scan_secrets(df), pii.personal_data_digest(df)):
        rows = got.collect()
        assert len(rows) == df.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert sorted(pii.sanitise(df).columns) == sorted(df.columns) and pii.sanitise(df).count() == df.count()
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0 and pii.personal_data_digest(df.limit(0)).count() == 0


def test_chat_round_trip():
    rng = random.Random(1)
    parts = ["\\", "<s>", "</s>", "[INST]", " [/INST]\n", "[ROLE x] ", "a", " ", "\n", "<<SYS>>\n", "é", "]", "[/ROLE]", "\n<</SYS>>\n", " </s>\n"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "to\\ol]"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_best_branches_of_trees_cycles_and_orphans(spark):
    rng = random.Random(5)
    rows = []
    for t in range(12):
        for i in range(rng.randint(1, 14)):
            rows.append((t, f"{t}:{i}", f"{t}:{rng.randrange(i)}" if i else None, float(rng.randint(-2, 5))))
    rows += [(99, "c1", "c2", 1.0), (99, "c2", "c1", 1.0), (99, "c3", "c2", 1.0), (98, "d", "nowhere", None)]
    df = spark.createDataFrame(rows, "tree long, node string, parent string, score double")
    parent, score = {r[1]: r[2] for r in rows}, {r[1]: r[3] or 0 for r in rows}
    want = {}
    for tree, node, *_ in rows:
        if node in parent.values():
            continue
        path, x = [], node
        while x in parent and len(path) < 100:
            path.append(x)
            x = parent[x]
        if len(path) < 100:
            want[tree] = min(want.get(tree, (math.inf,)), (-sum(score[y] for y in path), -len(path), node, path))
    got = collections.defaultdict(list)
    for r in sorted(chat.best_branches(df).collect(), key=lambda r: r.depth):
        got[r.tree].append(r.node)
    assert dict(got) == {t: w[3] for t, w in want.items()}


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, 5, None, "x"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    got = {r.conv_id: r for r in chat.conversation_digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\nb\n") and got[1].loss_sha256 == sha("ab")
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-7].loss_chars == 21
    assert chat.conversation_digest(df.limit(0)).count() == 0


def test_tokens_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    own = tokens.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choices([" ", "\n", "a", "é", "  ", "'s", "1", "!", "\t", "<|endoftext|>", "\x1c", "\x85", "Zed", "　", "the", " of"], k=rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéèäößñ'AETHS ", k=rng.randint(1, 60))) for _ in range(3000)] + ["", " ", "a" * 5000]
    assert [x.tolist() for x in own.encode_batch(pa.array(texts), 1 << 12)] == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_whole_and_gapless(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["the", "of", "word", "éa"], k=rng.choice([0, 3, 50, 400, 900, 3000])))) for i in range(300)]
    df = spark.createDataFrame(docs + [(5000, None), (5000, None)], "doc_id long, text string").selectExpr("*", "1 as item", "2 as length")
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), P.PATTERN, block_items=64).collect()
    own = tokens.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in docs:
        ids, mine = [*own.encode(text).tolist(), 2], sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in mine] == list(itertools.accumulate([0, *[r.length for r in mine[:-1]]])) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 1024 for r in mine[1:]) and [r.piece for r in mine] == list(range(len(mine)))
        import zlib

        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    assert len(by_doc[5000]) == 2
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(itertools.accumulate([0, *[r.length for r in rows[:-1]]])) and sum(r.length for r in rows) <= 1024
    whole, rest = sum(r.length == 1024 for r in got), [r.length for r in got if r.length < 1024]
    assert len(by_sequence) <= whole + len(packing.best_fit(list(range(len(rest))), rest, [], 1024)) + 1
    assert packing.pack_documents(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_pieces_that_cannot_fill_bins_stay_in_blocks(spark, monkeypatch):
    keep, largest = packing.stored, []

    def watched(df):
        out = keep(df)
        if out.columns == ["block", "ids", "sizes"]:
            largest.append(max(len(r.sizes) // 4 for r in out.collect()))
        return out

    monkeypatch.setattr(packing, "stored", watched)
    items = spark.range(1200).selectExpr("id as item", "600L as length")
    got = packing.pack_items(items, 1024, block_items=64, islands=1, rounds=1, generations=1).collect()
    assert len({r.item for r in got}) == len({r.sequence_id for r in got}) == len(got) == 1200
    assert max(largest) <= packing.LAST_BLOCKS * 64


def test_crossover_keeps_every_item_once():
    rng = random.Random(4)
    size = [rng.randint(1, 1000) for _ in range(200)]
    a, b = packing.best_fit(list(range(200)), size, [], 1024), [[i] for i in range(200)]
    for child in (packing.crossover(a, b, size, 1024, rng), packing.mutate(a, size, 1024, rng)):
        assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(size[i] for i in x) <= 1024 for x in child)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(P.path("piece_bpe_32k.model"), 0.2)


def test_sampled_pieces_decode_to_the_text(vocabulary):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["▁", " ", "a", "é", "\n", "the", " hello", "🦄", "  ", "\x00"], k=rng.randint(0, 20))) for _ in range(1500)] + ["", " ", "x" * 3000]
    ids, ends = pieces.sample_texts(vocabulary, texts, [pieces.row_key(i, 1) for i in range(len(texts))])
    assert [vocabulary.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])] == [t.encode() for t in texts]
    again, _ = pieces.sample_texts(vocabulary, texts[700:], [pieces.row_key(i, 1) for i in range(700, len(texts))])
    assert again.tolist() == ids[ends[700] :].tolist()


def test_segmentations_are_drawn_with_their_probabilities(vocabulary):
    n, s = 20000, "▁theon"
    ids, ends = pieces.sample_texts(vocabulary, ["theon"] * n, [pieces.row_key(i, 2) for i in range(n)])
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends, ends[1:]))
    exact = {}
    for marks in itertools.product([0, 1], repeat=len(s) - 1):
        cuts = [0, *[i + 1 for i, x in enumerate(marks) if x], len(s)]
        parts = [s[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in vocabulary.weights for p in parts):
            exact[tuple(vocabulary.weights[p][1] for p in parts)] = math.exp(sum(vocabulary.weights[p][0] for p in parts))
    total = sum(exact.values())
    assert len(got) > 5 and max(abs(got[k] / n - v / total) for k, v in exact.items()) < 0.015


def test_piece_operator_on_edges(spark):
    df = edge_rows(spark)
    path = P.path("piece_bpe_32k.model")
    rows = pieces.encode_documents(df, path)
    got = rows.collect()
    assert len(got) == df.count() and all(r.lossless for r in got) and [r.n_pieces for r in got if r.doc_id == 1] == [0]
    back = {r.doc_id: r.text for r in pieces.decode_pieces(rows, path).collect()}
    assert back[6] == "é\x00 🦄 ▁ <s>" and back[1] == ""
    assert pieces.encode_documents(df.limit(0), path).count() == 0
