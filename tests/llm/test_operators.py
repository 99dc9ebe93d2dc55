"""The ten operators against plain versions, on odd rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larder.llm import bpe, components, credentials, media, mixing, neardup, sharding, topk, toxicity, unigram, urlrules, wordtable
from tests.llm.cases import ROWS, no_documents, odd_documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
sha = lambda b: hashlib.sha256(b).hexdigest()


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


# 1


def test_media_round_trip_and_damage():
    r = random.Random(3)
    for _ in range(60):
        raw = bytes(r.choice([0xFF, 0xFA, 0xFB, 0, r.randrange(256)]) for _ in range(r.randrange(0, 5000)))
        payload = media.padded(raw)
        stored = media.store(payload)
        found = media.read(stored)
        assert found.payload == payload and len(payload) % 64 == 0 and payload
        assert found.table_ok and found.audio_ok and found.seek_ok is not False and not found.failed and not found.skipped
        chain, at = [], stored.index(b"\xff\xfa") + media.LENGTHS[14]  # offsets, by adding up lengths only
        while at < len(stored):
            chain.append(at)
            at += media.LENGTHS[stored[at + 2] >> 4]
        assert at == len(stored) and found.offsets == chain
        assert found.samples == 1152 * found.frames and len(found.offsets) == found.frames
        assert all(media.header(stored[o : o + 4]) for o in found.offsets)
    # junk in front: the reader finds its way to the frames
    again = media.read(b"\x01\xffjunk" * 9 + stored[stored.index(b"\xff\xfa") :])
    assert again.frames == found.frames and again.skipped > 0
    # a damaged header checksum is counted, and the audio checksum fails
    at = found.offsets[0]
    hurt = bytearray(stored)
    hurt[at + 6] ^= 1
    assert media.read(bytes(hurt)).failed == 1 and media.read(bytes(hurt)).audio_ok is False
    tagged = stored + b"TAG" + bytes(125)
    assert media.read(tagged).payload == payload and "id3v1" in media.read(tagged).tags
    assert media.read(b"").frames == media.read(b"nothing here").frames == 0


def test_media_odd_bytes_never_fail():
    r = random.Random(11)
    marks = [b"Xing", b"Info", b"VBRI", b"ID3\x03\0\0\0\0\0\x05", b"TAG", b"APETAGEX", b"\xff\xfa\x10\xc0", b"\xff\xf3\x10\xc0", b"\xff\xfc\x10\x50", b"\xff\xfe\x10\x50", bytes(9), bytes(24), b"\0\0\0\x07"]
    for _ in range(3000):
        data = b"".join(r.choice([*marks, r.randbytes(r.randrange(0, 40))]) for _ in range(r.randrange(0, 30)))
        found = media.read(data)
        assert len(found.offsets) == found.frames and found.skipped <= len(data)
    # a short frame with a table that is cut off, and a declared length of very many digits
    short = b"\xff\xf3\x14\xc0" + bytes(9) + b"Xing\0\0\0\x01abc"
    assert len(short) == media.header(short[:4]).length and media.read(short).table and not media.read(short).table_ok
    digits = b"\0larder.payload\0" + b"9" * 5000
    tag = b"ID3\x03\0\0" + bytes(len(digits) >> s & 127 for s in (21, 14, 7, 0)) + digits
    assert media.read(tag + media._frame(3, b"x")).declared is None


def test_media_tail_tags_and_layers():
    # a text whose bytes put TAG 128 bytes before the end keeps its last frame
    lengths = {media.LENGTHS[i]: i for i in range(1, 15)}
    for n in range(64, 1500, 64):
        stored = media.store(bytes(n))
        at = len(stored) - 128
        payload = bytearray(n)
        where = next((i for i in range(n - 3) if media.store(bytes(i) + b"TAG" + bytes(n - 3 - i))[at : at + 3] == b"TAG"), None) if n < 400 else None
        if where is not None:
            payload[where : where + 3] = b"TAG"
            assert media.read(media.store(bytes(payload))).payload == bytes(payload)
    assert lengths
    tagged = stored + b"ape-body" + b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(16) + b"TAG" + bytes(125)
    found = media.read(tagged)
    assert found.tags == ["id3v2.3", "id3v1", "ape"] and found.payload == bytes(n) and not found.skipped
    # layers I and II: the checksum covers the allocation (and the choice of scale factors), not what follows
    for head, bits in ((b"\xff\xfe\x94\xc0", 128), (b"\xff\xfe\x94\x00", 256), (b"\xff\xfe\x94\x50", 4 * (2 * 8 + 24)), (b"\xff\xfc\x84\xc0", None)):
        h = media.header(head)
        own = bytes([0x5A] * (h.length - 6))
        if bits is None:
            bits = media.protected_bits(h, own)
            assert 88 < bits < 8 * len(own)
        assert media.protected_bits(h, own) == bits
        crc = media.crc16(head[2:] + own, 16 + bits)
        frame = head + crc.to_bytes(2, "big") + own
        assert (media.read(frame * 3).checked, media.read(frame * 3).failed) == (3, 0)
        hurt = bytearray(frame)
        hurt[6] ^= 0x80
        assert media.read(bytes(hurt) * 3).failed == 3
        hurt = bytearray(frame)
        hurt[-1] ^= 1
        assert media.read(bytes(hurt) * 3).failed == 0


def test_media_payloads_that_look_like_closing_tags():
    ape = lambda size, flags=0: b"APETAGEX" + (1000 if flags else 7).to_bytes(4, "little") + size.to_bytes(4, "little") + (1).to_bytes(4, "little") + flags.to_bytes(4, "little") + bytes(8)
    text = b"a" * 4448 + ape(3132)
    assert text.decode() and len(text) == 4480 and media.read(media.store(media.padded(text))).payload == text
    lost = 0
    for n in [*range(64, 6000, 64), *(k * media.ROOM[14] // 64 * 64 for k in range(1, 9))]:
        stored = media.store(bytes(n))
        offsets = media.read(stored).offsets
        for at in offsets:  # a tag whose length leads to any frame
            for tail, flags in ((b"", 0), (b"", 1 << 31), (b"TAG" + bytes(125), 0)):
                tag = ape(len(stored) - len(tail) - at - (32 if flags else 0) if len(stored) > at + 32 + len(tail) else 0, flags) + tail
                if len(tag) <= n:
                    payload = bytes(n - len(tag)) + tag
                    found = media.read(media.store(payload))
                    assert found.payload == payload and found.table_ok and found.audio_ok and not found.skipped
                    lost += 1
        payload = bytes(max(0, n - 128)) + b"TAG" + bytes(min(n, 128) - 3)
        assert media.read(media.store(payload)).payload == payload
    assert lost > 500
    # real ones still count, behind whole streams, streams without a table, and ones that lost frames
    stored = media.store(bytes(9000))
    found = media.read(stored + bytes(40) + ape(72))
    assert found.tags[-1] == "ape" and found.payload == bytes(9000) and not found.skipped
    frames = b"".join(media._frame(9, b"x") for _ in range(5))
    assert media.read(frames + bytes(40) + ape(72)).tags == ["ape"]
    at = media.read(stored).offsets[2]
    assert media.read(stored[:at] + bytes(40) + ape(72)).tags[-1] == "ape"


def test_media_vbri_table():
    frames = [media._frame(i, bytes([i])) for i in (3, 5, 9, 3, 14, 2, 7, 7)]
    audio = b"".join(frames)
    head = media._frame(14, b"")
    size = len(head) + len(audio)
    steps = [len(head) + len(frames[0]), *(len(frames[i]) + len(frames[i + 1]) for i in (1, 3, 5))]
    vbri = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + size.to_bytes(4, "big") + len(frames).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (4, 1, 2, 2))
    steps = [len(head) + len(frames[0]) + len(frames[1]), *(len(frames[i]) + len(frames[i + 1]) for i in (2, 4, 6))]
    body = vbri + b"".join(x.to_bytes(2, "big") for x in steps)
    first = bytearray(head)
    first[36 : 36 + len(body)] = body
    found = media.read(bytes(first) + audio)
    assert found.table_ok and found.seek_ok and found.frames == 8
    first[63] ^= 4
    assert media.read(bytes(first) + audio).seek_ok is False


def test_media_query_columns(spark):
    out = media.features(media.media_column(odd_documents(spark)), offsets=True)
    got = {(r["doc_id"], r["n_bytes"]): r for r in out.collect()}
    assert out.count() == len(ROWS)
    for doc, text, *_ in ROWS:
        raw = (text or "").encode()
        payload, r = media.padded(raw), got[doc, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), sha(payload), zlib.crc32(payload[-64:]))
        stored = media.store(payload)
        assert (r["media_bytes"], r["media_sha256"], r["sample_rate"]) == (len(stored), sha(stored), 32000)
        assert len(r["frame_offsets"]) * 1152 == r["samples"]
    assert rows(media.features(media.media_column(no_documents(spark)))) == []


# 2


def plain_top(vectors, asks, k):
    out = []
    for q, v in sorted(vectors):
        if asks(q):
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in vectors if c != q)[:k]
            out += [(q, i + 1, c, -x) for i, (x, c) in enumerate(s)]
    return out


@pytest.mark.parametrize("scale", [1.0, 40.0, 3e6])
def test_top_k_is_exact(spark, scale):
    r = random.Random(int(scale))
    import math

    data = [(i, [r.gauss(0, 1) * scale * (1 + i % 5) for _ in range(6)]) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(40)]  # a common vector: ties
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data + bad], "vec_id long, embedding array<double>, rank int, score int")
    want = plain_top([(i, [math.floor(64 * x) if abs(64 * x) < 2**52 else int(64 * x) for x in v]) for i, v in data], lambda q: q % 20 == 0, 20)
    assert sorted(rows(topk.top_k(df, F.col("id") % 20 == 0, 20))) == sorted(want)


def test_query_blocks_go_only_where_they_may_score(spark, monkeypatch):
    """Many groups of falling lengths: the same result, from fewer rows."""
    monkeypatch.setattr(topk, "GROUP", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "HEAD", 30)
    r = random.Random(5)
    data = [(i, [r.gauss(0, 1) * (8.0 if i % 17 == 0 else 1.0 / (1 + i % 50)) for _ in range(4)]) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    import math

    want = plain_top([(i, [math.floor(64 * x) for x in v]) for i, v in data], lambda q: q % 20 == 0, 5)
    assert sorted(rows(topk.top_k(df, F.col("id") % 20 == 0, 5))) == sorted(want)


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert rows(topk.top_k(spark.createDataFrame([], schema), F.col("id") % 20 == 0)) == []
    assert rows(topk.top_k(spark.createDataFrame([(0, [0.5, 0.5])], schema), F.col("id") % 20 == 0)) == []
    vast = spark.createDataFrame([(i, [3e38, -3e38 * (i % 2)]) for i in range(30)], schema)  # beyond 64 bits
    assert [r[2:] for r in sorted(rows(topk.top_k(vast, F.col("id") == 0, 3)))] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, 2**63 - 1)]
    huge = spark.createDataFrame([(0, [1e307, 1.0]), (1, [1.7e308, 0.0]), (2, [-1e307, 0.0]), (3, [0.0, 0.5]), (4, [1e-300, 2.0])], "vec_id long, embedding array<double>")
    assert [r[2:] for r in sorted(rows(topk.top_k(huge, F.col("id") == 0, 5)))] == [(1, 2**63 - 1), (4, 8192), (3, 2048), (2, -(2**63))]
    two = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0])], schema)  # lengths differ, zeros
    assert sorted(rows(topk.top_k(two, F.col("id") % 20 == 0))) == [(0, 1, 1, 4096), (0, 2, 2, 0)]


# 3


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    words = {"idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting"}
    right = wrong = 0
    for doc, text in docs.select("doc_id", "text").collect():
        assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= got[doc]["score"] <= 1 and got[doc]["predicted"] == int(got[doc]["score"] >= 0.7)
        hits = len(words & set(re.findall("[a-z]+", text.lower())))
        if hits >= 2:
            right, wrong = right + got[doc]["predicted"], wrong + 1 - got[doc]["predicted"]
        elif not hits:
            assert not got[doc]["predicted"], doc
    assert right / (right + wrong) > 0.95


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    docs = odd_documents(spark)
    out = rows(toxicity.score(docs, toxicity.train(docs, labels)))
    assert len(out) == len(ROWS) and all(0 <= r[2] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r[2] < 0.001 for r in rows(toxicity.score(docs, toxicity.train(docs, none))))
    empty = no_documents(spark)
    assert rows(toxicity.score(empty, toxicity.train(empty, labels))) == []


# 4


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    docs = odd_documents(spark)
    got = sorted(rows(bpe.round_trip(docs, BPE)), key=str)
    want = []
    for doc, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=str)
    encoded = bpe.encode(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), BPE)
    back = dict(rows(bpe.decode(encoded, BPE)))
    assert all(back[doc] == (text or "") for doc, text, *_ in ROWS if doc is not None)
    assert rows(bpe.round_trip(no_documents(spark), BPE)) == []


def test_bpe_splits_like_the_library():
    from tokenizers import Tokenizer

    r, v, full = random.Random(1), bpe.vocabulary(BPE), Tokenizer.from_file(BPE)
    parts = [" ", "  ", "\n", " \n", "a", "the", "'s", "é", "ß", "1", "42", "<|endoftext|>", "<|", "日本", "ՠ", "\u3000", "\u00a0", " \u00a0", "\x1c", "!", "--", "\t"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        ids = [i for w in v.split(text) for i in v.encode([w])[1].tolist()]
        assert ids == full.encode(text, add_special_tokens=False).ids, text


def test_packed_numbers():
    import numpy as np

    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1])
    assert (wordtable.unpack(wordtable.pack(x)) == x).all() and not len(wordtable.unpack(wordtable.pack(x[:0])))


def test_a_bucket_costs_in_proportion_to_its_rows(spark):
    """Numbers that a bucket has gathered aren't copied for every row that brings more."""
    import numpy as np

    copied = 0
    grown, flat = wordtable.Grown(np.int64, 0), []
    for i in range(10_000):
        before = grown.room
        more = np.arange(i % 7)
        grown.extend(more)
        flat += more.tolist()
        copied += 0 if grown.room is before else len(before)
    assert grown.all.tolist() == [0, *flat] and copied < 2 * len(flat)

    class Split(wordtable.Splitter):
        def spread(self, word):
            return 1  # all words in one bucket

    def work():
        return lambda words: (np.array([len(w) % 3 for w in words]), np.array([int(w) for w in words for _ in range(len(w) % 3)]))

    def assemble(values, offsets, packs):
        import pyarrow as pa

        out = [(ids[0][i], values[offsets[c] : offsets[c + 1]].tolist()) for ids, counts, codes in packs for i, c in enumerate(codes)]
        return pa.table({"doc_id": pa.array([x for x, _ in out]), "v": pa.array([v for _, v in out], pa.list_(pa.int32()))})

    # a word a text, a block a text: every block brings new words
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 2000).cast("string").alias("text"))
    got = dict(rows(wordtable.apply(docs, ["doc_id"], "text", Split, work, "int32", "doc_id long, v array<int>", assemble, block_bytes=1)))
    assert got == {i: [i * 37 % 2000] * (len(str(i * 37 % 2000)) % 3) for i in range(3000)}


# 5


def plain_count(model, word):
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        options = [(best[j][0] - model.pieces[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in model.pieces]
        if word[i - 1] not in model.pieces:
            n = len(word[i - 1].encode())
            options.append((best[i - 1][0] - n * model.byte, best[i - 1][1] + n))
        best[i] = min(options)
    return best[-1][1]


def test_trie_counts_equal_plain_ones(spark):
    from tokenizers import Tokenizer, models

    model = unigram.unigram(PIECES)
    words = ["hello", "world", "internationalization", "zzzz", "ñandú", "漢字", "a", "hello!", "helloing", "\U0001f600"]
    r = random.Random(5)
    words += ["".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 14))) for _ in range(400)]
    assert model.counts(words)[1].tolist() == [plain_count(model, unigram.MARK + w) for w in words]
    # the library's own unigram model over the same pieces and scores
    lib = Tokenizer(models.Unigram([("<unk>", -100.0), *model.pieces.items()], unk_id=0))
    ascii_words = [w for w in words if w.isascii()]
    assert [len(lib.encode(unigram.MARK + w).ids) for w in ascii_words] == model.counts(ascii_words)[1].tolist()
    got = sorted(rows(unigram.token_counts(odd_documents(spark), PIECES)), key=str)
    known = {w: plain_count(model, unigram.MARK + w) for _, t, *_ in ROWS for w in set((t or "").split())}
    assert got == sorted(((doc, len((t or "").split()), sum(known[w] for w in (t or "").split())) for doc, t, *_ in ROWS), key=str)
    assert rows(unigram.token_counts(no_documents(spark), PIECES)) == []


def test_very_long_words_need_little_memory():
    model = unigram.Unigram(PIECES)
    r = random.Random(8)
    for n in (63, 64, 65, 200, 3000):
        for letters in ("etaoins", "漢字仮名", "a😀é"):
            word = unigram.MARK + "".join(r.choice(letters) for _ in range(n))
            assert model.count(word) == plain_count_within(model, word)
    nodes = model.nodes
    assert model.count(unigram.MARK + "ab" * 300_000) > 1000 and model.nodes <= nodes + unigram.SHARED


def plain_count_within(model, word):
    """As plain_count, trying no piece longer than there is."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[j][0] - model.pieces[word[j:i]], best[j][1] + 1) for j in range(max(0, i - 64), i) if word[j:i] in model.pieces]
        if word[i - 1] not in model.pieces:
            n = len(word[i - 1].encode())
            options.append((best[i - 1][0] - n * model.byte, best[i - 1][1] + n))
        best.append(min(options))
    return best[-1][1]


# 6


@pytest.mark.parametrize("limit", [10, 100, 1000, 10**9])
def test_shards_fit_and_only_large_buckets_split(spark, limit):
    docs = spark.createDataFrame([(i, "x" * (1 + i * 7 % 50)) for i in range(400)], "doc_id long, text string")
    got = rows(sharding.shards(docs, limit))
    assert len(got) == 400
    sizes, members = defaultdict(int), defaultdict(int)
    for _, size, shard, depth, _ in got:
        assert len(shard) == depth
        sizes[shard] += size
        members[shard] += 1
    assert all(n <= limit or members[s] == 1 for s, n in sizes.items()) and all(r[4] == sizes[r[2]] for r in got)
    total = lambda prefix: sum(n for s, n in sizes.items() if s.startswith(prefix))
    assert all(s == "" or total(s[:-1]) > limit for s in sizes)  # the parent was too large
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)


def test_shards_split_a_hot_id(spark):
    docs = spark.createDataFrame([(1, "x" * 10)] * 300 + [(i, "y" * 10) for i in range(2, 100)], "doc_id long, text string").repartition(4)
    got = rows(sharding.shards(docs, 500))
    sizes = defaultdict(int)
    for r in got:
        sizes[r[2]] += r[1]
    assert len(got) == 398 and max(sizes.values()) <= 500
    assert len(rows(sharding.shards(odd_documents(spark), 1000))) == len(ROWS)
    assert rows(sharding.shards(no_documents(spark), 1000)) == []


# 7


def plain_groups(data, k, percent=80):
    sets = {}
    for doc, text in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    lead = {d: d for d in sets}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in index[g]:
                shared[e] += 1
            index[g].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                lead[max(a, b)] = min(a, b)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_plain_groups(spark, k):
    docs = documents(spark, "/root/testdata/sf0.001")
    got = {r[0]: r[1:] for r in rows(neardup.near_duplicates(docs, k))}
    assert got == plain_groups(rows(docs.select("doc_id", "text")), k)


@pytest.mark.parametrize("most", [0, 10**9])  # clusters are split first, or not
def test_large_clusters_lose_no_link(spark, monkeypatch, most):
    """Chains of texts where only neighbours are linked, in clusters that are dealt out in many blocks."""
    monkeypatch.setattr(neardup, "PROBES", most)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    monkeypatch.setattr(neardup, "MOST", 6)
    base = [f"w{i}" for i in range(400)]
    data = [(1000 + i, " ".join(base[i * 3 : i * 3 + 120])) for i in range(70)]  # neighbours share 117 of 120 words
    data += [(5000 + i, " ".join(base[:200] + [f"u{i}_{j}" for j in range(i % 60)])) for i in range(90)]
    random.Random(2).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r[0]: r[1:] for r in rows(neardup.near_duplicates(docs, 2))} == plain_groups(data, 2)


def test_boilerplate_costs_in_proportion(spark, monkeypatch):
    """Texts that share most of their words, few of which are linked: rows sent to confirm links stay in proportion."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    seen = {}
    written = neardup.Written

    def recorded(df, tag):
        out = written(df, tag)
        seen[tag] = seen.get(tag, 0) + out.rows
        return out

    monkeypatch.setattr(neardup, "Written", recorded)
    shared, n = [f"s{i}" for i in range(140)], 600
    data = [(i, " ".join([*shared, *(f"u{i}_{j}" for j in range(60))])) for i in range(n)]
    data += [(n + i, text.replace("_59", "_x")) for i, text in data[:50]]  # near copies of some
    got = {r[0]: r[1:] for r in rows(neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2))}
    assert got == plain_groups(data, 2)
    assert seen["members"] > 0.9 * len(data)  # one cluster
    assert seen["again"] + seen["probes"] < 2 * len(data) and seen["prefixes"] < 60 * len(data)


def test_broadcasts_are_small_for_the_driver(spark):
    hinted = lambda n: "ResolvedHint" in neardup.small(spark.range(3), n)._jdf.queryExecution().analyzed().toString()
    assert hinted(100_000) and not hinted(250_000)
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    joined = lambda n: components._with_minimum(edges, n)[0]._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in joined(100_000) and "ResolvedHint" not in joined(250_000)


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_MEMBERS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(components, "BROADCAST_NODES", 0)
    base = [f"w{i}" for i in range(200)]
    data = [(i, " ".join(base[i * 3 : i * 3 + 120])) for i in range(20)] + [(100 + i, " ".join(base[:60])) for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r[0]: r[1:] for r in rows(neardup.near_duplicates(docs, 2))} == plain_groups(data, 2)


def test_near_duplicates_odd_rows(spark):
    got = sorted(rows(neardup.near_duplicates(odd_documents(spark), 2)), key=str)
    assert len(got) == len(ROWS)
    by = {r[0]: r for r in got}
    assert by[2][2:] == (1, False) and by[1][2:] == (1, True) and by[8][2:] == (7, False)
    assert by[3][1:] == (0, 3, True) and by[4][1:] == (0, 4, True) and by[5][1:] == (0, 5, True) and by[6][1:] == (1, 6, True)
    assert by[None][2:] == (None, True)
    assert rows(neardup.near_duplicates(no_documents(spark), 2)) == []


@pytest.mark.parametrize("together", [0, 10**6])  # rows that one task takes
def test_components(spark, monkeypatch, together):
    monkeypatch.setattr(components, "ONE_TASK", together)
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    lead = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            lead[max(a, b)] = min(a, b)
    found, _ = components.components(spark.createDataFrame(edges, "a long, b long"))
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert dict(rows(found)) == {x: root(x) for x in touched}


def test_links_that_meet_only_through_a_leader_are_found(spark):
    """The worst geometry: of a text's 200 shingles its first 160 are another's, to which it is linked, and its last 130 a third's, the least id,
    which is 0.65 like the one and 0.45 like the other. What the third leads ties the two all the same."""
    data = []
    for t in range(250):
        words = [f"t{t}w{i}" for i in range(201)]
        data += [(3 * t, " ".join(words[70:])), (3 * t + 1, " ".join(words[:161])), (3 * t + 2, " ".join(words))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k=2, percent=80).collect()}
    linked = sum(got[3 * t + 2] == 3 * t + 1 for t in range(250))
    assert linked >= 248 and all(got[3 * t] == 3 * t for t in range(250))


# 8


def plain_verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=None)
    return host, path, best[1] if best else None, best[2] if best else default


def test_url_rules_equal_plain_ones(spark):
    r = random.Random(4)
    labels = ["com", "net", "example", "www", "a", "b-c", "aa", "EXAMPLE", "é"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "", "block"), ("a.com", "/", "block"), ("b.a.com", "/x", "allow"), ("aa.com", "/", "block"), ("a.net", "/en", "allow")]
    rules += [("a.com", "/x/", "allow"), ("a.com", "/en", "block"), ("a.a.com", "/e", "allow")]  # several on one host, equal lengths
    urls = [None, "", "no scheme", "http://", "http://com", "ftp://a.com/x?y#z", "x://y://a.com/"]
    for _ in range(600):
        urls.append("http" + r.choice([":", "s:"]) + "//" + ".".join(r.choice(labels) for _ in range(r.randint(1, 4))) + r.choice(["", "/", "/en/", "/en/x?q=/", "#top", "?a", "/x/y", "//", "/\n"]))
    urls += ["http://hot.a.com/en/1"] * 300
    data = [(i % 700, u) for i, u in enumerate(urls)] + [(3, "http://a.com/"), (3, "http://a.com/"), (None, "http://a.com/")]
    pages = spark.createDataFrame([(*x, "html", 1, 2) for x in data], "page_id long, url string, html string, rule int, host int").repartition(3)
    got = sorted(rows(urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "allow")), key=str)
    assert got == sorted([(i, *plain_verdict(u, rules, "allow")) for i, u in data], key=str)
    none = spark.createDataFrame([], "page_id long, url string")
    assert rows(urlrules.judge(none, spark.createDataFrame(rules, "host string, path string, verdict string"))) == []
    unruled = urlrules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "block")
    assert {x[4] for x in rows(unruled)} == {"block"}


def test_very_long_hosts_and_paths(spark):
    rules = [("com", "/", "block"), ("a." * 3000 + "com", "/", "allow"), ("x.com", "/" + "p" * 5000, "allow")]
    urls = ["http://" + "a." * 50_000 + "com/", "http://" + "a." * 2999 + "com/z", "http://x.com/" + "p" * 200_000, "http://x.com/" + "p" * 4999, "http://" + "h" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "none"))
    assert sorted(got) == [(i, *plain_verdict(u, rules, "none")) for i, u in enumerate(urls)]


def test_hot_host_that_is_a_rules_host(spark):
    """Its urls fill many ranges, and the rule's own row lies in one of them."""
    rules = [("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]
    urls = [f"http://www.example.com/en/{i}" for i in range(3000)] + [f"http://h{i}.example.com/en/" for i in range(300)] + [f"http://x{i}.net/" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = rows(urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "allow"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == [(i, *plain_verdict(u, rules, "allow")) for i, u in enumerate(urls)]


# 9


def test_schedule_places_every_row_once(spark):
    docs = odd_documents(spark)
    got = rows(mixing.schedule(docs, mixing.tempered(docs), block=2))
    assert len(got) == len(ROWS)
    assert len({(r[3], r[4]) for r in got}) == len(ROWS)  # slot and place
    ordered = mixing.mixed(docs, mixing.tempered(docs), block=2)
    assert ordered.columns == docs.columns and sorted(map(str, ordered.collect())) == sorted(map(str, docs.collect()))
    empty = no_documents(spark)
    assert rows(mixing.schedule(empty, mixing.tempered(empty))) == []


def test_mixing_plan_is_native(spark):
    docs = odd_documents(spark)
    plan = mixing.mixed(docs, mixing.tempered(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10


def plain_spans(text):
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = "(" + "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans_equal_plain_ones():
    r = random.Random(6)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "\u017fecret", "to\u212aen", "=", ":", " = ", '"', "'", "abcdefgh", "xyz", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "\n", "=="]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert credentials.base_spans(text) == plain_spans(text), text


def test_constants_are_propagated():
    text = 'key = "Zx81kQpo93LmTr"\nmid = key\npassword = mid\ncolor = "Zx81kQpo93LmTq"\nAPI_TOKEN => \'q8Kz0Pl2mN4v\'\npwd: "changeme"'
    base, every = credentials.spans(text)
    assert [text[s:e] for s, k, e in every if k == 3] == ["Zx81kQpo93LmTr", "q8Kz0Pl2mN4v"]
    assert set(base) <= set(every)
    clean = credentials.redact(text, every)
    assert "Zx81kQpo93LmTr" not in clean and "Zx81kQpo93LmTq" in clean


def test_scan_rows(spark):
    got = sorted(rows(credentials.scan(odd_documents(spark))), key=str)
    want = []
    for doc, text, *_ in ROWS:
        base, every = credentials.spans(text)
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        want.append((doc, *n, sha(credentials.written(base).encode()), credentials.written(every)))
    assert got == sorted(want, key=str)
    hidden = credentials.redacted(odd_documents(spark))
    by = {r["doc_id"]: r for r in hidden.collect()}
    assert hidden.columns == odd_documents(spark).columns and hidden.count() == len(ROWS)
    assert "hunter2hunter2" not in by[10]["text"] and by[10]["n_chars"] == len(by[10]["text"]) and by[1]["text"] == ROWS[0][1]
    assert rows(credentials.scan(no_documents(spark))) == []
