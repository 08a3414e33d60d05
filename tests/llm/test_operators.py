"""Each operator against brute force or an exact round trip, and its edge cases."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetsieve.llm import byte_bpe, common, components, decontamination, html_text, language_id, line_dedup, ngram_join, ngram_sets, ogg_media, quality, suffix_dedup, token_files

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def text_of(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = text_of(1)
    near = base.replace(base.split()[30], "other")
    long = " ".join(text_of(k, 200) for k in range(150))
    rows = [
        (1, None), (2, ""), (3, "short"), (4, long), (5, long + " end"), (6, base), (7, base), (8, near), (9, "   \n\n "), (10, "A\nb\nsame line of text here\nb"),
        (11, "x\n SAME line of text here \nzz"), (12, "é" * 150 + "漢字 text"), (13, "é" * 150 + "漢字 text!"), (3, "short"), (6, base), (14, "a" * 1000), (15, "%$ 1 2 3"), (16, "tab\tand  double  spaces '  x"),
    ]
    clash = [(i, t, "en", "r", i, "x", [1], 5.0, True) for i, t in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, r string, n_tokens long, `key` string, cells array<int>, component_id double, keep boolean")


@pytest.fixture(scope="module")
def no_id(spark, odd):
    return odd.unionByName(odd.where("doc_id = 6").limit(1).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < 0")


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# ---- 8


def test_byte_bpe_equals_tiktoken(odd, no_id, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    wanted = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode_documents(odd.withColumnRenamed("n_tokens", "n"), keep_ids=True).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == wanted.encode_ordinary(r["text"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(no_id).count() == 19
    assert byte_bpe.encode_documents(empty).count() == 0


def test_byte_bpe_long_pretoken_and_lower_ranks():
    # "ab" has a rank, and so has "bab" at a lower one: a merge may give a pair that goes first
    ranks = {bytes([i]): i for i in range(256)} | {b"ba": 256, b"bab": 257, b"ab": 258, b"abab": 259, b"aa": 260}
    encoder = byte_bpe.Encoder(ranks)

    def slow(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(3)
    pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40))) for _ in range(400)] + [b"ab" * 30, b"a" * 41]
    for many in (1, 10**9):
        byte_bpe.MANY, kept = many, byte_bpe.MANY
        got = encoder.encode(pieces)
        byte_bpe.MANY = kept
        # a whole piece that has a rank is one id
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[ranks[p]] if p in ranks else slow(p) for p in pieces]


def test_what_workers_remember_is_bounded_in_bytes():
    import public_tokenizers as P

    # texts without spaces: each chunk is a document
    texts = ["".join(chr(0x4E00 + random.Random(k).randrange(3000) + i % 7) for i in range(30_000)) for k in range(40)]
    c = byte_bpe.Codec(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    byte_bpe.CACHE_BYTES, kept = 100_000, byte_bpe.CACHE_BYTES
    for i in range(0, 40, 4):
        c.encode(["x " + t for t in texts[i : i + 4]])
        assert sum(map(len, c.known)) <= 100_000 + 4 * 30_010
    byte_bpe.CACHE_BYTES = kept
    w = token_files.WordTokens(P.path("word_bpe_49k.json"))
    token_files.CACHE_BYTES, kept = 100_000, token_files.CACHE_BYTES
    for i in range(0, 40, 4):
        w.encode(texts[i : i + 4])
        assert sum(map(len, w.rows)) <= 100_000 + 4 * 30_010
    token_files.CACHE_BYTES = kept
    for cache in (ngram_sets.word_hashes, quality._places):
        cache.clear()
        cache[b"x" * 1000], cache[b"short"]
        assert list(cache) == [b"short"]


def test_rank_queue_order():
    q = byte_bpe.RankQueue(300_000)
    r = random.Random(0)
    ranks = r.sample(range(300_000), 500)
    for rank in ranks:
        q.add(rank, [2, 1])
    popped = []
    while (e := q.pop()) is not None:
        popped.append(e[0])
        assert e[1] == [1, 2]
    assert popped == sorted(ranks)


# ---- 3


def test_token_files_round_trip(spark, odd, no_id, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = common.fresh_path(spark, "files")
    token_files.write_token_files(no_id, path)
    got = token_files.read_token_files(spark, path, keep_ids=True).orderBy("start").collect()
    rows = sorted(plain(odd), key=lambda r: r[0])
    # a document without an id comes first
    assert [r["doc_id"] for r in got] == [None, *(i for i, _ in rows)]
    start = 0
    texts = dict(rows) | {None: text_of(1)}
    for r in got:
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    path = common.fresh_path(spark, "files")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_words_of_all_kinds():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), token_files.WordTokens(path, cache=300)
    r = random.Random(11)
    letters = ["a", "B", "Ñ", "ö", "İ", "Σ", "ß", "漢", "ａ", "e\u0301", "½", "Ⅷ", "7", "'", "'s", "-", "...", "$", "\t", "\u00a0", "\x00", "🙂", "ǅ", "ª", "\u200b"]
    texts = ["".join(r.choice(letters + [" ", "\n"] * 4 + ["word", "Ende"]) for _ in range(r.randrange(80))) for _ in range(600)] + ["x" * 500 + " " + "漢字" * 400]
    for i in range(0, len(texts), 40):  # what is remembered is forgotten between some of them
        ids, counts = own.encode(texts[i : i + 40])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts[i : i + 40]]


def test_words_meet_python_once_a_batch():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    class Counted(token_files._Rows):
        looked = 0

        def __getitem__(self, word):
            Counted.looked += 1
            return super().__getitem__(word)

    path = P.path("word_bpe_49k.json")
    own, t = token_files.WordTokens(path), Tokenizer.from_file(path)
    own.rows = Counted()
    texts = ["Der Été, the end.\nthe Été 7's " * 500] * 4 + [""]
    for _ in range(2):
        Counted.looked = 0
        ids, counts = own.encode(texts)
        assert Counted.looked == 7  # the distinct words (the empty one among them), not 14,000
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_control_bytes():
    codes = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    control, data = token_files.pack(codes)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    assert (token_files.unpack(control, data, 9) == codes).all()


# ---- 9


def test_ogg_media(odd, empty):
    for r in ogg_media.media_features(ogg_media.media_column(odd)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert ogg_media.media_features(ogg_media.media_column(empty)).count() == 0
    bad = ogg_media.media_column(odd).withColumn("media", F.when(F.col("doc_id") == 1, F.lit(None)).when(F.col("doc_id") == 2, F.lit(b"OggS")).otherwise(F.col("media")))
    found = {r["doc_id"]: r for r in ogg_media.media_features(bad).collect()}
    assert found[1]["error"] == "no media" and found[2]["error"] and found[2]["payload_bytes"] is None
    assert all(r["error"] is None and r["feature"] for i, r in found.items() if i > 2)


def test_ogg_rules():
    media, _ = ogg_media.store("word " * 30000)
    streams = ogg_media.demultiplex(media)
    assert len(streams) == 2
    for bad in (media[:-1], media[1:], media[:40] + bytes([media[40] ^ 1]) + media[41:], media[:5]):
        with pytest.raises(ogg_media.BadMedia):
            ogg_media.read_back(bad)
    crc = 0
    for b in b"OggS check":
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert ogg_media.page_checksum(b"OggS check") == crc
    # a packet of a multiple of 255 bytes over several pages
    big = bytes(255 * 600)
    pages = ogg_media.pages_of([(b"head", 0), (big, len(big))], 7)
    assert ogg_media.demultiplex(b"".join(pages))[7][1] == (big, len(big))


# ---- 10


def brute_contamination(docs, items):
    out = []
    for i, t in docs:
        w = decontamination.words_of(t)
        hit, names = set(), set()
        for name, s in items:
            p = decontamination.words_of(s)
            m = min(10, len(p))
            windows = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if p else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    names.add(str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination(spark, odd, empty):
    base = text_of(1)
    words = base.split()
    items = [(1, " ".join(words[5:20])), (2, "short"), (3, None), (4, ""), (10, " ".join(words[40:50]).upper() + "."), (5, " ".join(words[8:17])), (6, "漢字 text"), (7, base + " " + base), (2, "short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.contamination(odd, bench).collect())
    assert got == brute_contamination(plain(odd), dict(items).items())
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(odd, bench.where("item_id < 0")).where("contaminated").count() == 0
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in got if not r[5])


def test_contamination_in_passes(spark, odd, monkeypatch):
    """A benchmark of many blocks gives what one block gives."""
    words = text_of(1).split()
    items = [(k, " ".join(words[k : k + 12])) for k in range(0, 40, 3)] + [(100, "short"), (101, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in decontamination.contamination(odd, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    assert decontamination.blocks(bench) > 2
    assert sorted(tuple(r) for r in decontamination.contamination(odd, bench).collect()) == whole
    assert whole == brute_contamination(plain(odd), dict(items).items())
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not r[5] for r in whole)


def test_wu_manber_random():
    r = random.Random(5)
    for length in (1, 2, 3, 5):
        patterns = {tuple(r.randrange(1, 4) for _ in range(length)): [0] for _ in range(3)}
        found = decontamination.WuManber(patterns, length)
        ids = [r.randrange(0, 4) for _ in range(300)]
        assert [s for s, _ in found.find(ids)] == [k for k in range(300 - length + 1) if tuple(ids[k : k + length]) in patterns]


# ---- 6


def brute_lines(docs, least=10):
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = line_dedup.key_of(x, least)
            if k:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := line_dedup.key_of(x, least)) is None or len(holders[k]) < 2 or i == min(holders[k])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines(odd, no_id, empty):
    assert sorted(tuple(r) for r in line_dedup.report(odd).collect()) == brute_lines(plain(odd))
    assert line_dedup.report(no_id).count() == 19
    assert line_dedup.report(empty).count() == 0
    assert line_dedup.drop_lines(odd).columns == odd.columns


def test_line_index_is_reversible(spark, odd, tmp_path):
    one, two = odd.where("doc_id <= 8"), odd.where("doc_id > 8")
    line_dedup.LineIndex(spark, 3).insert(one).save(str(tmp_path / "index"))
    state = line_dedup.LineIndex.open(spark, str(tmp_path / "index"))
    assert state.shards == 3
    both = state.insert(two)
    assert sorted(tuple(r) for r in line_dedup.report(odd, both).collect()) == brute_lines(plain(odd))
    again = both.insert(two)
    assert again.references.agg(F.sum("n_docs")).first()[0] == both.references.agg(F.sum("n_docs")).first()[0]
    undone = both.delete(two.select("doc_id"))
    tables = lambda s: sorted((bytes(r["key"]), r["n_docs"], r["first_doc"]) for r in s.references.collect())
    assert tables(undone) == tables(state)
    assert sorted(tuple(r) for r in line_dedup.report(one, undone).collect()) == brute_lines(plain(one))
    # without the first holder the next one keeps the line
    rest = odd.where("doc_id <> 6")
    assert sorted(tuple(r) for r in line_dedup.report(rest, both.delete(spark.createDataFrame([(6,)], "doc_id long"))).collect()) == brute_lines(plain(rest))


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 2**64, 20_000, np.uint64)
    f = line_dedup.CuckooFilter.sized(len(names))
    assert f.insert(names[:15_000]) and f.contains(names[:15_000]).all()
    assert f.contains(names[15_000:]).mean() < 0.01
    f.delete(names[:5_000])
    assert f.contains(names[5_000:15_000]).all() and f.contains(names[:5_000]).mean() < 0.01
    assert not line_dedup.CuckooFilter(np.zeros((4, 4), np.uint16)).insert(names[:40])


# ---- 1


def brute_links(docs, width, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, set(ngram_sets.ngrams(t, width).tolist()))
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_sets():
    assert len(ngram_sets.ngrams("A b\tC\x0bd", 3)) == 2
    assert (ngram_sets.ngrams("a B c d", 3) == ngram_sets.ngrams("A b  C d", 3)).all()
    assert len(ngram_sets.ngrams("one two", 3)) == 1 and len(ngram_sets.ngrams(" \n", 3)) == 0 and len(ngram_sets.ngrams(None, 3)) == 0
    assert ngram_sets.ngrams("a b", 3) != ngram_sets.ngrams("b a", 3)
    assert len(ngram_sets.ngrams("é x", 1)) == 1  # only ASCII white space parts words


def test_part_enum_loses_no_pair():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        scheme = ngram_sets.PartEnum(percent / 100)
        for turn in range(600):
            n = int(rng.integers(1, 300 if turn % 2 else 16))
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            b = a[rng.random(len(a)) > rng.random() * 0.25]
            b = np.unique(np.concatenate((b, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 10)), np.uint64))))
            if len(b) and ngram_sets.jaccard_at_least(a, b, percent):
                assert np.intersect1d(scheme.sign(a), scheme.sign(b)).size
                both = scheme.band(max(len(a), len(b)))  # the band of the larger set is one that both list
                heads = []
                for items in (a, b):
                    names, filled, must = scheme.listing(items, both)
                    heads.append(names[np.lexsort((names, filled == 0))[:must]])
                assert np.intersect1d(*heads).size


def test_links(spark, odd, no_id, empty):
    r = random.Random(7)
    rows = plain(odd)
    base = text_of(50, 120).split()
    for k in range(40):  # a loose group: a common base with different edits
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 9])):
            words[r.randrange(len(words))] = f"w{r.randrange(1000)}"
        rows.append((100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80)):
        # all pairs of a bucket at once, or leaders and finer parts
        for cross in (ngram_join.CROSS, 0):
            ngram_join.CROSS, kept = cross, ngram_join.CROSS
            got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.link(docs, width, percent).collect()}
            ngram_join.CROSS = kept
            assert got == brute_links(rows, width, percent)
    assert ngram_join.link(empty).count() == 0
    assert ngram_join.link(no_id).count() == 19
    one = ngram_join.keep_one(odd, 3, 90)
    assert one.columns == odd.columns
    assert {x["doc_id"] for x in one.collect()} == {i for i, (_, c) in brute_links(plain(odd), 3, 90).items() if i == c}


def test_batches_of_copies(spark):
    docs = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), F.lit(text_of(3)).alias("text"))
    assert ngram_join.signatures_of(docs, 3, 90).select("node").distinct().count() == 1
    assert ngram_join.signatures_of(docs.limit(0), 3, 90).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, 5), (5, 7), (7, 100), (200, 200)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 10 for k in range(10, 61)) and got[100] == got[7] == got[5] == 5
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 4


def brute_suffix(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        if i in out:
            continue
        raw = (t or "").encode()
        gone = np.zeros(len(raw), np.int8)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = 1
            else:
                seen.add(s)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[gone == 0])).hexdigest())
    return out


def test_suffix_dedup(spark, odd, no_id, empty):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [x for x in plain(odd) if len(x[1] or "") < 5000]
    for k in range(30):
        a = r.randrange(300)
        rows.append((200 + k, text_of(k, 20) + passage[a : a + r.randrange(60, 400)] + text_of(k + 99, 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (8000, 2):
        suffix_dedup.CROWDED, kept = crowd, suffix_dedup.CROWDED
        got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.dedup(docs).collect()}
        suffix_dedup.CROWDED = kept
        assert got == brute_suffix(rows)
    assert suffix_dedup.dedup(no_id).count() == 18
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_order():
    r = random.Random(0)
    for _ in range(150):
        n, need = r.randrange(1, 300), r.choice([1, 2, 5, 12, 40])
        s = np.array([r.randrange(1, r.choice([2, 3, 9]) + 1) for _ in range(n)])
        order, _ = suffix_dedup.suffix_order(s, need)
        heads = [tuple(s[i : i + need]) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)


def test_cells_over_stretches():
    raw = ("abc" * 100_000).encode() + b"x" * 300
    names, firsts, sizes = suffix_dedup.cells_of(raw)
    assert sizes.sum() == len(raw) - 99 and (firsts + sizes)[:-1].tolist() == firsts[1:].tolist() and sizes.max() <= 69


# ---- 2

PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav>{0}<footer>&copy; foot</footer></body></html>"


def test_html(spark):
    rows = [
        (1, "http://a.org/x/1", PAGE.format("<div class='ad'>buy</div><article><h1>One &amp; two</h1><p>First\n para<br>next <b>bold</b></p><p>Shared</p></article><div id=comments>nice</div>")),
        (2, "http://a.org/x/2", PAGE.format("<article><p>Shared</p></article>")),
        (3, "http://b.org/1", PAGE.format("<div>Welcome to our site</div><p>Own text of three</p><div>Call now</div>")),
        (4, "http://b.org/2", PAGE.format("<div>Welcome to our site</div><p>Own text of page four</p><div>Call now</div>")),
        (5, "http://c.org/1", PAGE.format("<p>Copied text</p>")),
        (6, "http://c.org/2", PAGE.format("<p>Copied text</p>")),
        (7, None, None),
        (8, "odd", "<p>unclosed <i>text <p class=cookie-notice>we use cookies <p>more &lt; less<!-- gone"),
        (9, "http://d.org", ""),
        (9, "http://d.org", ""),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {
        1: "One & two\nFirst para\nnext bold\nShared", 2: "Shared", 3: "Own text of three", 4: "Own text of page four",
        5: "Copied text", 6: "Copied text", 7: "", 8: "unclosed text\nmore < less", 9: "",
    }
    assert html_text.extract(pages).count() == 10 and html_text.extract(pages.where("page_id < 0")).count() == 0
    assert html_text.extract(pages).where("n_chars <> char_length(text)").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_html_templates_and_copies(spark, parts):
    long = "".join(f"<div>Template line {k} of the whole site, on every page</div>" for k in range(6))
    body = "<p>A quoted passage that two pages share, longer than what either has of its own</p>"
    rows = [(k, f"http://a.org/{k}", PAGE.format(f"{long}<p>Own {k}</p>")) for k in range(10, 14)]  # short pages in a long template
    rows += [(20 + k, "http://b.org/1", PAGE.format("<div>Menu</div><p>A page crawled nine times over</p>")) for k in range(9)]  # copies fill whole parts
    rows += [(30, "http://b.org/2", PAGE.format("<div>Menu</div><p>Another page of this host</p>"))]
    rows += [(40, "http://c.org/1", PAGE.format(f"{body}<p>First</p>")), (41, "http://c.org/2", PAGE.format(f"{body}<p>Second</p>"))]  # near copies
    rows += [(k, f"http://c.org/{k}", PAGE.format(f"<p>Something else {k}</p>")) for k in (42, 43, 44)]
    rows += [(50, "http://d.org/1", PAGE.format("<main><h1>Heading</h1><article><p>Teaser</p></article><p>Body</p></main><div>Outside</div>"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    passage = body[3:-4]
    assert got == {
        **{k: f"Own {k}" for k in range(10, 14)}, **{20 + k: "A page crawled nine times over" for k in range(9)}, 30: "Another page of this host",
        40: f"{passage}\nFirst", 41: f"{passage}\nSecond", **{k: f"Something else {k}" for k in (42, 43, 44)}, 50: "Heading\nTeaser\nBody",
    }


@pytest.mark.parametrize("parts", [1, 7])
def test_html_articles_are_differenced(spark, parts):
    notice, quoted = "<p>Read more of our stories in the app</p>", "<p>A passage that neighbours quote</p>"
    article = lambda k, more="": PAGE.format(f"<article><h1>Title {k}</h1><p>Own text of page number {k}, longer than the notice</p>{more}{notice}</article><div>Outside</div>")
    rows = [(k, f"http://a.org/{k}", article(k, quoted * (k in (12, 13)))) for k in range(10, 18)]
    rows += [(20 + k, "http://a.org/17", article(17)) for k in range(5)]  # copies of the last
    rows += [(k, f"http://b.org/{k}", article(k)) for k in range(30, 37)]  # too few pages to tell
    rows += [(k, f"http://c.org/{k}", PAGE.format(f"<article><p>One text, with changes in its last words</p><p>{k}</p></article>")) for k in range(40, 50)]  # near copies
    rows += [(50, "http://d.org/a", PAGE.format("<article><p>A story</p></article>")), (51, "http://d.org/b", PAGE.format("<p>A story</p><p>More of it than the story itself</p>"))]
    rows += [(60, "http://e.org/a", "<div class=ad>Buy it</div><p>A review</p>"), (61, "http://e.org/b", "<p>Buy it</p><p>is what they told us</p>")]  # text like an advert
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = lambda k: f"Title {k}\nOwn text of page number {k}, longer than the notice"
    assert got == {
        **{k: own(k) + f"\n{quoted[3:-4]}" * (k in (12, 13)) for k in range(10, 18)}, **{20 + k: own(17) for k in range(5)},
        **{k: f"{own(k)}\n{notice[3:-4]}" for k in range(30, 37)}, **{k: f"One text, with changes in its last words\n{k}" for k in range(40, 50)},
        50: "A story", 51: "A story\nMore of it than the story itself",
        60: "A review", 61: "Buy it\nis what they told us",
    }


def test_html_of_any_kind_in_linear_time():
    bad = ["<b x " * 200_000, "<b x " * 200_000 + '"', "<div>" * 150_000 + "</x>" * 150_000, "<p><div>" + "<b>" * 80_000 + "<div></div>" * 80_000, "</script " * 90_000 + "<script>" + "</script " * 90_000, "<a \"' " * 100_000]
    for page in bad:
        began = time.process_time()
        html_text.blocks_of(page)
        assert time.process_time() - began < 5
    assert html_text.blocks_of('<a title="x > y">one</a> < two <b class=\'q">\'>three</b>') == [("one < two three", 0)]
    assert html_text.blocks_of('<div class="layout no-sidebar"><p>Text</p></div><div class="left-sidebar">gone</div>') == [("Text", 0)]
    assert html_text.blocks_of("<nav>x<p>menu</nav>a<b class=ad>buy</b> b<p>c", marked=True) == [("x", -1), ("menu", -1), ("a b", 0), ("buy", -1), ("c", 0)]
    assert html_text.blocks_of("a<!-- gone <p>b") == [("a", 0)] and html_text.blocks_of("a <p title='b") == [("a <p title='b", 0)]


def test_common_lines():
    r = random.Random(1)
    for _ in range(60):
        a, b = [r.choice("abcd") for _ in range(r.randrange(12))], [r.choice("abcd") for _ in range(r.randrange(12))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert len(html_text.common_lines(a, b)) == table[-1, -1]


# ---- 5


def test_language(spark, sf_dir, odd, empty):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).join(docs, "doc_id").toPandas()
    for _, r in got.iterrows():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    assert {f for f in language_id.Model(["en"], np.zeros((language_id.PLACES, 1), np.float32), np.zeros(1)).score(["½ ² Ⅷ ① 7", "%"])} == {("und", 0.0)}
    assert found[1] == found[2] == found[9] == found[15] == ("und", 0.0) and found[3][0] in set(got["lang"])
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.fit(odd.where("doc_id in (3, 6)")).languages in ([], ["en"])
    # rows that repeat a doc_id are one document, and a rare language is learned
    rare = docs.where("lang = 'de'").limit(8).select("doc_id", "text", F.lit("xx").alias("lang"))
    often = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(300)).select("doc_id", "text", "lang"))
    assert np.array_equal(language_id.fit(often).weights, model.weights)
    assert "xx" in language_id.fit(docs.join(rare.select("doc_id"), "doc_id", "left_anti").unionByName(rare), sample=40).languages


# ---- 7


def test_quality(spark, sf_dir, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.fit(docs, labels.where("doc_id % 3 > 0"))
    assert model.thresholds[0] < model.thresholds[1]
    held = quality.rate(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    toxic, good = held[held["toxic"] == 1], held[(held["toxic"] == 0) & (held["quality"] == 1)]
    # few labels at this size, and many inflected words: held-out grades are in order, and learned ones are told
    assert good["keep"].mean() > 0.9 and toxic["keep"].mean() < good["keep"].mean() - 0.3
    assert toxic["expected_grade"].mean() < good["expected_grade"].mean() - 0.3
    learned = quality.rate(docs, quality.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert learned[learned["toxic"] == 1]["keep"].mean() < 0.05
    assert learned[(learned["toxic"] == 0) & (learned["quality"] == 1)]["keep"].mean() > 0.98
    assert quality.rate(odd, model).count() == 18 and quality.rate(empty, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    none = quality.fit(odd, labels.where("doc_id < 0"))
    assert quality.rate(odd, none).where("keep").count() == 18
    nulls = spark.createDataFrame([(3, None, 1), (6, 1, None), (None, 1, 1), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.fit(odd, nulls).thresholds) == 0


def test_quality_on_unseen_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.fit(docs, labels.where("doc_id % 3 > 0"))
    held = quality.rate(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    toxic, good = held[held["toxic"] == 1], held[(held["toxic"] == 0) & (held["quality"] == 1)]
    assert (~toxic["keep"]).mean() > 0.8 and good["keep"].mean() > 0.95
    assert toxic["expected_grade"].mean() < good["expected_grade"].mean() - 0.8
    # inflected words of each language are told, not those of the commonest one alone
    assert (toxic.groupby("lang")["keep"].mean() < 0.2).all()


def test_quality_learns_from_one_row_of_each_document(spark):
    rows = [(i, f"{'foul' if i % 2 else 'fair'} words {WORDS[i % 18]}") for i in range(1, 41)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    once = quality.fit(docs, labels, sample=40)
    # one document of the lowest grade repeated beyond any multiple of the sample
    again = docs.where("doc_id = 1").crossJoin(spark.range(400)).select("doc_id", "text")
    often = quality.fit(docs.unionByName(again), labels, sample=40)
    assert np.isfinite(often.thresholds).all() and np.array_equal(once.weights, often.weights) and np.array_equal(once.thresholds, often.thresholds)
    assert quality.rate(docs, often).where("keep <> (doc_id % 2 = 0)").count() == 0


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        k = rng.integers(0, 40, 12)
        score = (k < 8).sum() - (k >= 32).sum()
        rows.append(np.unique(k).astype(np.int32))
        grades.append(int(np.digitize(score + rng.logistic(), [-1.5, 1.5])))
    m = quality.fit_ordinal(rows, np.array(grades))
    assert m.weights[:8].mean() > 0.3 and m.weights[32:40].mean() < -0.3 and m.thresholds[0] < m.thresholds[1]
