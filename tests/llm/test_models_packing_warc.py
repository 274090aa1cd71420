import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm import packing as K
from tidemark.llm import quality_classifier as C
from tidemark.llm import sentencepiece_fst as T
from tidemark.llm import warc as W

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  two  blanks\n\nñ中 ﬁ\t​😀", "<|endoftext|> text", "'s 12 ..!", "word " * 20_000, "é" * 3000, "a", "▁ x"]


def odd_docs(spark):
    return spark.createDataFrame([*enumerate(ODD), (None, "null id"), (3, "a")], "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("ids", F.lit("clash"))


def test_rule_ensemble_learns_and_compiles(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, len(C.FEATURES)))
    y = ((x[:, 2] > 0.4) & (x[:, 4] <= 0.5)).astype(float)
    model = C.RuleEnsemble.fit(x[:2000], y[:2000])
    assert 0 < len(model.rules) < 150
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[2000:]], C.FEATURES)
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    total = model.intercept + sum(w * C.applies(k, x[2000:]) for k, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got >= 0.5) == y[2000:]).mean() > 0.97


def test_classifier_scores_every_row_and_never_learns_from_held_out_rows(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)) + ".", "### $$$ " * 30
    rows = [(i, (good if i % 3 else bad) + str(i)) for i in range(300)] + [(None, None), (5, ""), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = C.score(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.held_out]) > 0.95
    flipped = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [r.score for r in C.score(docs, flipped).collect()] == [r.score for r in got]
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and 180 <= kept.count() <= 220
    assert C.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in C.score(docs, labels.limit(0)).collect()} == {1.0}


def test_scores_equal_a_plain_version_of_the_whole_query(spark):
    """Statistics, sample, fit and rules in plain Python, over the small table."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in C.score(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).collect()}
    known = sorted((i for i in quality if i in texts and not held(i)), key=lambda i: (order[i], i))[: C.SAMPLE_ROWS]
    model = C.RuleEnsemble.fit(np.array([C.statistics(texts[i]) for i in known]), np.array([float(quality[i]) for i in known]))
    assert len(got) == len(texts)
    for i, t in texts.items():
        x = C.statistics(t)
        total = model.intercept + sum(w for rule, w in model.rules if all(x[f] <= cut if op == "<=" else x[f] > cut for f, op, cut in rule))
        score = 1 / (1 + np.exp(-total))
        assert abs(got[i].score - score) < 1e-9 and got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.3)


def test_held_out_accuracy_on_the_small_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = C.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_tokens_equal_the_tokenizer(spark):
    tokens = K.ByteTokens.load(BPE)
    assert tokens.merger is not None
    for t in [x or "" for x in ODD] + [" " * 12_000 + "a"]:
        assert tokens.encode(t).tolist() == tokens.model.encode(t, add_special_tokens=False).ids


def test_packing_places_each_id_once_without_padding(spark):
    pieces = K.pack_documents(odd_docs(spark), BPE, capacity=256, block_bytes=30_000, with_ids=True).toPandas()
    model = K.ByteTokens.load(BPE).model
    want = Counter((i, *model.encode(t or "", add_special_tokens=False).ids, K.END) for i, t in [*enumerate(ODD), (None, "null id"), (3, "a")])
    got = Counter()
    for _, p in pieces.fillna({"doc_id": -1}).sort_values("start").groupby(["doc_id", "doc_tokens"]):
        copies = int((p["start"] == 0).sum())
        assert p["length"].sum() == copies * p["doc_tokens"].iloc[0]
        ids = np.frombuffer(b"".join(p.drop_duplicates("start")["ids"]), dtype="<u4")
        got[(None if p["doc_id"].iloc[0] < 0 else int(p["doc_id"].iloc[0]), *ids.tolist())] += copies
    assert got == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces.itertuples())
    assert K.padding(pieces, 256) == 0
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 256
    assert K.pack_documents(odd_docs(spark).limit(0), BPE).count() == 0


def packed_by_search(lengths, capacity):
    """The same rule, every sequence asked for every piece."""
    room = K.bins(sum(lengths), capacity)
    size, cost, out = list(room), [0.0] * len(room), []
    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            some = [i for i, r in enumerate(room) if r >= length - start] or [i for i, r in enumerate(room) if r]
            i = min(some, key=lambda i: (cost[i], i))
            n = min(length - start, room[i])
            out.append((doc, start, n, i, size[i] - room[i]))
            room[i], cost[i], start = room[i] - n, cost[i] + K.LINEAR * n + K.QUADRATIC * n * n, start + n
    return out


def test_pack_equals_a_search_of_all_sequences():
    rng = np.random.default_rng(8)
    for k in range(60):
        capacity = int(rng.choice([1, 7, 64, 256]))
        lengths = sorted((rng.geometric(1 / rng.integers(1, 3 * capacity + 2), int(rng.integers(0, 120)))).tolist(), reverse=True)
        assert K.pack(lengths, capacity) == packed_by_search(lengths, capacity)
    assert K.pack([], 8) == []
    lengths = sorted(rng.lognormal(6, 1.1, 1500).astype(int).clip(1, 30_000).tolist(), reverse=True)
    assert K.pack(lengths, 2048) == packed_by_search(lengths, 2048)


def test_equal_rows_spread_over_blocks(spark):
    docs = spark.range(10_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    pieces = K.pack_documents(docs, BPE, block_bytes=40 * K.ROW_BYTES)
    sizes = [r.n for r in pieces.groupBy(F.shiftright("sequence_id", 24).alias("block")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and len(sizes) > 200 and max(sizes) < 120


def test_ids_of_the_whole_small_table_equal_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = K.ByteTokens.load(BPE).model
    want = {r.doc_id: zlib.crc32(np.array([*model.encode(r.text or "", add_special_tokens=False).ids, K.END], dtype="<u4").tobytes()) for r in docs.collect()}
    got = {}
    for r in sorted(K.pack_documents(docs, BPE, with_ids=True).collect(), key=lambda r: r.start):
        got[r.doc_id] = zlib.crc32(r.ids, got.get(r.doc_id, 0))
    assert got == want


def test_pack_balances_costs():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 900, 4000).tolist(), reverse=True)
    pieces = K.pack(lengths, 2048)
    cost = Counter()
    for _, _, n, i, _ in pieces:
        cost[i] += K.LINEAR * n + K.QUADRATIC * n * n
    full = [c for i, c in cost.items() if i < sum(lengths) // 2048]
    assert np.std(full) / np.mean(full) < 0.05
    assert len(pieces) < len(lengths) + len(cost) + 1


def test_transducer_equals_the_library_and_round_trips(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = T.encode(odd_docs(spark), PIECES).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        t = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r["ids"] == lib.encode(t) and r.n_ids == len(r["ids"]) and r.round_trip == (lib.decode(r["ids"]) == t)
    back = {r.doc_id: r.text for r in T.decode(spark.createDataFrame(got), PIECES).collect()}
    assert back[4] == ODD[4] and back[0] == ""
    assert T.encode(odd_docs(spark).limit(0), PIECES).count() == 0


def test_transducer_on_random_texts():
    import random

    import sentencepiece

    lib, t, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), T.Transducer.load(PIECES), random.Random(8)
    for _ in range(1500):
        x = "".join(rng.choice("abthe ing ▁Zé中\n\t'9.!ﬁ😀") for _ in range(rng.randrange(40)))
        assert t.encode(x).tolist() == lib.encode(x), repr(x)
        assert t.decode(t.encode(x)) == lib.decode(lib.encode(x))


def machine(pieces, kind, prefix=False, squeeze=False):
    own = object.__new__(T.Transducer)
    own.prefix = prefix
    own.compile({p: i for i, p in enumerate(pieces)}, list(pieces.values()), [None] * 256, [p.replace(T.SPACE, " ") for p in pieces], kind, T.Normaliser(prefix, squeeze, True))
    return own


def every_path(own, symbols, at=0):
    """All paths of the composition, whatever they weigh."""
    return [[]] if at == len(symbols) else [[(label, w), *rest] for end, label, w in own.arcs(symbols, at) for rest in every_path(own, symbols, end)]


def test_unigram_path_is_the_least_of_all_paths_of_the_composition():
    own = machine({"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -2.7, "aba": -6.0}, T.UNIGRAM)
    for s in ("a", "ab", "aba", "abab", "babab", "aabba", "axb", "xx"):
        weigh = lambda p: sum(w for _, w in p)
        least = min(map(weigh, every_path(own, s)))
        assert sum({i: -w for i, w in enumerate(own.score)}.get(x, own.lost) for x in own.shortest(s)) == pytest.approx(least)


def test_merge_machine_has_one_finite_path_that_of_merging():
    import random

    rng = random.Random(3)
    for _ in range(40):  # merges as a trainer finds them: each piece of two earlier ones
        pieces = {c: -100.0 for c in "abc"}
        while len(pieces) < 16:
            pieces.setdefault(rng.choice(list(pieces)) + rng.choice(list(pieces)), -float(len(pieces)))
        own = machine(pieces, T.MERGES)
        plain = machine(pieces, T.MERGES)
        plain.odd = set(pieces)
        for _ in range(40):
            s = "".join(rng.choice("abcabcx") for _ in range(rng.randrange(1, 10)))
            finite = [p for p in every_path(own, s) if all(plain._beside(x[0], y[0]) for x, y in zip(p, p[1:]))]
            assert [[own._label(x) for x, _ in p] for p in finite] == [own.merged(s)]
            assert own.labels(s) == own.merged(s) == plain.labels(s)


def test_arcs_between_pieces_equal_merging_both():
    import random

    t, rng = T.Transducer.load(PIECES), random.Random(4)
    assert t.kind == T.MERGES and len(t.odd) < 20
    names = [i for p, i in t.pieces.items() if p in t.splits]
    short = [i for i in names if len(t._label(i)) < 4]
    pairs = [(rng.choice(short if k % 2 else names), rng.choice(short if k % 3 else names)) for k in range(20_000)]
    pairs += [(a, b) for p in t.odd for a in (t.pieces[p],) for b in rng.sample(names, 50)]
    pairs += [(b, a) for a, b in pairs[-200:]]
    wrong = [(a, b) for a, b in pairs if t._beside(a, b) != (t.merged(t._label(a) + t._label(b)) == [t._label(a), t._label(b)])]
    assert not wrong


def test_normaliser_writes_what_the_model_says():
    texts = ["", " ", "a", "  a  b ", "a\n b", "   "]
    for prefix in (False, True):
        for squeeze in (False, True):
            for text in texts:
                want = " ".join(x for x in text.split(" ") if x) if squeeze else text
                want = (" " + want if prefix and want else want).replace(" ", T.SPACE)
                assert T.Normaliser(prefix, squeeze, True).read(text, T.Normaliser.START) == want


def test_squeezing_machine_encodes_chunk_by_chunk_what_it_reads_as_a_whole():
    own = machine({"a": -1.0, "b": -2.0, T.SPACE: -3.0, f"{T.SPACE}a": -1.5, "ab": -1.2}, T.UNIGRAM, True, True)
    for text in ["", " ", "   ab", "a  b ", "  ab a   a", "b"]:
        whole = own.shortest(own.normaliser.read(text, T.Normaliser.START))
        assert own.encode(text).tolist() == whole
        assert own.decode(own.encode(text)) == " ".join(text.split())


def test_every_text_of_the_small_table_equals_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: lib.encode(r.text or "") for r in docs.collect()}
    for r in T.encode(docs, PIECES).collect():
        assert r["ids"] == want[r.doc_id]
    texts = {r.doc_id: r.text for r in T.decode(T.encode(docs, PIECES), PIECES).collect()}
    assert all(texts[k] == lib.decode(v) for k, v in want.items())


PAGES = [(1, "http://a", "x" * 1200), (2, None, None), (None, "http://c", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 3), (4, "u\r\nx", "x" * 1200), (4, "u", "x" * 1200), (5, "q", ""), (6, "é", "é" * 600), (7, "z", "y" * 999), (8, "z", "y" * 999), (9, "big", "z" * 500_000)]


def test_warc_round_trip_and_revisits(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = W.write_warc(df)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in W.read_warc(spark, path).collect())
    want = sorted((i or 0, len((h or "").encode()), "revisit" if i == 1 else "response", 4 if i == 1 else 0) for i, _, h in PAGES)
    assert got == want
    assert W.read_chain(spark, path).where("broken is not null").count() == 0
    assert W.read_warc(spark, W.write_warc(df.limit(0))).count() == 0
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in W.read_warc(spark, W.write_warc(df)).collect()) == want


def test_chain_rejects_records_inside_payloads_and_tells_where_it_breaks(spark, tmp_path):
    whole = b"".join(W.record(i, u, (h or "").encode(), len((h or "").encode()), "d", None) for i, u, h in PAGES)
    (tmp_path / "a.warc").write_bytes(whole)
    assert len(list(W.candidates(whole))) == len(PAGES) + 3
    assert W.read_warc(spark, f"file://{tmp_path}").count() == len(PAGES)
    cut = whole.index(b"urn:page:5") - 40
    (tmp_path / "a.warc").write_bytes(whole[:cut] + b"garbage" + whole[cut:])
    left = W.read_chain(spark, f"file://{tmp_path}").collect()
    assert len(left) < len(PAGES) and all(r.broken for r in left)
    with pytest.raises(Exception, match="break off"):
        W.read_warc(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.warc").write_bytes(b"garbage" + whole)
    assert [(r.record, r.broken) for r in W.read_chain(spark, f"file://{tmp_path}").collect()] == [(False, 0)]
    with pytest.raises(Exception, match="break off"):
        W.read_warc(spark, f"file://{tmp_path}").collect()


def test_pointer_jumping_marks_the_chain():
    at, after = np.array([0, 10, 15, 25, 40, 47]), np.array([10, 25, 25, 40, 60, 60])
    marked, end = W.reachable(at, after, 60)
    assert marked.tolist() == [True, True, False, True, True, False] and end == 60
    assert not W.reachable(np.array([3]), np.array([9]), 9)[0].any()
