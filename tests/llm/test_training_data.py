"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelspark.llm import audio, id_files, line_dedup, main_text, near_dedup, packing, quality_classifier, quality_rules, registry, sentence_pieces, token_counts, tokens
from panelspark.llm.shared import table

from . import brute
from .brute import components

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three four"), (6, "One two THREE four"), (7, LONG), (8, LONG + " tail"), (9, LONG),
    (10, "same line here that is long enough to count as one whole passage of text by itself, with well over a hundred characters\nx"),
    (11, "same line here that is long enough to count as one whole passage of text by itself, with well over a hundred characters\ny"),
    (12, "don't  stop it's <|endoftext|> <|startoftext|>'re ###&&& 日本語 é ▁ 😀"), (12, "a second row of one id"), (13, "twice"), (13, "twice"), (None, "no id"), (14, "l1\nl2\nl3"), (15, "l0\nl1\nl2\n\nl3"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(d, t, "en", "s", len(t or ""), 1, 2) for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, pos int")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def test_audio(spark, edge):
    got = audio.digests(audio.stored_media(edge)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = {d: t for d, t in EDGE if d not in (12, 13)}.get(r.doc_id)
        if r.doc_id in (12, 13):
            continue
        raw = (text or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        import hashlib

        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.media_sha256 == hashlib.sha256(audio.wav(raw)).hexdigest() and r.pcm_bytes == 4 * len(raw)
    assert audio.digests(audio.stored_media(edge.limit(0))).count() == 0
    pcm = audio.pcm(audio.stored_media(edge.where("doc_id = 4"))).first().pcm
    assert np.frombuffer(pcm, "<i2")[0] == audio.EXPANDED[7][ord("a")]


def test_resampled_pcm_is_stored(spark, edge):
    import hashlib

    got = audio.digests(audio.stored_media(edge))
    assert any("/pcm-" in f for f in got.inputFiles())
    payload = bytes(np.random.default_rng(4).integers(0, 256, 640, dtype=np.uint8))
    media = spark.createDataFrame([(law, 640, bytearray(audio.wav(payload, law))) for law in (6, 7, 17)], "doc_id bigint, n_bytes bigint, media binary")
    data = np.frombuffer(payload, np.uint8)
    want = {law: audio.resampled(x, 8000, 16000).astype("<i2").tobytes() for law, x in ((6, audio.EXPANDED[6][data]), (7, audio.EXPANDED[7][data]), (17, audio.adpcm(data).ravel()))}
    kept = audio.pcm(media)
    assert any("/pcm-" in f for f in kept.inputFiles()) and {r.doc_id: bytes(r.pcm) for r in kept.collect()} == want
    assert {r.doc_id: (r.pcm_bytes, r.pcm_sha256) for r in audio.digests(media.where("doc_id < 8")).collect()} == {k: (len(want[k]), hashlib.sha256(want[k]).hexdigest()) for k in (6, 7)}


def test_packed_samples_come_back():
    g = np.random.default_rng(9)
    for n in (0, 1, 2, 3, 64, 641):
        x = g.integers(-32768, 32768, n).astype(np.int16)
        assert audio.unpacked(audio.packed(x)) == x.astype("<i2").tobytes()
    y = audio.resampled(audio.EXPANDED[7][g.integers(0, 256, 640, dtype=np.uint8)], 8000, 16000)
    assert not np.frombuffer(audio.packed(y), "<i2")[640:].any()  # the odd samples lie between their neighbours


def test_tables_and_feature_by_the_standard(spark):
    """G.711 by its bit fields, resampling sample by sample, and the feature from these."""

    def mu(code):
        code = 255 - code
        size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33
        return 4 * (-size if code & 128 else size)

    def a_law(code):
        code ^= 0x55
        step, low = code >> 4 & 7, code & 15
        size = 2 * low + 1 if step == 0 else (2 * low + 33) << (step - 1)
        return 8 * (size if code & 128 else -size)

    assert audio.EXPANDED[7].tolist() == [mu(c) for c in range(256)] and audio.EXPANDED[6].tolist() == [a_law(c) for c in range(256)]
    x = [mu(c) for c in b"some words to hear, and then a few more of them in the same row!"]
    want = [v for i, a in enumerate(x) for v in (a, (a + x[min(i + 1, len(x) - 1)]) // 2)]
    assert audio.resampled(np.array(x, np.int16), 8000, 16000).tolist() == want
    text = "some words to hear, and then a few more of them in the same row!"
    frame = spark.createDataFrame([(1, text, "x", 5)], "doc_id bigint, text string, media string, planes int")
    got = dict(p.split("=") for p in audio.digests(audio.stored_media(frame)).first().feature.split())
    root = lambda v: int((sum(a * a for a in v) // len(v)) ** 0.5)
    assert got["samples"] == "64" and got["peak"] == str(max(map(abs, x))) and got["rms"] == str(root(x)) and got["other_rms"] == str(root([a_law(c) for c in text.encode()]))
    assert got["crossings"] == str(sum((p < 0) != (q < 0) for p, q in zip(x, x[1:])))


def test_adpcm_one_block_at_a_time():
    data = np.random.default_rng(1).integers(0, 256, 640, dtype=np.uint8)
    assert (audio.adpcm(data) == np.concatenate([audio.adpcm(data[k : k + 64]) for k in range(0, 640, 64)])).all()
    block = data[:64]
    now, index, want = int(block[:2].view("<i2")[0]), min(int(block[2]), 88), []
    want.append(now)
    for b in block[4:]:
        for nibble in (int(b) & 15, int(b) >> 4):
            step = int(audio.IMA_STEPS[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            now = max(-32768, min(32767, now - change if nibble & 8 else now + change))
            index = max(0, min(88, index + int(audio.IMA_INDEX[nibble & 7])))
            want.append(now)
    assert audio.adpcm(block)[0].tolist() == want


def test_token_counts(spark, edge, docs):
    lib = tokens.library(BYTES)
    for frame in (edge, docs):
        text = [r.text for r in frame.collect()]
        got = token_counts.token_counts(frame, BYTES).collect()
        assert sorted(r.n_tokens for r in got) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for t in text)
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_token_counts_fuzz():
    random.seed(3)
    parts = ["'s", "'re", "'r", "'ll", "'l", "'", " ", "  ", "\n", "\t", " ", "a", "é", "日本", "12", "!?", "<|endoftext|>", "<|endof", "ing", "The", "x́", "😀", "\x1c", "\x85", "²", "zzzz"]
    text = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(5000)]
    raw = [t.encode() for t in text]
    starts = np.cumsum([0, *map(len, raw)])
    got = token_counts.counts(np.frombuffer(b"".join(raw), np.uint8), starts, BYTES)
    assert got.tolist() == [len(x.ids) for x in tokens.library(BYTES).encode_batch_fast(text, add_special_tokens=False)]


def test_states_compose_in_any_chunking():
    g = np.random.default_rng(2).integers(0, 10, (40, token_counts.CHUNK))
    state, want = token_counts.S0, []
    for chunk in g:
        want.append(state)
        for c in chunk:
            state = int(token_counts._TO[state, c])
    assert token_counts.states_before(g).tolist() == want


def test_line_dedup(spark, edge, docs):
    for frame in (edge.where("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        rows = {r.doc_id: r.text for r in frame.collect()}
        seen1, seen2, gone = set(), set(), {d: set() for d in rows}
        for d in sorted(rows):
            lines = [(i, x) for i, x in enumerate((rows[d] or "").split("\n")) if x.strip(" \t\r\f\v")]
            for k, (i, x) in enumerate(lines):
                if x in seen1 and len(x) >= 100:
                    gone[d].add(i)
                seen1.add(x)
                if k + 1 < len(lines):
                    pair = (x, lines[k + 1][1])
                    if pair in seen2:
                        gone[d] |= {i, lines[k + 1][0]}
                    seen2.add(pair)
        for r in line_dedup.deduplicated(frame).collect():
            want = None if rows[r.doc_id] is None else "\n".join(x for i, x in enumerate(rows[r.doc_id].split("\n")) if i not in gone[r.doc_id])
            assert (r.text, r.n_removed) == (want, len(gone[r.doc_id])), r.doc_id


def test_line_dedup_edges(spark, edge):
    assert line_dedup.deduplicated(edge).count() == len(EDGE) and line_dedup.deduplicated(edge.limit(0)).count() == 0
    out = line_dedup.without_repeated_lines(edge)
    assert out.columns == edge.columns and out.where("doc_id = 9").count() == 0 and out.where("doc_id in (1, 2, 3)").count() == 3
    assert not [n for n in ("Python", "Pandas", "Arrow") if n in line_dedup.deduplicated(edge)._jdf.queryExecution().executedPlan().toString()]


def test_line_dedup_against_all_pairs_of_suffixes(spark):
    """Runs of any length and overlap: few different lines, so that most repeat."""
    g = random.Random(7)
    docs = [(d, "\n".join(g.choice(["a", "b", "c", " ", "long " * 30]) for _ in range(g.randint(0, 25)))) for d in range(40)]
    docs += [(40, None), (41, ""), (42, docs[3][1]), (43, docs[3][1] + "\nz"), (44, "z\n" + docs[5][1])]
    for min_lines in (2, 3):
        got = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string"), min_lines)
        assert {r.doc_id: (r.text, r.n_removed, r.longest_run) for r in got.collect()} == brute.without_copies(docs, min_lines)


def test_line_dedup_of_long_runs(spark):
    """Lengths are exact, and text is put together in time linear in the lines."""
    lines = [f"line {i}" for i in range(5000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x", *lines[100:103], "y"])), (3, "\n".join([*lines, "end"])), (4, "\n".join(lines[::2]))]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[d].longest_run for d in (1, 2, 3, 4)] == [0, 3, 5000, 0] and got[2].text == "x\ny" and got[3].text == "end" and got[4].text == rows[3][1]


def test_line_dedup_with_clashing_names(spark):
    rows = [("a", "x\ny", 1, 2, 3, "r"), ("b", "x\ny\nz", 4, 5, 6, "s"), ("b", "x\ny\nz", 7, 8, 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, d int, e int, lines int, row string")
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], ("b", "z", 4, 5, 6, "s"), ("b", "z", 7, 8, 9, "t")]


def test_rule_counts(spark, edge, docs):
    for frame in (edge, docs):
        want = sorted(brute.rule_counts(r.text) for r in frame.collect())
        got = quality_rules.scored(frame).collect()
        assert sorted((r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.kept or not r.base_failed) for r in got)
    assert quality_rules.scored(edge.limit(0)).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.scored(docs).where("kept").collect()}


def test_posterior_is_that_of_em_by_document(spark, docs):
    import pyarrow as pa

    from panelspark.llm.blocks import blocks

    batch = pa.RecordBatch.from_pydict({"doc_id": [r.doc_id for r in docs.collect()], "text": [r.text for r in docs.collect()]})
    rows = [v for _, data, starts in blocks(iter([batch])) for v in quality_rules.votes(quality_rules.statistics(data, starts)).tolist()]
    want = dict(zip(batch.column(0).to_pylist(), brute.em(rows), strict=True))
    got = {r.doc_id: r for r in quality_rules.scored(docs).collect()}
    assert all(abs(got[d].posterior - p) < 1e-6 and got[d].kept == (not got[d].base_failed and p >= 0.5) for d, p in want.items())


def test_one_bad_vote_is_not_a_verdict(spark):
    """The posterior keeps documents that an all-must-pass filter rejects: here many repeated lines, and nothing else."""
    got = quality_rules.scored(table(spark, DATA, "documents")).where("not base_failed and n_dup_lines > 0.3 * n_lines and n_symbols = 0")
    assert got.count() > 0 and got.where("not kept").count() == 0


def test_rules_take_any_column_names(spark, edge):
    odd = edge.select("*", F.lit(1).alias("votes"), F.lit(2).alias("base_failed"), F.lit(3).alias("c0"))
    assert quality_rules.kept_documents(odd).columns == odd.columns and quality_rules.kept_documents(odd.limit(0)).count() == 0


def test_rules_agree_with_labels(spark):
    got = quality_rules.scored(table(spark, DATA, "documents")).where("not base_failed").join(table(spark, DATA, "labels"), "doc_id")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("kept").count() <= 0.1 * bad.count()


def test_classifier(spark, edge):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    out = quality_classifier.scored(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out.collect())
    assert quality_classifier.scored(edge, labels).where("score is null").count() == 0
    assert {r.score for r in quality_classifier.scored(edge, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.scored(edge.limit(0), labels).count() == 0


def test_scores_one_document_at_a_time(spark, docs):
    """Scores, and what the pipeline's stage keeps, by the fitted model's weights on each text alone."""
    labels = table(spark, SMALL, "labels")
    m = quality_classifier.trained(docs, labels)
    want = {}
    for d, text in [(r.doc_id, r.text) for r in docs.collect()]:
        raw = (text or "").encode()
        places, _ = quality_classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        x = [float(m["scale"][p]) for p in sorted(set(places.tolist()))]
        norm = max(sum(v * v for v in x) ** 0.5, 1e-9)
        margin = sum(v / norm * float(m["weight"][p]) for v, p in zip(x, sorted(set(places.tolist())), strict=True)) + float(m["weight"][-1])
        want[d] = 1 / (1 + np.exp(-(m["slope"] * margin + m["shift"])))
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == (want[r.doc_id] >= 0.3) for r in quality_classifier.scored(docs, labels).collect())
    assert {r.doc_id for r in quality_classifier.kept_documents(docs, labels).collect()} == {d for d, p in want.items() if p >= 0.3}


def test_classifier_learns_from_the_least_of_repeated_rows(spark, docs):
    labels = table(spark, SMALL, "labels")
    twice = docs.union(docs.withColumn("text", F.lit("another text"))).repartition(7)
    a, b = (quality_classifier.trained(x, labels) for x in (twice, twice.repartition(3)))
    assert (a["weight"] == b["weight"]).all() and a["shift"] == b["shift"]


def test_descent_reaches_the_least_hinge_loss():
    """The dual steps end where slow subgradient steps on the primal do."""
    g = np.random.default_rng(3)
    x = g.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + g.normal(size=60) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w[:5] + w[5]))).sum()
    full = quality_classifier.descent([np.arange(5)] * 60, list(x), y, cost, epochs=3000)
    got = np.append(full[:5], full[-1])
    w, best = np.zeros(6), np.inf
    for k in range(20_000):
        active = (y * (x @ w[:5] + w[5]) < 1) * cost * y
        w = w - (w - np.append(active @ x, active.sum())) / (k + 20)
        best = min(best, loss(w))
    assert abs(loss(got) - best) < 0.01 * best


def test_descent_separates():
    rows = [np.array([i % 2, 2 + i]) for i in range(40)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    w = quality_classifier.descent(rows, [np.ones(2)] * 40, y, np.ones(40))
    assert all(np.sign(w[r].sum() + w[-1]) == t for r, t in zip(rows, y))


def test_sentence_pieces(spark, edge, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for frame in (edge, docs):
        got = sentence_pieces.encoded_pieces(frame, PIECES)
        assert sorted(list(r.ids) for r in got.collect()) == sorted(lib.encode(r.text or "") for r in frame.collect())
    back = sentence_pieces.decoded(sentence_pieces.encoded_pieces(docs, PIECES), PIECES)
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in docs.collect())
    assert sentence_pieces.piece_digests(docs, PIECES).where("n_differing > 0 or not round_trip").count() == 0


def test_ids_are_those_of_the_rebuilt_backend(monkeypatch):
    """Another result of the sentencepiece library is counted, and does not replace the backend's ids."""
    import sentencepiece

    raw = [t.encode() for t in ("A plain text of some words.", "naïve café 日本")]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    sentence_pieces._coder.cache_clear()
    want, _, differ, _ = sentence_pieces.pieces_of(data, starts, PIECES)
    assert not differ.any()
    right = sentencepiece.SentencePieceProcessor.encode
    other = lambda self, x, **k: [0, *right(self, x, **k)] if isinstance(x, str) else [[0, *y] for y in right(self, x, **k)]
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", other)
    sentence_pieces._coder.cache_clear()
    got, _, differ, _ = sentence_pieces.pieces_of(data, starts, PIECES)
    sentence_pieces._coder.cache_clear()
    assert got.tolist() == want.tolist() and differ.all()


def test_unigram_backend_of_a_model():
    """A unigram model's pieces by the rebuilt backend: the best-scoring cut, and bytes for what no piece covers."""
    pieces = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("c", -2.5, 1)]
    model = {"pieces": pieces, "type": 1, "byte_fallback": True, "charsmap": b"", "dummy_prefix": True, "extra_blanks": False, "escape": True, "suffix": False}
    assert sentence_pieces.backend(model).encode("abc a", add_special_tokens=False).tokens == ["▁ab", "c", "▁", "a"]
    assert sentence_pieces.cuts_apart(model)


def test_id_files(spark, edge, docs):
    lib = tokens.library(WORDS)
    for frame in (edge.dropDuplicates(["doc_id"]), docs):
        rows = sorted(((r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in frame.collect()), key=lambda x: (x[0] is not None, x[0]))
        shards = id_files.write_ids(frame, WORDS)
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in id_files.read_ids(shards).collect()}
        start = 0
        for d, ids in rows:
            assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        asked = spark.createDataFrame([(r[0],) for r in rows[:20]] + [(10**15,)], "doc_id bigint")
        found = {r.doc_id: r.ids for r in id_files.ids_of(spark, shards, asked).collect()}
        assert all(found[d] == ids for d, ids in rows[:20] if d is not None) and found[10**15] is None
    assert id_files.written_and_read(edge, WORDS).count() == len(EDGE) and id_files.written_and_read(edge.limit(0), WORDS).count() == 0


def test_id_files_keyed_by_text_and_across_shards(spark):
    """Keys that are text; a key that fills several shards gives its first row; the least whole number is a key as any."""
    lib = tokens.library(WORDS)
    for kind, keys in (("string", ["b", "a", None, "c", "日本"]), ("bigint", [-(1 << 63), 5, None, 7, 9])):
        rows = [(keys[k % 5] if k < 200 else keys[3], f"text number {k} " * 2000, k) for k in range(400)]
        frame = spark.createDataFrame(rows, f"doc_id {kind}, text string, path int").coalesce(1)
        shards = id_files.write_ids(frame, WORDS, shard_bytes=1 << 20)
        assert shards.count() > 5
        first = {}
        for d, t, _ in rows:
            first.setdefault(d, [*lib.encode(t, add_special_tokens=False).ids, 1])
        asked = spark.createDataFrame([(k,) for k in keys] + [("zz" if kind == "string" else 6,)], f"doc_id {kind}")
        got = {r.doc_id: r.ids for r in id_files.ids_of(spark, shards, asked).collect()}
        assert got == {k: first[k] for k in keys if k is not None} | {"zz" if kind == "string" else 6: None}
        assert id_files.written_and_read(frame, WORDS).groupBy("doc_id").count().count() == 5


def test_keyed_access_reads_a_few_bytes():
    import pyarrow as pa

    for n in (10, 200_000):
        raw = id_files._index_bytes(pa.array(range(n), pa.int64()), np.full(n, 7), 2)
        took = []
        index = id_files.Lookup(lambda at, size: took.append(size) or raw[at : at + size])
        head = len(took)
        assert [index.find(k) for k in (0, n - 1, n)] == [(0, 7), (7 * (n - 1), 7), (-1, -1)]
        assert sum(took[head:]) < 3 * 12 * 72


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    store = tokens.Store(lambda words: [[len(w), ord(w[0])] for w in words])
    for text in (b"aa b cc b aa", b"cc dd aa", b"b"):
        data = np.frombuffer(text, np.uint8)
        words = text.split()
        begin = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        ids, at = store.lists(store.of(data, begin, begin + [len(w) for w in words]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[len(w), w[0]] for w in words]


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    assert token_counts.token_counts(none, BYTES).count() == sentence_pieces.piece_digests(none, PIECES).count() == sentence_pieces.encoded_pieces(none, PIECES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_minimal_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    h = id_files.MinimalHash.built(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))


@pytest.mark.parametrize("seed", range(20))
def test_packing_plan(seed):
    g = random.Random(seed)
    counts = {g.randint(1, 100): g.randint(1, 50) for _ in range(g.randint(1, 60))}
    plan = packing.planned(counts, 100)
    used: dict = {}
    for parts, n in plan:
        assert n > 0 and sum(a * m for a, m in parts) <= 100
        for a, m in parts:
            used[a] = used.get(a, 0) + m * n
    room: list = []  # plain best fit, longest first
    for a in sorted((a for a, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in room if r >= a]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 100) - a)
    assert used == counts and sum(n for _, n in plan) <= len(room)


@pytest.mark.parametrize("most", [1500, 4096])
def test_packing_of_many_lengths(most):
    """Random counts at all lengths, within half a percent of what any plan needs."""
    counts = dict(enumerate(np.random.default_rng(most).integers(1, 100_000, most).tolist(), 1))
    plan = packing.planned(counts)
    used: Counter = Counter()
    for parts, n in plan:
        assert sum(x * m for x, m in parts) <= 4096
        for x, m in parts:
            used[x] += m * n
    assert used == counts and sum(n for _, n in plan) <= 1.005 * brute.sequences_needed(counts, 4096)
    assert any(sum(m for _, m in parts) == 4 and sum(x * m for x, m in parts) == 4096 for parts, _ in plan)


def test_exact_complements():
    # a gap of 48: best fit takes 21 and 20; 20, 17 and 11 fill it
    assert packing.planned({52: 2, 21: 2, 20: 2, 17: 2, 11: 2}, 100)[0] == ([(52, 1), (20, 1), (17, 1), (11, 1)], 2)
    # a gap of 40: best fit takes 33; 25 and 15 fill it
    assert packing.planned({60: 3, 33: 1, 25: 2, 15: 5}, 100)[0] == ([(60, 1), (25, 1), (15, 1)], 2)
    assert packing.planned({}, 100) == [] and packing.planned({100: 7}, 100) == [([(100, 1)], 7)]
    assert packing.planned({1: 250}, 100) == [([(1, 100)], 2), ([(1, 50)], 1)]


def test_packing(spark, edge, docs):
    lib = tokens.library(WORDS)
    for frame in (edge, docs):
        got = packing.packed(frame, WORDS, limit=512).toPandas()
        want: Counter = Counter()
        for r in frame.collect():
            ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
            cuts = [np.array(ids[a : a + 512], "<u4") for a in range(0, len(ids), 512)]
            want.update((r.doc_id, k, 512 * k, len(cut), zlib.crc32(cut)) for k, cut in enumerate(cuts))
        key = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert Counter(tuple(None if x != x else int(x) for x in row) for row in got[key].itertuples(index=False)) == want
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all() and ordered.groupby("sequence_id").length.sum().max() <= 512
    assert packing.packed(edge.limit(0), WORDS).count() == 0


def test_near_duplicates(spark, edge, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = components(rows)
    for r in near_dedup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    got = near_dedup.near_duplicates(edge).collect()
    by = {r.doc_id: r for r in got if r.doc_id not in (12, 13)}
    assert len(got) == len(EDGE) and by[9].component_id == by[8].component_id == 7 and by[6].component_id == 5 and by[1].n_shingles == by[3].n_shingles == 0 and by[2].kept
    assert near_dedup.near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_of_families(spark):
    """Copies with edits, truncated copies and a shared passage: links on both sides of the threshold."""
    g = random.Random(11)
    word = lambda: "".join(g.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(70)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(g.randint(0, 9)):
            w[g.randrange(len(w))] = word()
        rows.append(w)
    rows += [base[: g.randint(80, 150)] for _ in range(60)] + [passage + [word() for _ in range(g.randint(5, 120))] for _ in range(60)]
    data = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = components(data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == want


def test_pairs_beside_a_hub_of_short_texts(spark):
    """No link is left out before the check on full sets: 400 pairs of 3 and 4, or 9 and 12, shingles, each beside a hub."""
    g = random.Random(5)
    word = lambda: "".join(g.choices("abcdefgh", k=6))
    rows = []
    for k in range(400):
        w = [word() for _ in range(8 if k % 2 else 16)]
        rows += [(3 * k, " ".join(w[: 7 if k % 2 else 13])), (3 * k + 1, " ".join(w)), (3 * k + 2, " ".join(word() for _ in range(14)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = near_dedup._marked(docs)
    nodes = docs.mapInArrow(near_dedup._described(near_dedup.ROWS), "doc_id bigint, n_shingles bigint, high bigint, low bigint, bands array<bigint>, sketch array<bigint>, left bigint, right bigint")
    nodes = nodes.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "bands", "sketch", F.struct("doc_id", "left", "right").alias("text")).persist()
    known = nodes.select(F.expr("rep div 3").alias("bucket"), "node", "size", F.col("node").alias("component"), "rep")
    hubs = known.where("rep % 3 = 2").select("bucket", F.col("node").alias("hub"), F.col("size").alias("hub_size"))
    known, out = known.drop("rep"), known.where("rep % 3 < 2").drop("rep")
    found = near_dedup._beside(near_dedup._sets(docs, nodes), nodes, known, out, hubs, 75)
    of = {r.node: r.rep for r in nodes.collect()}
    got = {tuple(sorted((of[r.node], of[r.one]))) for r in found.collect()}
    assert got == {(3 * k, 3 * k + 1) for k in range(400)}


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,2)", "string", "date"])
def test_near_duplicates_keep_the_order_of_ids(spark, kind):
    words = " ".join(f"word{i}" for i in range(30))
    rows = [(9, words), (10, words), (100, words + " more"), (11, "quite another text of some seven words"), (None, words + " more"), (12, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.expr("date_add(date'2020-01-01', doc_id)") if kind == "date" else F.col("doc_id").cast(kind))
    got = near_dedup.near_duplicates(frame)
    assert dict(got.dtypes)["doc_id"] == dict(got.dtypes)["component_id"] == kind
    least = frame.agg(F.min(F.when(F.col("text").startswith("word0"), F.col("doc_id")))).first()[0]
    of = {r.doc_id: r.component_id for r in got.collect()}
    linked = [r.doc_id for r in frame.where("text like 'word0%'").collect()]
    assert {of[d] for d in linked} == {least} and all(of[d] == d for d in of if d not in linked)
    kept = near_dedup.one_of_each(frame)
    assert kept.schema == frame.schema and kept.count() == 3


def test_near_duplicates_of_null_ids_are_linear(spark):
    """Thousands of rows without an id, and with one id: each meets its own node only."""
    rows = [(None if k % 2 else 7, " ".join(f"a{k // 2}b{j % 9 if j < 20 else k}x{j}" for j in range(25))) for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = near_dedup._marked(frame)
    described, nodes = near_dedup._joined_up(marked, 75, near_dedup.ROWS)
    assert described.count() == 4000 and nodes.count() == 4000
    chosen = marked.mapInArrow(near_dedup._described(near_dedup.ROWS), "doc_id bigint, n_shingles bigint, high bigint, low bigint, bands array<bigint>, sketch array<bigint>, left bigint, right bigint")
    chosen = chosen.select(F.monotonically_increasing_id().alias("node"), F.struct("doc_id", "left", "right").alias("text"))
    assert near_dedup._sets(marked, chosen).count() == 4000


def test_main_text(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Menu</ul></nav><div class='ad banner'>Buy</div><article><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four&nbsp;&lt;x&gt;<section class=comments><p>Nice!</section></article><footer>F</footer>"
    rows = [(1, "http://h.example/a", page), (2, "http://h.example/b", None), (3, None, ""), (4, "http://h.example/c", page + "<p"), (1, "http://h.example/a", page), (5, "x", "plain < text\n more")]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    text = "A & B\n\nOne two three\n\nFour <x>"
    assert [(r.page_id, r.text) for r in got] == [(1, text), (1, text), (2, ""), (3, ""), (4, text), (5, "plain < text more")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_style_tree_cuts_repeated_neutral_branches(spark):
    rows = [(i, f"http://one.example/{i}", f"<body><div class='top'><span>Welcome to our site</span></div><div class='body'><p>Text number {i} is its own {i * 7}.</div></body>") for i in range(20)]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r.text == f"Text number {r.page_id} is its own {r.page_id * 7}." for r in got)


@pytest.mark.parametrize("before, after", [
    ('<body class="home has-sidebar"><article>', "</article></body>"), ('<article class="post comments-open">', "</article>"), ('<main class="social-science">', "</main>"),
    ('<div class="share-story"><article>', "</article></div>"), ('<form id="aspnetForm"><article>', "</article></form>"),
])
def test_names_around_an_article_do_not_cut_it(spark, before, after):
    for n in (1, 30):
        rows = [(i, f"http://h.example/{i}", f"<html>{before}<h1>Title</h1><p>Text {i}, and more of it.</p><section class='comments'><p>Nice {i}!</p></section>{after}<div class='ad'>Buy {i}</div></html>") for i in range(n)]
        got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert len(got) == n and all(r.text == f"Title\n\nText {r.page_id}, and more of it." for r in got)


def test_boilerplate_names_around_a_whole_page_say_nothing(spark):
    text = "<h1>Title {}</h1><p>Text {}, and more of it.</p>"
    quote = "<aside class='pullquote'><p>Quote {} of it</p></aside>"
    shapes = [
        (f"<div class='promo-page'><div class='promotion'>{text}</div></div>", "Title {}\n\nText {}, and more of it."),
        (f"<form class='search'>{text}</form>", "Title {}\n\nText {}, and more of it."),
        (f"<article>{text}{quote}</article><aside><p>See also {{}}</p></aside>", "Title {}\n\nText {}, and more of it.\n\nQuote {} of it"),
        ("<nav class='menu'><ul><li>Home</ul></nav>", ""),
    ]
    for n in (1, 30):
        rows = [(100 * k + i, f"http://h{k}.example/{i}", f"<html><body>{page}</body></html>".replace("{}", str(i))) for k, (page, _) in enumerate(shapes) for i in range(n)]
        got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {100 * k + i: want.replace("{}", str(i)) for k, (_, want) in enumerate(shapes) for i in range(n)}


def test_articles_that_every_page_repeats_stay(spark):
    rows = [(i, f"http://h.example/{i % 2}", "<body><nav><ul><li>Home<li>News</ul></nav><article><h1>A</h1><div><p>One and the same text.</p></div></article><footer>Us</footer>") for i in range(40)]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in got} == {"A\n\nOne and the same text."}


def test_style_tree_against_one_node_at_a_time(spark):
    g = random.Random(9)
    pages = []
    for i in range(120):
        parts = "".join(f"<p>{g.choice(['a b', 'c', str(i) * 9])}</p>" for _ in range(g.randint(1, 4)))
        pages.append((i, f"http://{g.choice('xyz')}.example/{i}", f"<html><body><ul>{'<li>m' * g.randint(1, 3)}</ul><div class='{g.choice(['s', 't'])}'>{parts}</div></body></html>"))
    read = main_text.read_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    rows = read.select("host", F.explode("nodes").alias("x")).select("host", "x.path", "x.style", "x.share", "x.texts")
    got = {(r.host, r.path): r.importance for r in main_text.importance(rows).collect()}
    want = brute.tree_importance([(main_text._host(u), main_text.nodes_of(h)) for _, u, h in pages])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_main_text_edges(spark):
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(60_000)) + "</article>"
    docs = spark.createDataFrame([("p", "http://h.example/", long, 1, 2, "x"), ("p", "http://h.example/", long, 1, 2, "x"), (None, None, None, 3, 4, "y")], "page_id string, url string, html string, row int, host int, nodes string")
    got = main_text.main_text(docs).collect()
    want = "\n\n".join(f"word {i}" for i in range(60_000))
    assert sorted((r.page_id or "", r.text) for r in got) == [("", ""), ("p", want), ("p", want)]
    assert main_text.main_text(docs.limit(0)).count() == 0


def test_the_tree_alone_gives_the_verdict_on_the_given_pages(spark):
    """What elements are called decides no block of the given pages that the entropies do not decide alike."""
    rows = main_text.read_pages(table(spark, DATA, "pages")).select("host", F.explode("nodes").alias("x")).select("host", "x.path", "x.style", "x.share", "x.texts")
    blocks = rows.select("host", "path", F.explode("texts").alias("t")).join(main_text.importance(rows), ["host", "path"])
    alone, final = F.col("importance") >= main_text.LOW, F.col("importance") + main_text.NAMED * F.col("t.worth") >= main_text.LOW
    assert blocks.where(alone == final).count() >= 0.9 * blocks.count() > 0


def test_pages(spark):
    got = registry.op7_main_text(spark, SMALL).collect()
    assert len(got) == table(spark, SMALL, "pages").count() and all(r.text and "<p>" not in r.text for r in got)


def test_every_operator_is_registered():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).persist()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    want = sum(len(x) for x in ([*tokens.library(WORDS).encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).agg(F.sum("length")).first()[0] == want


def _stage_rows(spark, frame):
    """What each stage must keep of `frame`, by brute force: rows as tuples of (doc_id, text, other)."""
    import pyarrow as pa

    from panelspark.llm.blocks import blocks

    rows = [tuple(r) for r in frame.collect()]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r[1] for r in rows], pa.string())})
    votes = [v for _, data, starts in blocks(iter([batch])) for v in quality_rules.votes(quality_rules.statistics(data, starts)).tolist()]
    counts = [brute.rule_counts(r[1]) for r in rows]
    base = [c[4] >= 50 and 100 * c[3] <= 50 * c[4] for c in counts]
    kept = [r for r, ok, p in zip(rows, base, brute.em(votes) if rows else [], strict=True) if ok and p >= 0.5]
    return rows, kept


EDGE_ROWS = [
    (5, "A " * 3 + "the same text of some words and more", "x"), (5, "A " * 3 + "the same text of some words and more", "y"), (7, "A " * 3 + "the same text of some words and more", "x"),
    (7, "quite another text that no other row has here", "z"), (8, None, "n"), (9, "", "e"), (9, "", "e"), (10, " \n ", "w"), (None, "a text without any id of its own at all", "i"),
    (11, "l1\nl2\nl3", "l"), (12, "l0\nl1\nl2\nl3", "l"), (13, LONG, "v"), (14, LONG + " tail", "v"),
]


def test_pipeline_stages_row_by_row(spark):
    """The stages over edge rows, against brute force."""
    from collections import Counter

    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    frame = spark.createDataFrame(EDGE_ROWS, "doc_id bigint, text string, node string")
    rows, want = _stage_rows(spark, frame)
    assert sorted(map(repr, stages["quality_rules"](spark, frame, SMALL).collect())) == sorted(repr(r) for r in frame.collect() if tuple(r) in want)
    # near duplicates: of each group of linked rows the one of least doc_id stays, once; rows without words all stay
    got = Counter((r.doc_id, r.text) for r in stages["minhash_near_dedup"](spark, frame, SMALL).collect())
    texts = sorted({t for _, t, _ in rows if t and t.split()})
    group = brute.components(list(enumerate(texts)))
    least = {}
    for d, t, _ in rows:
        if t and t.split():
            k = group[texts.index(t)][1]
            key = (d is not None, d or 0, t)
            least[k] = min(least.get(k, key), key)
    want = Counter((d if some else None, t) for some, d, t in least.values()) + Counter((d, t) for d, t, _ in rows if not (t and t.split()))
    assert {k: n for k, n in got.items() if k[0] not in (13, 14)} == {k: n for k, n in want.items() if k[0] not in (13, 14)} and sum(got.values()) == sum(want.values())
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, frame.limit(0), SMALL)
        assert empty.count() == 0 and (name == "best_fit_packing" or empty.columns == frame.columns)
