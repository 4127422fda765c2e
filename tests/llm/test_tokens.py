"""Token files, packing and word-wise BPE against the libraries run over whole texts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from helpers_llm import SF, awkward, documents, sf_documents
from pyspark.sql import functions as F

from peergauge.llm import bpe_words, queries
from peergauge.llm.bpe_words import decode_documents, encode_documents, read_ranks
from peergauge.llm.packing import closest_fill, pack_documents, plan_windows
from peergauge.llm.token_files import read_token_files, with_ids_crc32, write_token_files
from peergauge.llm.text_ids import TextEncoder
from peergauge.session import new_shared_path

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    tokenizer = tokenizers.Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def expected_files(rows, whole):
    """(doc_id, start, n_tokens, crc32) by order of doc_id; the texts of equal ids in any order."""
    out, start = [], 0
    for row in rows:
        ids = whole(row.text) + [2]
        out.append((row.doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return out


def test_token_files_equal_whole_texts(spark, whole):
    rows = sf_documents(spark).orderBy("doc_id").collect()
    got = queries.op7_token_files(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected_files(rows, whole)


def test_token_files_of_awkward_rows(spark, whole):
    docs, path = awkward(spark), new_shared_path(spark, "t")
    write_token_files(docs, path, JSON, 2, metadata=("lang",))
    got = with_ids_crc32(read_token_files(spark, path, "lang", "ids")).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, n, c) for i, _, n, c in expected_files(docs.collect(), whole)
    )
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]
    assert {r.lang for r in got} == {"en"}


def test_token_files_are_read_by_column(spark):
    path = new_shared_path(spark, "t")
    write_token_files(documents(spark, ["a b", "c"]), path, JSON, 2, page_rows=1)
    plan = read_token_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids#" not in plan
    import glob

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f) for f in glob.glob(f"{path.removeprefix('file:')}/part-*")]
    columns = {
        f.metadata.row_group(0).column(i).path_in_schema: f.metadata.row_group(0).column(i)
        for f in files
        for i in range(f.metadata.num_columns)
    }
    ids = columns["ids.list.element"]
    # A few ids are written as deltas where a dictionary would not pay.
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
    assert ids.has_offset_index and ids.has_column_index


def test_token_files_of_no_rows(spark):
    path = new_shared_path(spark, "t")
    write_token_files(documents(spark, []), path, JSON, 2)
    assert with_ids_crc32(read_token_files(spark, path, "ids")).collect() == []


def check_packing(pieces, rows, whole, capacity):
    texts = defaultdict(list)
    for row in rows:
        texts[row.doc_id].append(packed(whole(row.text) + [1]))
    got = defaultdict(list)
    windows = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
        windows[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length > 0
    assert set(got) == set(texts)
    for doc_id, parts in got.items():
        if len(texts[doc_id]) == 1:
            parts = sorted(parts, key=lambda p: p.start)
            assert b"".join(p.ids for p in parts) == texts[doc_id][0]
            assert [p.start for p in parts] == [
                sum(q.length for q in parts[:i]) for i in range(len(parts))
            ]
            assert {p.doc_tokens for p in parts} == {len(texts[doc_id][0]) // 4}
        assert sum(p.length for p in parts) == sum(len(t) // 4 for t in texts[doc_id])
    assert sorted(windows) == list(range(len(windows)))
    for spans in windows.values():
        place = 0
        for offset, length in sorted(spans):
            assert offset == place
            place += length
        assert place <= capacity
    total = sum(p.length for p in pieces)
    return len(windows) * capacity / max(total, 1)


def test_packing_of_the_test_table(spark, whole):
    rows = sf_documents(spark).collect()
    docs = sf_documents(spark).repartition(3)
    pieces = pack_documents(docs, JSON, 1).collect()
    assert check_packing(pieces, rows, whole, 2048) < 1.01
    digest = queries.op4_packing(spark, SF).collect()
    assert sum(r.length for r in digest) == sum(p.length for p in pieces)
    ids = {r.doc_id: packed(whole(r.text) + [1]) for r in rows}
    for r in digest:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_of_awkward_rows(spark, whole, capacity):
    docs = awkward(spark)
    pieces = pack_documents(docs, JSON, 1, capacity=capacity, max_slack=0).collect()
    total = sum(p.length for p in pieces)
    waste = check_packing(pieces, docs.collect(), whole, capacity)
    assert waste * total - total < capacity


def test_packing_of_no_rows(spark):
    assert pack_documents(documents(spark, []), JSON, 1).collect() == []


def test_closest_fill_is_the_best_multiset():
    import random

    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        room = rng.randint(0, 40)
        items = [n for n, c in counts.items() for _ in range(c)]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        fill = closest_fill(counts, room)
        assert sum(n * c for n, c in fill.items()) == max(s for s in sums if s <= room)
        assert all(0 < c <= counts[n] for n, c in fill.items())


def test_plan_places_every_remainder_once():
    import random

    rng = random.Random(6)
    for slack in (0, 3):
        counts = {rng.randint(1, 99): rng.randint(1, 40) for _ in range(30)}
        plan = plan_windows(counts, 100, slack)
        taken = Counter()
        for length, n in counts.items():
            for k in range(n):
                for _, here, window, offset in plan.pieces(length, k):
                    taken.update((window, offset + i) for i in range(here))
        assert set(taken.values()) == {1}
        windows = max(w for w, _ in taken) + 1
        assert windows * 100 - len(taken) <= slack * plan.tail_window + 99


def tiktoken_rows(rows):
    encoding = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={}
    )
    out = Counter()
    for row in rows:
        text = row.text or ""
        ids = encoding.encode_ordinary(text)
        out[row.doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_word_wise_bpe_equals_whole_texts(spark):
    got = queries.op5_bpe(spark, SF)
    assert Counter(map(tuple, got.collect())) == tiktoken_rows(sf_documents(spark).collect())


def test_word_wise_bpe_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr("peergauge.llm.bpe_words.BLOCK_BYTES", 400)
    docs = awkward(spark)
    both = decode_documents(encode_documents(docs, RANKS, P.PATTERN), RANKS)
    got = both.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n"),
        F.sha2("ids", 256).alias("ids"),
        F.sha2("decoded", 256).alias("decoded"),
    )
    assert Counter(map(tuple, got.collect())) == tiktoken_rows(docs.collect())


def test_words_travel_packed():
    lists = [[], [""], ["a"], ["é\0", "", "你好" * 40], [f" w{i}" for i in range(5000)]]
    for words in lists:
        assert bpe_words._unpack_words(bpe_words._pack_words(words)) == words
    assert len(bpe_words._pack_words([" word"])) <= 5 + 12


@pytest.mark.parametrize("copies", [1, 3])
def test_messages_weigh_no_more_than_distinct_words(spark, copies):
    """However many shares there are, a block has no more messages than distinct words."""
    docs = documents(spark, [f"same word {i % 7} and {i}" * 9 for i in range(200)] * copies)
    rows = (
        docs.select("doc_id", "text")
        .repartition(8 * copies)
        .mapInArrow(
            bpe_words._blocks(P.PATTERN, 10**9),
            "block long, share int, words binary, doc_ids array<long>, counts array<long>, "
            "positions binary",
        )
        .collect()
    )
    sent = [r for r in rows if r.share is not None]
    words = [bpe_words._unpack_words(bytes(r.words)) for r in sent]
    assert len(rows) - len(sent) == 8 * copies
    assert len({(r.block, w) for r, own in zip(sent, words) for w in own}) == sum(map(len, words))
    assert len(sent) <= sum(map(len, words))
    assert sum(len(r.words) for r in sent) <= sum(len(w) + 12 for own in words for w in own)


def test_word_wise_bpe_of_no_rows(spark):
    encoded = encode_documents(documents(spark, []), RANKS, P.PATTERN)
    assert decode_documents(encoded, RANKS).collect() == []


def test_decoding_takes_null_and_empty_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert [bytes(r.decoded) for r in decode_documents(rows, RANKS).collect()] == [b"", b""]


def test_strings_of_added_tokens_are_as_in_the_plain_call():
    plain = tokenizers.Tokenizer.from_file(JSON)
    encoder = TextEncoder(JSON)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    texts = ["it's 12 plain words\n\nand more", "<|endoftext|", " " * 9 + "x" * 50_000]
    for t in added:
        texts += [t, f"a {t} b", f"a{t}{t}  \n{t}'s", f"é {t} 你好 " * 3, "word " * 40_000 + t]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0] == packed(ids)


def test_a_batch_of_usual_and_odd_texts_keeps_its_order():
    import pyarrow as pa

    plain = tokenizers.Tokenizer.from_file(JSON)
    texts = ["a word.\nand, it's <b>é</b> 12.", None, "", " lead", "x\n\ny", "a <|endoftext|> b", "ª.º ×÷ a×."]
    texts += ["слово, слово. ж.", "'s 's. it'd, .a. a.b", "no end here", "\x00 a\x00.", "end "] * 3
    want = [packed(plain.encode(t or "", add_special_tokens=False).ids + [1]) for t in texts]
    encoder = TextEncoder(JSON)
    for rows in (texts, texts[:1], texts[3:4], []):
        got = encoder.encode_array(pa.array(["cut off", *rows], pa.string())[1:], packed([1]))
        assert got.type == pa.binary()
        assert got.to_pylist() == want[texts.index(rows[0]) :][: len(rows)] if rows else not len(got)


def test_encoding_makes_no_object_for_every_word():
    """Words that repeat in a batch are looked up once; their ids are laid out by Arrow."""
    import tracemalloc

    encoder, text = TextEncoder(JSON), "some words, that come again and again.\n" * 50_000 + "end"
    encoder.encode([text[:100]])
    tracemalloc.start()
    (ids,) = encoder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text)
    assert ids[: 4 * 10 * 50_000] == ids[: 4 * 10] * 50_000
