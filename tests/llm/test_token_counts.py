"""Token counts against the tokenizers library run over whole texts."""

from collections import Counter

import pytest
from helpers_llm import SF, awkward, documents, sf_documents

from peergauge.llm import queries
from peergauge.llm.token_counts import PreTokens, count_tokens

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    """The untouched library: strings of added tokens count as it counts them."""
    tokenizer = tokenizers.Tokenizer.from_file(JSON)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def expected(rows, plain, limit=512):
    return Counter(
        (r.doc_id, len((r.text or "").encode()), plain(r.text), plain(r.text) > limit) for r in rows
    )


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_query_equals_whole_texts(spark, plain):
    got = queries.op13_token_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert counted(got) == expected(sf_documents(spark).collect(), plain)


def test_awkward_rows(spark, plain):
    docs = awkward(spark)
    got = count_tokens(docs, JSON, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert counted(got) == expected(docs.collect(), plain, 3)


def test_added_tokens_and_other_scripts(spark, plain):
    end = "<|endoftext|>"
    texts = [
        end,
        end * 3,
        f"!!{end}  {end} a  {end}\n",
        f"x{end}' {end}s'll",
        "<|endoftext|",
        "naïve – “quoted” … 你好 ١٢٣ ⅷ ʰ \U0001f600‍\U0001f600 é",
        "a b　 c  d﻿e ᠎ f",
        "tab\t\ttab \r\n\r\n end \x00\x1f\x85",
    ]
    docs = documents(spark, texts)
    assert counted(count_tokens(docs, JSON)) == expected(docs.collect(), plain)


def test_very_long_texts(spark, plain):
    words = " ".join(f"w{i}" for i in range(200_000))
    docs = documents(spark, [words, "a" * 300_000, " " * 300_000, "\n" * 70_000 + "é" * 50_000, "x"])
    assert counted(count_tokens(docs, JSON)) == expected(docs.collect(), plain)


def test_small_blocks_and_many_parts(spark, plain, monkeypatch):
    from peergauge.llm import token_counts

    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 200)
    docs = sf_documents(spark).repartition(7)
    assert counted(count_tokens(docs, JSON)) == expected(docs.collect(), plain)


def test_empty_table(spark):
    assert count_tokens(documents(spark, []), JSON).collect() == []


def test_pre_tokens_rejoin_to_the_text():
    cut = PreTokens(JSON).split
    for text in ("", "a  b\n\n c ", "<|endoftext|>x", "— ‘you’ll’ 12 ٣"):
        assert "".join(cut(text)) == text


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        PreTokens(P.path("word_bpe_49k.json"))


def test_rows_of_words_grow_with_the_text(spark, monkeypatch):
    """Twice the text gives at most twice the rows that are shuffled: one per word and block."""
    from peergauge.llm import token_counts

    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 50_000)
    rows, written = [], token_counts.write_shared

    def recorded(df, label):
        table = written(df, label)
        rows.append(table.selectExpr("sum(size(words))").first()[0])
        return table

    monkeypatch.setattr(token_counts, "write_shared", recorded)
    docs = sf_documents(spark).coalesce(1)
    count_tokens(docs, JSON)
    count_tokens(docs.unionByName(docs).coalesce(1), JSON)
    assert rows[1] <= 2.1 * rows[0]
