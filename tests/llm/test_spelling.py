"""Spelling variants against plain counting and all edits of every word."""

import re
import zlib
from collections import Counter

import pytest
from helpers_llm import SF, awkward, documents, sf_documents

from peergauge.llm import queries
from peergauge.llm.spelling import corpus_words, group_variants, near_pairs

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows, least_length=5, least_n=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}


def neighbours(words):
    letters = set("".join(words))
    near = {w: set() for w in words}
    for word in words:
        for i in range(len(word) + 1):
            edits = {word[:i] + c + word[i:] for c in letters}
            if i < len(word):
                edits |= {word[:i] + c + word[i + 1 :] for c in letters}
                edits.add(word[:i] + word[i + 1 :])
            near[word] |= edits & words.keys()
    return {w: found - {w} for w, found in near.items()}


def plain_variants(words):
    near, form = neighbours(words), {}
    for word, found in near.items():
        best = min(found, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= 2 * words[word] else None
    rows = []
    for word in words:
        root = word
        while form[root]:
            root = form[root]
        n_form = words[form[word]] if form[word] else None
        rows.append((word, form[word], root, words[word], len(near[word]), n_form))
    return sorted(rows)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_query_equals_plain_version(spark):
    got = result(queries.op12_spelling(spark, SF))
    assert got == plain_variants(plain_words(rows_of(sf_documents(spark))))
    assert any(form for _, form, *_ in got) and any(root != form for _, form, root, *_ in got if form)


def word_table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def pairs_of(df):
    found = [(r.a, r.b) for r in df.collect()]
    assert len(found) == len({frozenset(p) for p in found})
    return {frozenset(p) for p in found}


def all_pairs(words):
    return {frozenset((w, o)) for w, found in neighbours(words).items() for o in found}


@pytest.mark.parametrize("group", [2, 32])
def test_every_pair_is_found_once(spark, group):
    import itertools

    # Few letters and short words: every kind of edit, also inside runs of one letter.
    words = {"".join(w): 3 for size in (2, 3, 4, 5) for w in itertools.product("aé", repeat=size)}
    words |= {"prefix" + w + "suffix": 4 for w in list(words)}
    assert pairs_of(near_pairs(word_table(spark, words), group)) == all_pairs(words)


def test_a_shared_beginning_does_not_pair_all(spark, monkeypatch):
    """Words that share half of their letters by the thousand are split, not paired."""
    from peergauge.llm import spelling

    met, verified = [], spelling._verified

    def recorded(rows):
        sizes = rows.groupBy("key").count()
        met.append(sizes.selectExpr("coalesce(sum(count * count), 0)").first()[0])
        return verified(rows)

    monkeypatch.setattr(spelling, "_verified", recorded)
    found = []
    for many in (2000, 4000):
        met.clear()
        tails = (f"{i * 7919 % 100_003:08d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(many))
        words = {"commonpart" + tail: 3 for tail in tails}
        assert pairs_of(near_pairs(word_table(spark, words))) == all_pairs(words)
        found.append(sum(met))
    assert found[0] < 2000 * 200 and found[1] < 3 * found[0]


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert result(group_variants(docs, 2, 1)) == plain_variants(plain_words(rows_of(docs), 2, 1))


def test_forms_chain_to_the_root_and_ties_take_the_smallest(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96}
    counts |= {"zzzzz": 3, "zzzzy": 9, "zzzzx": 9, "Übers": 5, "übers": 10, "Zebra": 4, "zebr": 50}
    docs = documents(spark, [" ".join([w] * n) for w, n in counts.items()])
    got = result(group_variants(docs))
    assert got == plain_variants(plain_words(rows_of(docs)))
    of = {r[0]: r for r in got}
    assert of["zzzzz"][1] == "zzzzx"


def test_very_long_texts_and_words(spark):
    texts = [" ".join(["vielleicht", "viellecht", "vieleicht"] * 40_000), "x" * 3000]
    texts += [("x" * 3000 + " ") * 3, ("x" * 2999 + " ") * 7, "ab" * 50_000]
    docs = documents(spark, texts)
    got = {r.word: r for r in group_variants(docs).collect()}
    words = plain_words(rows_of(docs))
    assert {w: r.n for w, r in got.items()} == words
    for word, row in got.items():
        if len(word) > 20:
            near = [w for w in words if w != word and set(w) == {"x"} and abs(len(w) - len(word)) < 2]
            assert row.n_near == len(near)


def test_empty_tables_and_null_texts(spark):
    assert group_variants(documents(spark, [])).collect() == []
    assert group_variants(documents(spark, [None, "", "1 2"])).collect() == []
    assert corpus_words(documents(spark, ["short"] * 2)).collect() == []
